"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import digest, langid, licences, linededup, mixing, packing, quality, rules, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(modulus: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest


def tokenizer_paths() -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out_of = F.coalesce(held(4, 2), F.lit(False))
    model = langid.fit(docs.where(~out_of).select("text", "lang"))
    return langid.predict(docs.select("doc_id", out_of.alias("held_out"), "text"), model).drop("text")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, F.coalesce(held(5, 0), F.lit(False)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), max_bits=4, shingle=4)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_neighbours(_table(spark, sf_dir, "documents"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, audited against a replica. By a rule on the key's md5 the replica's bytes have some records cut, some lost and some held under a second key; both are hashed and laid out from their bytes."""
    made = warc.records(_table(spark, sf_dir, "pages"))
    fate = F.conv(F.substring(F.md5(F.concat(F.lit("replica:"), "key")), 1, 8), 16, 10).cast("long") % 200
    cut = F.when(fate == 0, F.concat(F.expr("substring(record, 1, 100)"), F.encode(F.lit("?"), "UTF-8"))).otherwise(F.col("record"))
    keys = F.when(fate == 1, F.array().cast("array<string>")).when(fate == 2, F.array(F.col("key"), F.concat(F.lit("again-"), "key"))).otherwise(F.array("key"))
    copied = made.select("id", F.explode(keys).alias("key"), cut.alias("record"))
    placed = warc.materialize(warc.layout(warc.manifest(made)))
    files = (placed.agg(F.max("file")).first()[0] or 0) + 1
    replica = warc.materialize(warc.layout(warc.manifest(copied), files=files))
    found = warc.fixity(placed, replica)
    return found.select(F.col("id").alias("page_id"), "key", "file", F.col("nth").cast("long").alias("nth"), F.col("offset").cast("long").alias("offset"), "length", "digest", "status")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), length=1024, end_id=2, **tokenizer_paths())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_classifier, op3_quality_rules, op4_simhash_near_dedup, op5_line_dedup, op6_source_mixing,
        op7_document_fingerprints, op8_warc_fixity, op9_best_fit_packing, op10_license_scan, pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op6_source_mixing": r"""
WITH RECURSIVE s AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':' || COALESCE(text, '')), 1, 12) AS BIGINT) AS h FROM documents),
src AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM src),
r AS (SELECT *, CAST(SUM(source_size) OVER () - COALESCE(SUM(cap) OVER e, 0) AS BIGINT) AS rest, CAST(SUM(weight) OVER () - COALESCE(SUM(weight) OVER e, 0) AS BIGINT) AS lft
      FROM w WINDOW e AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * lft <= rest * weight AS is_full FROM r),
p AS (SELECT rest, lft FROM f WHERE NOT is_full ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * CAST((SELECT rest FROM p) AS DOUBLE) / CAST((SELECT lft FROM p) AS DOUBLE) END AS target FROM f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
d AS (SELECT s.*, greatest(length(bin(size)) - 6, 0) AS beyond FROM s),
g AS (SELECT doc_id, source, size, h, CAST(beyond * 64 + (size >> CAST(beyond AS BIGINT)) AS INTEGER) AS stratum FROM d),
b AS (SELECT g.source, stratum, COUNT(*) AS n, CAST(SUM(size) AS DOUBLE) AS words, row_number() OVER (PARTITION BY g.source ORDER BY stratum DESC) AS turn,
             CAST('0x' || substr(md5('mix:' || COALESCE(g.source, 'null') || ':' || stratum), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS toss
      FROM g GROUP BY g.source, stratum),
walk AS (
  SELECT source, CAST(0 AS BIGINT) AS turn, CAST(-1 AS INTEGER) AS stratum, CAST(target - floor(rate) * source_size AS DOUBLE) AS missing, CAST(source_size AS DOUBLE) AS lft, CAST(0 AS BIGINT) AS take FROM u
  UNION ALL
  SELECT source, turn, stratum, missing - take * mean, lft - words, take FROM (
    SELECT b.source, b.turn, b.stratum, walk.missing, walk.lft, b.words, b.words / b.n AS mean,
           least(b.n, CAST(floor(CASE WHEN walk.lft > 0 THEN least(1.0, greatest(0.0, walk.missing / walk.lft)) ELSE 0.0 END * b.n + b.toss) AS BIGINT)) AS take
    FROM walk JOIN b ON b.source IS NOT DISTINCT FROM walk.source AND b.turn = walk.turn + 1)),
c AS (SELECT g.doc_id, g.size, u.source_size, u.target, CAST(floor(u.rate) AS BIGINT) + CASE WHEN rank() OVER (PARTITION BY g.source, g.stratum ORDER BY g.h) <= walk.take THEN 1 ELSE 0 END AS copies
      FROM g JOIN u ON g.source IS NOT DISTINCT FROM u.source JOIN walk ON g.source IS NOT DISTINCT FROM walk.source AND g.stratum = walk.stratum)
SELECT doc_id, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken FROM c
""",
    "op8_warc_fixity": r"""
WITH b AS (SELECT page_id, chr(13) || chr(10) AS nl, COALESCE(url, '') AS url, COALESCE(html, '') AS html, COALESCE(CAST(page_id AS VARCHAR), 'null') AS name FROM pages),
r AS (SELECT page_id, name, 'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:record:' || name || '>' || nl || 'WARC-Target-URI: ' || url || nl
             || 'WARC-Block-Digest: sha256:' || sha256(html) || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS record FROM b),
k AS (SELECT DISTINCT page_id, name || '-' || substr(sha256(record), 1, 16) AS key, record FROM r),
z AS (SELECT *, CAST(('0x' || substr(md5('replica:' || key), 1, 8)) AS BIGINT) % 200 AS fate, CAST(greatest(1, ceil((SELECT SUM(strlen(record)) FROM r) / 67108864)) AS BIGINT) AS files FROM k),
c AS (SELECT page_id, key, record, fate, files, 0 AS replica FROM z
      UNION ALL SELECT page_id, key, CASE WHEN fate = 0 THEN substr(record, 1, 100) || '?' ELSE record END, fate, files, 1 FROM z WHERE fate <> 1
      UNION ALL SELECT page_id, 'again-' || key, record, fate, files, 1 FROM z WHERE fate = 2),
n AS (SELECT *, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest, CAST(('0x' || substr(md5(key), 1, 8)) AS BIGINT) % files AS file, CAST(('0x' || substr(md5(key), 9, 8)) AS BIGINT) AS turn FROM c),
p AS (SELECT *, row_number() OVER w - 1 AS nth, CAST(SUM(length) OVER w - length AS BIGINT) AS "offset" FROM n WINDOW w AS (PARTITION BY replica, file ORDER BY turn, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, key, CAST(file AS INTEGER) AS file, nth, "offset", length, digest, CASE WHEN replica = 1 THEN 'added' WHEN fate = 0 THEN 'corrupt' WHEN fate = 1 THEN 'missing' ELSE 'ok' END AS status
FROM p WHERE replica = 0 OR key LIKE 'again-%'
""",
}
