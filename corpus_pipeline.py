"""A training corpus from ``documents``: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import langid, linededup, mixing, packing, shingles, storage
from quantloom.llm.queries import held, tokenizer_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_leftover: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage whose own tables go when the next one begins; its result is written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.remove(spark, _leftover)
        _leftover.clear()
        before = set(storage.written())
        out = f(spark, docs, sf_dir)
        _leftover.extend(p for p in storage.written() if p not in before)
        return out

    return run_stage


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., which no operator's own names meet, and the new name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(done: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of the input again, under their own names."""
    return done.select(*(F.col(new).alias(old) for old, new in names.items()))


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no letter, or that no language explains better than another, go."""
    model = langid.fit(docs.where(~F.coalesce(held(4, 2), F.lit(False))).select("text", "lang"))
    rows, names = apart(docs)
    judged = langid.predict(rows, model, text_col=names["text"])
    return named(judged.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= 0.5)), names)


@stage
def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts, and with them documents of which nothing else is left."""
    rows, names = apart(docs)
    text, n_chars = names["text"], names["n_chars"]
    done = linededup.deduplicate(rows, id_col=names["doc_id"], text_col=text)
    left = done.where((F.col("n_removed") == 0) | F.col(text).rlike(linededup.WORD))
    return named(left.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars))), names)


@stage
def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles at similarity 0.8 or more, the row with the smallest id stays.

    What is compared is found by SimHash fingerprints, met in sub-grids of segment bit counts and checked on their bits; the similarity follows exactly.
    A null id comes after all others; among equal ids the smallest row hash decides. Groups are told apart by their root, not by an id.
    Rows are known by id and text. Only candidates, and what goes, are joined with the texts, a small part of them as a rule; a bit table keeps the other texts out of the shuffle.
    """
    rid = F.xxhash64("doc_id", "text")
    prints = storage.materialize(shingles.sketches(docs.select("doc_id", "text", rid.alias("rid")), ["doc_id", "rid"]))
    classed = storage.materialize(prints.select("doc_id", "rid", "sid").join(shingles.classes(docs, prints, rid=rid), "sid").select("doc_id", "rid", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    first = storage.materialize(classed.groupBy("root").agg(F.min(order).alias("keep")).select(F.col("root").alias("of"), F.col("keep.rid").alias("keep")))
    judged = classed.join(first, F.col("root") == F.col("of")).withColumn("stays", F.col("rid") == F.col("keep"))
    counted = storage.materialize(judged.groupBy("rid").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    rows, names = apart(docs)
    rows = rows.withColumn("_rid", F.xxhash64(names["doc_id"], names["text"]))
    found = counted.select(F.col("rid").alias("_rid"))
    rows = storage.marked(rows, "_rid", found, "_maybe")
    maybe = rows.where("_maybe")
    kept = rows.where("not _maybe").unionByName(maybe.join(found, "_rid", "left_anti"))
    again = counted.where("stays").select(F.col("rid").alias("_rid"))
    if not again.isEmpty():  # the same row twice is rare
        kept = kept.unionByName(maybe.join(again, "_rid", "left_semi").dropDuplicates(["_rid"]))
    return named(kept, names)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; its source's target is at most three times its words. Texts with no word go."""
    return mixing.mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document with their place in sequences; a document that the mix took twice is packed twice."""
    return packing.pack(docs, **tokenizer_paths())


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", deduplicate_lines),
    ("near-dedup", deduplicate_near),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained and tokenised stages have no SQL; tests/llm/test_pipeline.py compares run() with the five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. Each stage's result is a table in the shared folder, deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = None
    for i, (_, f) in enumerate(STAGES):
        out = f(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{storage.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if previous:
            storage.remove(spark, [previous])
        previous = path
    return docs
