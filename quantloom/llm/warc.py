"""WARC records and a Merkle fixity audit of replicas.

Records are laid out in files of bounded size; within a file they follow each other by offset, in the
order of a hash of their key. The key's leading hash digits also name the record's range, a run of
neighbouring records and so an ordered offset range, whatever was lost or added elsewhere in the file. A range's
node is the SHA-256 of its records' keys, lengths and digests in the order of their offsets; each ``fanout`` ranges
hash into a node above, and so on up to the file's root. The original and a replica are hashed from their
own bytes and laid out by their own offsets. The audit compares roots and goes down only where hashes
differ, level by level, so that its cost beyond the hashing follows the damage; only the records of ranges that differ are compared one by one.
All of it is DataFrame work; a node gathers at most ``fanout`` children, and a range as many records on average.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.storage import materialize

CRLF = "\r\n"


def render(url: Column, body: Column, record_id: Column) -> Column:
    """A WARC/1.0 resource record as bytes: header lines, empty line, block, two line ends."""
    block = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:record:"), record_id, F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}WARC-Block-Digest: sha256:"), F.sha2(block, 256), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit(CRLF * 2), "UTF-8"))


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``key``, ``record`` (bytes) and ``length``. Null urls and bodies are empty ones; rows with a null id have key ``null``.

    Exactly repeated rows are one record; rows that share an id but differ get a record each, told apart by a digest in the key.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    made = rows.withColumn("record", render(F.col("url"), F.col("body"), name)).select(F.col("id"), name.alias("name"), "record")
    return made.select("id", F.concat("name", F.lit("-"), F.substring(F.sha2("record", 256), 1, 16)).alias("key"), "record", F.octet_length("record").cast("long").alias("length"))


def manifest(recs: DataFrame) -> DataFrame:
    """``recs`` with ``digest`` and ``length`` of the bytes in ``record``, which go."""
    return recs.withColumn("digest", F.sha2("record", 256)).withColumn("length", F.octet_length("record").cast("long")).drop("record")


def _hashed(first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5("key"), first, digits), 16, 10).cast("long")


def layout(recs: DataFrame, *, file_bytes: int = 1 << 26, files: int | None = None) -> DataFrame:
    """Deal records to ``files`` files, or to files of about ``file_bytes``, by a hash of their key, and lay them out there: ``file``, ``nth``, ``offset``.

    Within a file records are ordered by another hash of the key, then by key. Rows equal in every column but the bytes are one record; keep a digest of the bytes among them, as ``manifest`` and the keys of ``records`` do.
    """
    sized = recs.dropDuplicates([c for c in recs.columns if c != "record"])
    if files is None:
        files = max(1, math.ceil((recs.agg(F.sum("length")).first()[0] or 0) / file_bytes))
    dealt = sized.withColumn("file", (_hashed(1, 8) % files).cast("int")).withColumn("_turn", _hashed(9, 8))
    w = Window.partitionBy("file").orderBy("_turn", "key")
    return dealt.withColumn("nth", F.row_number().over(w) - 1).withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_turn")


def depth(placed: DataFrame, *, fanout: int = 16) -> int:
    """Levels below the root such that a range holds about ``fanout`` records."""
    found = placed.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    levels = 0
    while fanout ** (levels + 1) < found:
        levels += 1
    return levels


def ranged(placed: DataFrame, levels: int, *, fanout: int = 16) -> DataFrame:
    """``placed`` with ``node``, the number of each record's range."""
    return placed.withColumn("node", F.floor(_hashed(9, 8) * F.lit(fanout**levels) / F.lit(1 << 32)).cast("long"))


def tree(parts: DataFrame, levels: int, *, fanout: int = 16) -> list[DataFrame]:
    """Levels from the ranges to the roots, from records with ``file``, ``node``, ``offset``, ``key``, ``length``, ``digest``; each is written out once."""
    leaf = F.sha2(F.concat_ws(":", "key", "length", "digest"), 256)
    rows = parts.groupBy("file", "node").agg(F.sort_array(F.collect_list(F.struct("offset", "key", leaf.alias("hash")))).alias("c"))
    hashed = F.sha2(F.concat_ws(",", F.transform("c", lambda x: x["hash"])), 256).alias("hash")
    out = [materialize(rows.select("file", "node", hashed))]
    for _ in range(levels):
        kids = out[-1].select("file", F.floor(F.col("node") / fanout).cast("long").alias("up"), "node", "hash")
        up = kids.groupBy("file", "up").agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("c"))
        out.append(materialize(up.select("file", F.col("up").alias("node"), F.sha2(F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))), 256).alias("hash"))))
    return out


def audit(one: list[DataFrame], two: list[DataFrame], *, fanout: int = 16) -> DataFrame:
    """``file``, ``node`` of the ranges that differ between two trees of one height; what lies below equal hashes isn't read further."""
    open_: DataFrame | None = None
    for k in range(len(one) - 1, -1, -1):
        a, b = one[k], two[k]
        if open_ is not None:
            a, b = a.join(open_, ["file", "node"], "left_semi"), b.join(open_, ["file", "node"], "left_semi")
        differ = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["file", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node")
        if k == 0:
            return materialize(differ)
        open_ = materialize(differ.select("file", F.explode(F.sequence(F.col("node") * fanout, F.col("node") * fanout + fanout - 1)).alias("node")))
    raise AssertionError("a tree has a level at least")


def fixity(placed: DataFrame, replica: DataFrame, *, fanout: int = 16) -> DataFrame:
    """Audit a replica: both have ``file``, ``offset``, ``nth``, ``key``, ``length``, ``digest``, taken from their own bytes, and the same other columns.

    Returns the rows of ``placed`` with ``status``, and those that only the replica has:
    ok; corrupt (other bytes, cut ones included); missing; moved (the same bytes in another file, or not in the order of the
    others of its range); added. That a record begins elsewhere as one before it was lost or cut is no damage to it. A key that a replica holds twice is ok only if
    all its copies are. Null and empty bodies are records too; empty inputs give an empty result.
    """
    columns = placed.columns
    levels = depth(placed, fanout=fanout)
    mine, theirs = ranged(placed, levels, fanout=fanout), ranged(replica.select(*columns), levels, fanout=fanout)
    bad = audit(tree(mine, levels, fanout=fanout), tree(theirs, levels, fanout=fanout), fanout=fanout)
    here, there = mine.join(bad, ["file", "node"], "left_semi"), materialize(theirs.join(bad, ["file", "node"], "left_semi"))
    found = there.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("file").alias("file2"), F.min("offset").alias("offset2"))
    both = materialize(here.join(found, "key", "left"))
    # Order among the records that both have: a record is out of it if one before it in the original comes after it in the replica.
    order = Window.partitionBy("file", "node").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.max(F.when(F.col("file2") == F.col("file"), F.col("offset2"))).over(order) > F.col("offset2")
    same = (F.col("lo") == F.col("digest")) & (F.col("hi") == F.col("digest"))
    status = F.when(F.col("lo").isNull(), "missing").when(~same, "corrupt").when((F.col("file2") != F.col("file")) | F.coalesce(turned, F.lit(False)), "moved").otherwise("ok")
    judged = both.withColumn("status", status).select(*columns, "status")
    good = mine.join(bad, ["file", "node"], "left_anti").select(*columns, F.lit("ok").alias("status"))
    added = there.join(here.select("key"), "key", "left_anti").select(*columns, F.lit("added").alias("status"))
    return good.unionByName(judged).unionByName(added)


def write(placed: DataFrame, path: str) -> None:
    """Write the laid-out records as one real WARC file (``file=N/part...warc``) a file number, gathered by the worker that writes it through Spark's text sink."""
    body = placed.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("nth", "record"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.decode(x["record"], "UTF-8")), "")
    body.select("file", text.alias("value")).write.partitionBy("file").option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below ``path``: ``file`` (where partitioned), ``record_id``, ``url``, ``body``, found by their headers' lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data in b["content"]:
                at = data.find(b"WARC/")
                while at >= 0:
                    head_end = data.find(b"\r\n\r\n", at)
                    head = dict(x.split(": ", 1) for x in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                    start = head_end + 4
                    stop = start + int(head.get("Content-Length", 0))
                    out.append((head.get("WARC-Record-ID", "").removeprefix("<urn:record:").removesuffix(">"), head.get("WARC-Target-URI", ""), data[start:stop].decode("utf-8", "replace")))
                    at = data.find(b"WARC/", stop)
            yield pd.DataFrame(out, columns=["record_id", "url", "body"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, "record_id string, url string, body string")
