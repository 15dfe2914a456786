"""Mixing sources to target weights.

Words are summed by source; weights share out the total, a source's target is
held to ``most`` times its size and the excess goes to the others by weight. A source's rate is its
target over its size. A document is emitted floor(rate) times, and once more with the rate's fraction as
probability, by a draw that a hash seeds.

The draws of a source depend on each other, as independent ones would miss the target of a source with few or very unequal documents.
Its documents fall into strata of nearly one size (the size's first six binary digits). From the largest stratum down,
the fraction is what is still missing of the words that are left, and the stratum's number of further
copies is that fraction of its documents, rounded by a hash-seeded draw; so a document's probability stays the rate's fraction,
and what one stratum takes too much or too little, the smaller ones make good. Within a stratum the documents with the smallest
hashes of id and text are taken. Only the hash where that ends goes back to the documents; texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hashes are below this.
SPAN = 1 << 48
_BIG = "decimal(38,0)"


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(id_: Column, text: Column) -> Column:
    """Uniform below SPAN by the md5 of id and text; the same in every run and every engine. Null counts as ``null`` and as an empty text."""
    whole = F.concat(F.lit("mix:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 12), 16, 10).cast("long")


def stratum(size: Column) -> Column:
    """A number that grows with the size: its number of binary digits beyond six, and the first six."""
    beyond = F.greatest(F.length(F.bin(size)) - 6, F.lit(0))
    return (beyond * 64 + F.call_function("shiftright", size, beyond)).cast("int")


def _added_up(rows: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of its column over the rows before, by a sort over the cluster and the sums of its parts."""
    spark_parts = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = spark_parts.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(*(F.sum(F.col(c).cast(_BIG)).alias(f"_{k}") for k, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).cast(_BIG).alias(f"_{k}") for k in sums))
    inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(parts, "_part")
    for k, c in sums.items():
        out = out.withColumn(k, (F.col(f"_{k}") + F.coalesce(F.sum(F.col(c).cast(_BIG)).over(inner), F.lit(0)).cast(_BIG)).cast(_BIG))
    return out.drop("_part", "_at", *(f"_{k}" for k in sums))


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from rows of ``source``, ``size``.

    The fixed point of resharing: sources are full in the order of cap over
    weight, as long as the cap is at most the share of what the full ones leave.
    Places and sums in an order of sources come of a sort over the cluster, so sources may be many.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    nth = _added_up(total, [F.col("source").asc_nulls_last()], {"nth": "one"})
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("nth").cast("long"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    weighed = nth.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    weighed = weighed.withColumn("turn", F.col("cap") / F.col("weight"))
    ranked = materialize(_added_up(weighed, [F.col("turn").asc(), F.col("source").asc_nulls_last()], {"capped": "cap", "gone": "weight"}))
    every = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    rest, left = (F.lit(int(every["size"])).cast(_BIG) - F.col("capped")).cast(_BIG), (F.lit(int(every["weight"])).cast(_BIG) - F.col("gone")).cast(_BIG)
    ranked = ranked.withColumn("rest", rest).withColumn("left", left).withColumn("full", (F.col("cap").cast(_BIG) * F.col("left")).cast(_BIG) <= (F.col("rest") * F.col("weight").cast(_BIG)).cast(_BIG))
    spare = ranked.where(~F.col("full")).agg(F.min(F.struct("turn", F.col("source").isNull(), "source", "rest", "left")).alias("x")).first()["x"]
    share = F.lit(0.0) if spare is None else F.col("weight") * F.lit(float(spare["rest"])) / F.lit(float(spare["left"]))
    return ranked.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _counts(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's strata, each with the number of its documents that are emitted once more."""
    rows = rows.sort_values("stratum", ascending=False)
    missing, left, out = float(rows["extra"].iloc[0]), float(rows["words"].sum()), []
    name = "null" if rows["source"].isna().iloc[0] else rows["source"].iloc[0]
    for n, words, k in zip(rows["n"], rows["words"], rows["stratum"], strict=True):
        part = min(1.0, max(0.0, missing / left)) if left > 0 else 0.0
        toss = int(hashlib.md5(f"mix:{name}:{k}".encode()).hexdigest()[:12], 16) / float(SPAN)
        take = min(int(n), math.floor(part * float(n) + toss))
        missing -= take * (float(words) / float(n))
        left -= float(words)
        out.append(take)
    return rows[["source", "stratum", "n"]].assign(take=out)


def _cuts(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """``source``, ``stratum`` and ``cut``: documents with a hash up to it are emitted once more. ``sized`` has ``source``, ``size``, ``stratum``, ``h``."""
    strata = materialize(sized.groupBy("source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (F.col("target") - F.floor(rate) * F.col("source_size")).alias("extra")
    aimed = strata.join(aims.select(F.col("source").alias("s"), extra), F.col("source").eqNullSafe(F.col("s"))).select("source", "stratum", "n", "words", "extra")
    kind = dict(strata.dtypes)["source"]
    # A source has some 64 strata and 32 more for each doubling of its largest document.
    counted = materialize(aimed.groupBy("source").applyInPandas(_counts, f"source {kind}, stratum int, n long, take long"))
    some = counted.where("take > 0 and take < n").select(F.col("source").alias("s"), F.col("stratum").alias("k"), "n", "take")
    mine = F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("k"))
    # The hash at which the count is reached: first its cell, one of about the root of the stratum's documents, then its place in the cell.
    cells = F.ceil(F.sqrt("n"))
    celled = sized.join(some, mine).select("source", "stratum", "take", "h", F.floor(F.col("h") * cells / F.lit(float(SPAN))).alias("cell"))
    before = Window.partitionBy("source", "stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = celled.groupBy("source", "stratum", "cell").agg(F.count("*").alias("in"), F.first("take").alias("take")).withColumn("under", F.coalesce(F.sum("in").over(before), F.lit(0)))
    crossed = filled.where("under < take and take <= under + `in`").select(F.col("source").alias("s"), F.col("stratum").alias("k"), F.col("cell").alias("c"), (F.col("take") - F.col("under")).alias("nth"))
    inside = celled.join(crossed, mine & (F.col("cell") == F.col("c")))
    ordered = inside.withColumn("i", F.row_number().over(Window.partitionBy("source", "stratum").orderBy("h")))
    found = ordered.where("i = nth").select("source", "stratum", F.col("h").alias("cut"))
    return materialize(found.union(counted.where("take = n").select("source", "stratum", F.lit(SPAN).alias("cut"))))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_of(f"`{text_col}`").alias("size"), drawn(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    return rows.withColumn("stratum", stratum(F.col("size")))


def _planned(rows: DataFrame, narrow: DataFrame, weights: Sequence[int], most: int, broadcast_rows: int) -> DataFrame:
    """``rows`` (``source``, ``size``, ``stratum``, ``h``) with ``source_size``, ``target`` and ``copies``, as ``narrow``, the same documents, decides."""
    aims = materialize(targets(narrow.select("source", "size"), weights, most))
    cuts = _cuts(narrow, aims)
    aimed = aims.select(F.col("source").alias("s"), "source_size", "target")
    cut = cuts.select(F.col("source").alias("s2"), F.col("stratum").alias("k"), "cut")
    small = cut.count() <= broadcast_rows and aimed.count() <= broadcast_rows
    both = rows.join(F.broadcast(aimed) if small else aimed, F.col("source").eqNullSafe(F.col("s")))
    both = both.join(F.broadcast(cut) if small else cut, F.col("source").eqNullSafe(F.col("s2")) & (F.col("stratum") == F.col("k")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return both.withColumn("copies", (F.floor(rate) + F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)).cast("long")).cast("long"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3, broadcast_rows: int = 100_000) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of every row.

    Null or empty texts have size 0 and take 0 words; a source of size 0 has
    target 0. A null source is a source, the last one. Rows equal in id and text share one draw; long texts are read whole, other columns not looked at.
    Sources and strata are broadcast only up to ``broadcast_rows`` rows. An empty table gives an empty result.
    """
    sizes = materialize(_sized(docs, id_col, text_col, source_col))
    return _planned(sizes, sizes, weights, most, broadcast_rows).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3, broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` with each row as often as ``plan`` says, columns of any name untouched; rows of size 0 go, as no words are taken from them."""
    narrow = materialize(_sized(docs, id_col, text_col, source_col))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    size = size_of(f"`{text_col}`").alias("size")
    whole = docs.select(row, F.col(f"`{source_col}`").alias("source"), size, drawn(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    taken = _planned(whole.where("size > 0").withColumn("stratum", stratum(F.col("size"))), narrow, weights, most, broadcast_rows).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
