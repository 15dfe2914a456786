"""Line dedup over a suffix array of line-ID sequences.

Every document is a sequence of line IDs (blank lines aside); a suffix starts at
a line and ends with its document. Prefix doubling ranks the suffixes by their
first 1, 2, 4, ... lines: round k sorts the distinct pairs (rank at a line, rank 2^k
lines on) over the cluster, and a pair's place in the order is the new rank. A suffix whose
pair is unique has no longer common prefix with any other and leaves the array.

A repeated run counts from ``min_words`` words on. The longest-common-prefix
interval of a suffix at that depth is the group of suffixes with the same first
lines up to that many words; two ranks of the doubling identify it. Members other than the first
one start later copies of a run. Taken from the left and, alike, from
the right, the intervals' runs cover exactly the lines of all later copies of
maximal repeated runs. These lines are deleted; the first copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"


def sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line with a word: ``rid`` (document row), ``doc``, ``raw`` and ``pos`` (its number among all lines, and those with a word), ``stop`` (the last of the blank lines that follow it), ``line`` (ID), ``words``.

    A row is known by its id and text: repeated rows are one document.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("raw"), x.alias("x")))
    full = F.filter(split, lambda s: s["x"].rlike(WORD))
    # explode keeps the lines from being split anew for every use of them
    held = rows.select(F.xxhash64("doc", "text").alias("rid"), "doc", F.size(F.split("text", "\n")).alias("n"), F.explode(F.array(full)).alias("full"))
    stop = lambda i: F.coalesce(F.get("full", i + 1)["raw"], F.col("n")) - 1
    lines = held.select("rid", "doc", F.posexplode(F.transform("full", lambda s, i: F.struct(s["raw"].alias("raw"), stop(i).alias("stop"), s["x"].alias("x")))).alias("pos", "s"))
    return lines.select("rid", "doc", "pos", F.col("s.raw").alias("raw"), F.col("s.stop").alias("stop"), F.xxhash64("s.x").alias("line"), F.regexp_count("s.x", F.lit(WORD)).alias("words")).withColumn("words", F.col("words").cast("int"))


def _ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` that occur twice or more, with ``rank``: their place in the sorted order, as an increasing number."""
    twice = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return materialize(twice.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("rank")))


def _reach(words: np.ndarray, least: int) -> np.ndarray:
    """Lines from each one on until ``least`` words are reached, 0 where the end comes first."""
    total = np.cumsum(words)
    end = np.searchsorted(total, total - words + least, side="left")
    return np.where(end < len(words), end + 1 - np.arange(len(words)), 0)


def _islands(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of neighbouring repeated lines, and how far each line's intervals reach to the right and to the left."""
        for b in batches:
            out = []
            for rid, doc, rows in zip(b["rid"], b["doc"], b["rows"], strict=True):
                got = np.array([(r["pos"], r["raw"], r["words"], r["rank"], r["stop"]) for r in rows], dtype=np.int64)
                cut = np.flatnonzero(np.diff(got[:, 0]) != 1) + 1
                for part in np.split(got, cut):
                    if part[:, 2].sum() < min_words:
                        continue
                    right, left = _reach(part[:, 2], min_words), _reach(part[::-1, 2], min_words)[::-1]
                    out.append(pd.DataFrame({"rid": rid, "doc": doc, "island": part[0, 0], "deep": max(right.max(), left.max()), "pos": part[:, 0], "raw": part[:, 1], "stop": part[:, 4], "right": right, "left": left, "r0": part[:, 3]}))
            if out:
                yield pd.concat(out)

    return run


def _intervals(levels: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each suffix's interval: its length in lines, the two ranks that name it, and its lines."""
        for b in batches:
            out = []
            for rid, doc, rows in zip(b["rid"], b["doc"], b["rows"], strict=True):
                rank = [[r[f"r{k}"] for r in rows] for k in range(levels)]
                seen = set()
                for i, r in enumerate(rows):
                    for s, n in ((i, r["right"]), (i - r["left"] + 1, r["left"])):
                        if n and (s, n) not in seen:
                            seen.add((s, n))
                            k = int(n).bit_length() - 1
                            a, z = rank[k][s], rank[k][s + n - (1 << k)]
                            if a is not None and z is not None:
                                out.append((rid, doc, rows[s]["pos"], rows[s]["raw"], rows[s + n - 1]["stop"], n, a, z))
            yield pd.DataFrame(out, columns=["rid", "doc", "pos", "first", "last", "n", "a", "z"])

    return run


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Spans of lines to delete: ``rid``, ``first``, ``last`` (line numbers, both included)."""
    kind = dict(docs.dtypes)[id_col]
    lines = materialize(sequences(docs, id_col=id_col, text_col=text_col).distinct())
    named = lines.join(_ranks(lines, ["line"]), "line").select("rid", "doc", "pos", "raw", "stop", "words", "rank")
    per_doc = named.groupBy("rid", "doc").agg(F.sort_array(F.collect_list(F.struct("pos", "raw", "stop", "words", "rank"))).alias("rows"))
    table = materialize(per_doc.mapInPandas(_islands(min_words), f"rid long, doc {kind}, island long, deep int, pos int, raw int, stop int, right int, left int, r0 long"))
    deepest = table.agg(F.max("deep")).first()[0] or 0
    levels = 1
    island = Window.partitionBy("rid", "island").orderBy("pos")
    while 1 << levels <= deepest:
        ahead = table.withColumn("on", F.lead(f"r{levels - 1}", 1 << (levels - 1)).over(island))
        pairs = materialize(ahead.where((F.col("deep") >= 1 << levels) & F.col("on").isNotNull() & F.col(f"r{levels - 1}").isNotNull()).select("rid", "island", "pos", F.col(f"r{levels - 1}").alias("here"), "on"))
        met = pairs.join(_ranks(pairs, ["here", "on"]), ["here", "on"]).select("rid", "island", "pos", F.col("rank").alias(f"r{levels}"))
        table = materialize(table.join(met, ["rid", "island", "pos"], "left"))
        levels += 1
    fields = ["pos", "raw", "stop", "right", "left", *(f"r{k}" for k in range(levels))]
    grouped = table.groupBy("rid", "doc", "island").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    found = materialize(grouped.mapInPandas(_intervals(levels), f"rid long, doc {kind}, pos int, first int, last int, n int, a long, z long"))
    order = F.struct(F.col("doc").isNull().alias("absent"), "doc", "rid", "pos")
    heads = materialize(found.groupBy("n", "a", "z").agg(F.min(order).alias("head"), F.count("*").alias("members")).where("members > 1").drop("members"))
    return found.join(heads, ["n", "a", "z"]).where(order > F.col("head")).select("rid", "first", "last").distinct()


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from its text, plus ``n_lines`` and ``n_removed``.

    Copies are ordered by id, then text, then line; a null id comes last. Runs
    may overlap their own copy. Lines are compared whole, by
    64-bit hashes of their bytes; blank lines within a deleted run or after it go with it, those elsewhere stay.
    Null texts stay null with no lines; rows repeated with the same id and text
    are one document and come out alike. Texts of any length are read whole; an empty table gives an empty result. Other columns pass through, and input columns named as the two counts are replaced.
    """
    spans = repeated(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    before = F.max("last").over(Window.partitionBy("rid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("first", F.greatest(F.col("first"), F.coalesce(before + 1, F.lit(0)))).where(F.col("first") <= F.col("last"))
    gone = fresh.groupBy("rid").agg(F.flatten(F.collect_list(F.sequence("first", "last"))).alias("_gone"))
    kept = docs.drop("n_lines", "n_removed")
    columns = kept.columns
    rows = kept.withColumn("_rid", F.xxhash64(id_col, text_col)).join(gone.withColumnRenamed("rid", "_rid"), "_rid", "left")
    lines = F.split(text_col, "\n")
    # Line numbers are subtracted by hash; a search of the deleted ones for each line would grow with the square of a text.
    left_over = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rows = rows.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines)).withColumn("_stay", F.transform(left_over, lambda i: F.get("_lines", i)))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    changed = F.col("_gone").isNotNull()
    return rows.select(
        *(F.when(changed, F.concat_ws("\n", "_stay")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns),
        n_lines.cast("long").alias("n_lines"),
        F.when(changed, F.size("_lines") - F.size("_stay")).otherwise(0).cast("long").alias("n_removed"),
    )
