"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into segments of two bits; the bit counts of the
segments embed it in a small grid, where the Manhattan distance never exceeds the Hamming
distance. The segments form two sub-grids with radii that add up to ``max_bits - 1``: two
fingerprints within ``max_bits`` are within the radius in one of them at least. The grid
range-join meets at radius 1 each fingerprint's own cell and, one way only, the cells
next to it; at radius 2 both sides go one step, as two points at distance 2 have a
cell between them. So few rows are joined, and about eight in a hundred thousand of all
pairs meet; each of these is verified exactly on all 64 bits. Only distinct
fingerprints are joined, and a task emits the links of what it met as spanning
trees, so that large groups of near copies never become all their pairs. Crowded
cells are dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.components import components
from quantloom.llm.storage import materialize, small_batches

BITS = 64
#: Pairs that a task compares at once.
AT_ONCE = 1 << 19


def fingerprint(text: str | None, *, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of all word shingles, repeats included; 0 for no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    count = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keys: list[str], *, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint as a signed long, for every row."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keys).schema.add("fp", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = [fingerprint(t if isinstance(t, str) else None, shingle=shingle) for t in b[text_col]]
            yield b[keys].assign(fp=np.array(fps, dtype=np.uint64).view(np.int64))

    return docs.select(*keys, text_col).mapInPandas(run, schema)


def _segments(parts: int) -> list[list[tuple[int, int]]]:
    """(first bit, width) of the segments of each sub-grid."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [[(s, min(2, b - s)) for s in range(a, b, 2)] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _radii(max_bits: int, parts: int) -> list[int]:
    """The distance looked at in each sub-grid. More than ``max_bits`` differing bits are needed to be beyond all of them."""
    total = max_bits + 1 - parts
    radii = [total // parts + (g < total % parts) for g in range(parts)]
    if min(radii) < 0 or max(radii) > 2:
        raise ValueError("max_bits needs another number of sub-grids")
    return radii


def _cells(max_bits: int, parts: int) -> list[tuple[Column, Column, Column]]:
    """For each sub-grid the own cell of ``fp``, the cells where it is met, and those that it only looks into."""
    out, base = [], 0
    for segments, radius in zip(_segments(parts), _radii(max_bits, parts), strict=True):
        at = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))).cast("long") for s, w in segments]
        own = F.lit(base).cast("long")
        for i, x in enumerate(at):
            own = own + x * F.lit(3**i).cast("long")
        base += 3 ** len(segments)
        up = F.array_compact(F.array(*(F.when(x < w, own + F.lit(3**i).cast("long")) for i, (x, (_, w)) in enumerate(zip(at, segments, strict=True)))))
        down = F.array_compact(F.array(*(F.when(x > 0, own - F.lit(3**i).cast("long")) for i, x in enumerate(at))))
        none = F.array().cast("array<long>")
        out.append((own, F.concat(F.array(own), up, down) if radius == 2 else F.array(own), up if radius == 1 else none))
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to one node of each component, in place of all of its edges."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            break
        top = new
    moved = top != np.arange(len(nodes))
    return nodes[moved], nodes[top[moved]]


def _meet(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by cell, block and role, left rows (0) first. The left rows of an unfinished block are carried on."""
        old_key, old = (-1, -1), np.zeros(0, dtype=np.uint64)
        for b in batches:
            if not len(b):
                continue
            cell, block, role = (b[k].to_numpy() for k in ("cell", "block", "role"))
            fp = b["fp"].to_numpy().view(np.uint64)
            if (cell[0], block[0]) != old_key:
                old = old[:0]
            new = np.concatenate(([True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])))
            key = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            left = np.bincount(key, weights=role == 0, minlength=len(first)).astype(np.int64)
            everyone = np.concatenate((old, fp))
            begin, end = first + len(old), first + len(old) + left
            begin[0] = 0  # with what is carried on
            if len(old) and left[0] == 0:
                end[0] = len(old)
            row = np.arange(len(fp)) + len(old)
            until = np.minimum(end[key], row)
            many = until - begin[key]
            us, vs = [], []
            bounds = np.cumsum(many)
            i = 0
            while i < len(fp):
                j = max(i + 1, int(np.searchsorted(bounds, (bounds[i - 1] if i else 0) + AT_ONCE, side="right")))
                m = many[i:j]
                mine = np.repeat(np.arange(i, j), m)
                nth = np.arange(len(mine)) - np.repeat(np.cumsum(m) - m, m)
                other = everyone[begin[key[mine]] + nth]
                near = np.bitwise_count(fp[mine] ^ other) <= max_bits
                if near.any():
                    u, v = _forest(fp[mine[near]], other[near])
                    us.append(u)
                    vs.append(v)
                i = j
            k = len(first) - 1
            old_key, old = (cell[-1], block[-1]), everyone[begin[k] : end[k]]
            if us:
                u, v = _forest(np.concatenate(us), np.concatenate(vs))
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def links(distinct: DataFrame, *, max_bits: int = 4, parts: int = 2, block: int = 4096) -> DataFrame:
    """Edges ``u``, ``v`` that connect what is within ``max_bits`` among the distinct ``fp``; trees, not all pairs.

    A cell with more than ``block`` fingerprints is dealt out; the count leaves out what thin cells next to it add, ``block`` at most.
    """
    cells = _cells(max_bits, parts)
    met, seen = F.concat(*(m for _, m, _ in cells)), F.concat(*(s for _, _, s in cells))
    # A file of fingerprints is small, but each becomes some 38 rows: they are dealt out before, not after.
    dealt_out = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = dealt_out.select("fp", F.explode(F.concat(F.transform(met, lambda c: F.struct(c.alias("cell"), F.lit(0).alias("role"))), F.transform(seen, lambda c: F.struct(c.alias("cell"), F.lit(1).alias("role"))))).alias("x")).select("fp", "x.cell", "x.role")
    thin = block // (BITS + 1)
    full = distinct.select("fp", F.posexplode(F.array(*(o for o, _, _ in cells))).alias("grid", "own")).groupBy("grid", "own").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).where(F.col("n") > thin)
    spread = full.select("n", F.explode(F.get(F.array(*(m for _, m, _ in cells)), F.col("grid"))).alias("cell"))
    crowded = materialize(spread.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    rows = rows.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.select("fp", "cell", "role", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = dealt.select("fp", "cell", "block", F.when((F.col("role") == 0) & (F.col("block") == F.col("mine")), 0).otherwise(1).cast("byte").alias("role"))
    return dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "role").mapInPandas(_meet(max_bits), "u long, v long")


def classes(prints: DataFrame, *, id_col: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """Add ``component_id``, the smallest ``id_col`` reachable over links, to rows with ``fp``."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(links(distinct, max_bits=max_bits)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = materialize(placed.groupBy("root").agg(F.min("low").alias("component_id")))
    known = materialize(placed.join(lowest, "root").select("fp", "component_id"))
    return prints.join(known, "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row, repeats included.

    Null texts and texts with no word have fingerprint zero and are linked like
    any other; a null id is never the smallest unless all ids of its component
    are null. A bit set in exactly half of the hashes is 0. Texts of any length are read whole; other columns
    are not looked at, and an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, [id_col], text_col=text_col, shingle=shingle))
    return classes(prints, id_col=id_col, max_bits=max_bits).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
