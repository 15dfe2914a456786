"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token ids, longer ones are cut into pieces of the sequence
length. Packing is decided on the histogram of piece lengths alone, which is
bounded by the sequence length: patterns of a few lengths that fill a
sequence are enumerated, non-negative least squares fits their repeat counts
to the histogram, the counts are rounded down to what the histogram has, and the residual is
packed best-fit. Pieces then get their place by their rank among the pieces of
their length, counted over the partitions of the written piece table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.storage import materialize, small_batches

SPECIAL = "<|endoftext|>"
#: The faster reader's pattern matcher gives up on runs of some 100,000 blanks; texts with runs a fifth as long don't go there.
_BLANKS = re.compile(r"\s{20000}")
_encoders: dict[str, object] = {}


def encoder(path: str, ranks_path: str | None):
    """Text to ids of the tokenizers file at ``path``; ``ranks_path``, the same vocabulary as ranks, serves a faster reader of it."""

    def slow() -> object:
        if path not in _encoders:
            import tokenizers

            _encoders[path] = tokenizers.Tokenizer.from_file(path)
        return _encoders[path]

    def fast() -> object:
        if ranks_path not in _encoders:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _encoders[ranks_path] = tiktoken.Encoding("quantloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _encoders[ranks_path]

    def run(text: str) -> list[int]:
        if ranks_path is None or SPECIAL in text or (len(text) >= 20_000 and _BLANKS.search(text)):
            return slow().encode(text, add_special_tokens=False).ids
        return fast().encode_ordinary(text)

    return run


def pieces(docs: DataFrame, *, path: str, ranks_path: str | None = None, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, on demand, ``ids`` of every piece.

    Null texts are empty: one piece that holds the end id only. Texts of any
    length are read whole and cut from the end on, so that only the first piece may be shorter.
    Repeated rows come out alike; other columns of ``docs`` are not looked at.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, ranks_path)
        for b in batches:
            rows = []
            for i, text in zip(b[id_col].astype(object), b[text_col], strict=True):
                ids = np.array([*encode(text if isinstance(text, str) else ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % length + 1
                edges = [0, *range(first, len(ids) + 1, length)]
                for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((None if pd.isna(i) else i, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), *([ids[s:e].astype(np.int32)] if with_ids else ())))
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(id_col, text_col).mapInPandas(run, schema)


def patterns(length: int, depth: int = 3, step: int = 16) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` lengths that sum to ``length``: all pairs, and of deeper ones those on a grid of ``step``."""
    found = [(length,), *((a, length - a) for a in range(1, length // 2 + 1))]

    def deeper(rest: int, most: int, left: int, head: tuple[int, ...]) -> None:
        if left == 1:
            if 0 < rest <= most:
                found.append((*head, rest))
            return
        for x in range(min(most, rest - 1) // step * step, 0, -step):
            if x * left < rest:
                break
            deeper(rest - x, x, left - 1, (*head, x))

    for d in range(3, depth + 1):
        deeper(length, length, d, ())
    return found


def fit_counts(hist: np.ndarray, pats: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: counts x >= 0 with A x near ``hist`` (A: lengths in patterns). Longer lengths weigh more."""
    rows = np.concatenate([np.array(p) for p in pats])
    cols = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    weight = np.sqrt(np.arange(len(hist), dtype=float) + 1)
    goal = hist * weight

    def ax(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=x[cols], minlength=len(hist)) * weight

    def at(r: np.ndarray) -> np.ndarray:
        return np.bincount(cols, weights=(r * weight)[rows], minlength=len(pats))

    v = np.ones(len(pats))
    for _ in range(20):
        v = at(ax(v))
        v /= np.linalg.norm(v)
    lip = np.linalg.norm(at(ax(v)))
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - at(ax(y) - goal) / lip)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, together exactly the pieces of ``hist`` (pieces of each length, by index)."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int) -> int:
        lens, need = np.unique(pattern, return_counts=True)
        n = int(min(most, (left[lens] // need).min()))
        if n > 0:
            left[lens] -= need * n
            out.append((pattern, n))
        return n

    take((length,), int(left[length]))
    if left.sum():
        pats = patterns(length)
        x = fit_counts(left.astype(float), pats)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            take(pats[i], int(np.floor(x[i] + 0.5)))
    # The residual, best fit: the longest piece left, then always the longest that still fits.
    while left.sum():
        room, pattern, use = length, [], left.copy()
        while room > 0 and (fits := np.flatnonzero(use[: room + 1])).size:
            x = int(fits[-1])
            pattern.append(x)
            use[x] -= 1
            room -= x
        take(tuple(pattern), int(left.sum()))
    return out


def best_fit(hist: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """The residual step alone, as a yardstick."""
    left, out = hist.astype(np.int64).copy(), []
    while left.sum():
        room, pattern, use = length, [], left.copy()
        while room > 0 and (fits := np.flatnonzero(use[: room + 1])).size:
            x = int(fits[-1])
            pattern.append(x)
            use[x] -= 1
            room -= x
        lens, need = np.unique(pattern, return_counts=True)
        n = int((left[lens] // need).min())
        left[lens] -= need * n
        out.append((tuple(pattern), n))
    return out


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, runs of ranks: where a run begins, its first sequence, the offset, and pieces of this length in a row at this pattern's slot."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at: dict[int, int] = {}
    sequence = 0
    for pattern, n in packed:
        offset = 0
        for x in pattern:
            rows.setdefault(x, []).append((at.get(x, 0), sequence, offset))
            at[x] = at.get(x, 0) + n
            offset += x
        sequence += n
    return {x: dict(zip(("rank", "sequence", "offset"), np.array(r, dtype=np.int64).T, strict=True)) for x, r in rows.items()}


def pack(docs: DataFrame, *, path: str, ranks_path: str | None = None, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all rows with ``sequence_id`` and ``offset``: pieces of a sequence follow each other without gaps from 0.

    Every row is packed, repeats included; null or empty texts are the end id
    alone, long ones several pieces. Pieces of one length take their places in
    the order of the written table's parts, then of id and piece. An empty
    table gives an empty result; other columns of ``docs`` are not looked at.
    """
    made = pieces(docs, path=path, ranks_path=ranks_path, length=length, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    table = materialize(made.withColumn("part", F.spark_partition_id()))
    counts = materialize(table.groupBy("length", "part").agg(F.count("*").alias("n")))
    hist = np.zeros(length + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    place = slots(plan(hist, length))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    schema = table.drop("part").schema.add("sequence_id", "long").add("offset", "long")
    columns = [f.name for f in table.schema if f.name != "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by part and length; a length's rank goes on within a part from where the parts before it end."""
        last, seen = (-1, -1), 0
        for b in batches:
            if not len(b):
                continue
            part, lens, before = (b[k].to_numpy() for k in ("part", "length", "before"))
            seq, off = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(part) != 0) | (np.diff(lens) != 0)) + 1, [len(b)]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if (part[a], lens[a]) != last:
                    last, seen = (part[a], lens[a]), 0
                rank = before[a] + seen + np.arange(z - a)
                seen += z - a
                runs = place[int(lens[a])]
                k = np.searchsorted(runs["rank"], rank, side="right") - 1
                seq[a:z], off[a:z] = runs["sequence"][k] + rank - runs["rank"][k], runs["offset"][k]
            yield b[columns].assign(sequence_id=seq, offset=off)

    dealt = table.join(ranked, ["part", "length"]).repartition("part", "length").sortWithinPartitions("part", "length", id_col, "piece")
    return dealt.mapInPandas(run, schema)
