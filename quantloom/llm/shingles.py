"""Near copies by SimHash and the exact Jaccard similarity of word shingles.

A text's fingerprint is a SimHash of WORDS x 64 bits over its distinct shingles. As in ``simhash``, each word is cut into
sub-grids, PARTS of them, of two-bit segments, and a grid range-join on the segments' bit counts meets what is within radius 1 in one
sub-grid at least: every pair within WORDS * PARTS * 2 - 1 = 55 of the 448 bits, and most beyond. At a similarity of 0.8 two
fingerprints differ in some 68 bits, and 3 pairs in 100,000 meet in none of the 28 sub-grids. What meets is checked exactly
on the CHECKED first words, where 7 pairs in a million at 0.8 differ in more than NEAR of 192 bits.
A pair is linked only if the shingle sets themselves reach the similarity. For that the texts that fingerprints connect form
a bucket: first each is compared with one member, then all that is still apart, in small buckets as pairs,
in crowded ones by tasks over two blocks of texts that emit spanning trees. Large groups of near copies don't become rows of all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quantloom.llm.components import components
from quantloom.llm.simhash import _forest
from quantloom.llm.storage import marked, materialize, small_batches

WORDS, PARTS = 7, 4
CHECKED, NEAR = 3, 52
#: Two-bit segments of a sub-grid, and how many of them tell its groups apart at least: the largest holds 1 in 224 of all rows.
SEGMENTS = 32 // PARTS
LEAST_DEPTH = 3
#: A fingerprint as it is sent to a group: its cell there and the bits that are checked.
ROW = np.dtype([("cell", "<u2"), ("words", "<u8", (CHECKED,))])
#: Fingerprints that are dealt out at once, those that look into a block at once, and those compared with four times as many at once.
DEALT, LOOKING, SIDE = 2048, 1 << 18, 512
#: Shingles whose bits are counted at once; a count fits a byte.
AT_ONCE = 255
#: Buckets of more members are compared in blocks, of so many texts each, over so many shingles at once.
FEW, BLOCK, COLUMNS = 4, 256, 8192
_SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, *, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of all word shingles; a text of fewer words is one shingle, a text with none has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - shingle)].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of bits set in over half of the shingles, each under a hash of its own; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    count = np.zeros(64 * WORDS, dtype=np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        z = _mixed(hashes[k : k + AT_ONCE, None] + _SALTS)
        count += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)


def _names(words: np.ndarray) -> np.ndarray:
    """A long for each row of CHECKED words."""
    out = np.zeros(len(words), dtype=np.uint64)
    for column in words.T:
        out = _mixed((out ^ column) + _SALTS[0])
    return out.view(np.int64)


def sketches(docs: DataFrame, keys: list[str], *, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``keys``, ``sid`` (a hash of the shingle set), ``size``, the fingerprint's ``words`` and ``fid`` (null for none), the name of those that are checked."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keys).schema.add("sid", "long").add("size", "long").add("words", ArrayType(LongType())).add("fid", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t if isinstance(t, str) else None, shingle=shingle) for t in b[text_col]]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            words = [fingerprint(s) for s in sets]
            names = [int(_names(w[None, :CHECKED])[0]) if len(w) else None for w in words]
            yield b[keys].assign(sid=sid, size=[len(s) for s in sets], words=[w.view(np.int64) for w in words], fid=pd.array(names, dtype="Int64"))

    return docs.select(*keys, text_col).mapInPandas(run, schema)


def _trees(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of ``near`` that connect all that it connects, at most one pair for each row and column."""
    rows, columns = near.any(axis=1), near.any(axis=0)
    us, vs = [], []
    while rows.any():
        reached = np.array([int(rows.argmax())])
        rows[reached] = False
        while len(reached):
            new = np.flatnonzero(near[reached].any(axis=0) & columns)
            us.append(reached[near[np.ix_(reached, new)].argmax(axis=0)])
            vs.append(new)
            columns[new] = False
            reached = np.flatnonzero(near[:, new].any(axis=1) & rows)
            us.append(reached)
            vs.append(new[near[np.ix_(reached, new)].argmax(axis=1)] if len(reached) else reached)
            rows[reached] = False
    return np.concatenate(us), np.concatenate(vs)


def _grid(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each fingerprint in each sub-grid, by its first ``depth`` segments, its cell there, and the groups a step up, -1 where a segment has both bits."""
    pairs = np.uint64(0x5555555555555555)
    bits = (words & pairs) + ((words >> np.uint64(1)) & pairs)
    counts = ((bits[:, :, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)).astype(np.int64).reshape(len(words), WORDS * PARTS, SEGMENTS)
    step = 3 ** np.arange(SEGMENTS)
    group = counts[:, :, :depth] @ step[:depth] + 3**depth * np.arange(WORDS * PARTS)
    return group, counts[:, :, depth:] @ step[: SEGMENTS - depth], np.where(counts[:, :, :depth] < 2, group[:, :, None] + step[:depth], -1)


def _ups(cell: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``cell`` and the cells of the same group a step up from theirs."""
    step = 3 ** np.arange(SEGMENTS - depth)
    row, k = np.nonzero(cell[:, None] // step % 3 < 2)
    return row, cell[row] + step[k]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of DEALT rows and more at once."""
    some, n = [], 0
    for b in batches:
        some.append(b.column(0).flatten().to_numpy().reshape(b.num_rows, WORDS).view(np.uint64))
        n += b.num_rows
        if n >= DEALT:
            yield np.concatenate(some)
            some, n = [], 0
    if n:
        yield np.concatenate(some)


def _crowd(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches):
            group, n = np.unique(_grid(words, depth)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(n)], names=["grp", "n"])

    return run


def _deal(depth: int, blocks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packets of rows for each block of a group: of fingerprints left there (role 0), left in another block of it (1), and a step below it (2)."""
        for words in _words(batches):
            group, cell, up = _grid(words, depth)
            who, grid, _ = np.nonzero(up >= 0)
            role = np.repeat([0, 2], [group.size, len(who)])
            cell = np.concatenate((cell.ravel(), cell[who, grid]))
            group, who = np.concatenate((group.ravel(), up[up >= 0])), np.concatenate((np.repeat(np.arange(len(words)), group.shape[1]), who))
            n = blocks[group]
            block = np.zeros(len(group), dtype=np.int64)
            if (n > 1).any():
                mine = (_names(words[:, :CHECKED])[who].view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                group, cell, who, role, mine = (np.repeat(x, n) for x in (group, cell, who, role, mine))
                role[(block != mine) & (role == 0)] = 1
            at = ((group << 20) + block << 2) + role
            order = np.argsort(at, kind="stable")
            at = at[order]
            rows = np.empty(len(at), dtype=ROW)
            rows["cell"], rows["words"] = cell[order], words[who[order], :CHECKED]
            edges = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
            packets = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges * ROW.itemsize), pa.py_buffer(rows)])
            yield pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]]), packets.cast(pa.binary())], names=["at", "rows"])

    return run


def _near(mine: np.ndarray, here: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(mine[:, None, 0] ^ here[None, :, 0])
    for k in range(1, CHECKED):
        bits += np.bitwise_count(mine[:, None, k] ^ here[None, :, k])
    return bits <= NEAR


def _compare(left: np.ndarray, edges: np.ndarray, look: list[tuple[int, np.ndarray]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of near pairs of ``left``, sorted by cell with ``edges`` between cells, and what looks: role 0 and 1 into its own cell and those a step up, role 2 into its own."""
    words = np.concatenate([x["words"] for _, x in look])
    cell = np.concatenate([x["cell"] for _, x in look]).astype(np.int64)
    inside = np.flatnonzero(np.repeat([r < 2 for r, _ in look], [len(x) for _, x in look]))
    row, up = _ups(cell[inside], depth)
    who, cell = np.concatenate((np.arange(len(cell)), inside[row])), np.concatenate((cell, up))
    full = edges[cell + 1] > edges[cell]
    who, cell = who[full], cell[full]
    order = np.argsort(cell, kind="stable")
    who, cell = who[order], cell[order]
    cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
    own = look[0][0] == 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        mine, here = left["words"][edges[cell[a]] : edges[cell[a] + 1]], words[who[a:b]]
        if own and len(here) == 1:  # with itself
            continue
        whole = len(mine) <= SIDE and len(here) <= 4 * SIDE
        for i in range(0, len(mine), SIDE):
            for j in range(0, len(here), 4 * SIDE):
                x, y = mine[i : i + SIDE], here[j : j + 4 * SIDE]
                near = _near(x, y)
                hits = np.count_nonzero(near)
                if hits <= (len(mine) if own and whole else 0):  # each with itself
                    continue
                p, q = np.nonzero(near) if hits <= 8 * sum(near.shape) else _trees(near)
                yield _names(x)[p], _names(y)[q]


def _meet(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packets sorted by ``at``: group and block, then role. A block's own rows are held, what looks into it comes in parts."""
        us, vs, found = [], [], 0

        def links() -> pa.RecordBatch:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us.clear()
            vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        packets = ((at, np.frombuffer(x.as_buffer(), dtype=ROW)) for b in batches for at, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for _, unit in groupby(packets, lambda x: x[0] >> 2):
            left, edges, look, n = None, None, [], 0
            for role, rows in chain(((at & 3, x) for at, x in unit), [(-1, None)]):
                if role == 0:
                    look.append((0, rows))
                    continue
                if left is None:
                    if not look:  # nothing is left in this block
                        break
                    left = np.concatenate([x for _, x in look])
                    left = left[np.argsort(left["cell"], kind="stable")]
                    edges = np.searchsorted(left["cell"], np.arange(3 ** (SEGMENTS - depth) + 1))
                if role > 0:
                    look.append((role, rows))
                    n += len(rows)
                if look and (role < 0 or n >= LOOKING):
                    for u, v in _compare(left, edges, look, depth):
                        us.append(u)
                        vs.append(v)
                        found += len(u)
                        if found > 1 << 19:
                            yield links()
                            found = 0
                    look, n = [], 0
        if us:
            yield links()

    return run


def near_fingerprints(prints: DataFrame, *, block: int = 1 << 19, depth: int | None = None) -> DataFrame:
    """Edges ``u``, ``v`` between names (``fid``) of fingerprints that meet in a sub-grid and differ in at most NEAR bits of those checked; trees, not all pairs.

    ``prints`` has ``fid`` and ``words``, each name once. A sub-grid is dealt out in groups by its first ``depth`` segments, as many as bring the mean group to half a block, LEAST_DEPTH at least;
    only steps in these segments send a fingerprint to other groups, those in the rest are taken where the group lies.
    A group with more than ``block`` fingerprints of its own is dealt out in blocks; the driver gets the counts of such groups.
    """
    if depth is None:
        n = prints.count()
        depth = next((d for d in range(LEAST_DEPTH, SEGMENTS) if n * 0.375**d <= block / 2), SEGMENTS)
    # A file of fingerprints is small, but each becomes some 28 * (1 + 0.75 * depth) rows: they are dealt out before, not after.
    words = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fid").select("words")
    small_batches(prints.sparkSession)
    blocks = np.ones(WORDS * PARTS * 3**depth, dtype=np.int64)
    for r in prints.select("words").mapInArrow(_crowd(depth), "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") > block).toLocalIterator():
        blocks[r.grp] = -(-r.n // block)
    dealt = words.mapInArrow(_deal(depth, blocks), "at long, rows binary")
    return dealt.repartition(F.shiftright("at", 2)).sortWithinPartitions("at").mapInArrow(_meet(depth), "u long, v long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t if isinstance(t, str) else None, shingle=shingle) for t in b["text"]]
            yield pd.DataFrame({"sid": b["sid"], "hashes": [s.view(np.int64) for s in sets]})

    return materialize(texts.mapInPandas(run, "sid long, hashes array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x, y = sets.select(F.col("sid").alias("u"), F.col("hashes").alias("x")), sets.select(F.col("sid").alias("v"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "u").join(y, "v").where(shared * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("u", "v")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(common):
        return out.astype(np.int64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        return owner[hit], at[hit]

    (a, p), (b, q) = places(left), places(right)
    for k in range(0, len(common), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), dtype=np.float32), np.zeros((len(right), COLUMNS), dtype=np.float32)
        mine, yours = (p >= k) & (p < k + COLUMNS), (q >= k) & (q < k + COLUMNS)
        x[a[mine], p[mine] - k] = 1
        y[b[yours], q[yours] - k] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _crowded(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different roots in buckets of many members, dealt out in pairs of blocks; trees, not all pairs."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = members.withColumn("k", blocks).withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
    units = mine.select("bucket", "sid", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    units = units.select("bucket", "sid", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        left, right = b[b["mine"] == b["i"]], b[b["mine"] == b["j"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": np.zeros(0, dtype=np.int64), "v": np.zeros(0, dtype=np.int64)})
        shared = overlaps(list(left["hashes"]), list(right["hashes"]))
        sizes = left["hashes"].map(len).to_numpy()[:, None] + right["hashes"].map(len).to_numpy()[None, :]
        near = shared * (100 + percent) >= sizes * percent
        near &= left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
        x, y = np.nonzero(near)
        u, v = _forest(left["sid"].to_numpy()[x], right["sid"].to_numpy()[y])
        return pd.DataFrame({"u": u, "v": v})

    return units.join(sets, "sid").groupBy("bucket", "i", "j").applyInPandas(run, "u long, v long")


def classes(docs: DataFrame, prints: DataFrame, *, rid: Column, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``sid`` and ``root`` of every shingle set of ``prints``: one root for all that links of ``percent`` similarity or more connect.

    ``prints`` is what ``sketches`` returns with ``rid``; the expression ``rid`` over ``docs`` finds the texts of candidates again.
    NEAR is right for a ``percent`` of 80 or more.
    """
    distinct = materialize(prints.groupBy("sid").agg(F.min("rid").alias("rid"), F.min("size").alias("size"), F.any_value("words").alias("words"), F.any_value("fid").alias("fid")))
    names = materialize(distinct.where("fid is not null").groupBy("fid").agg(F.any_value("words").alias("words")))
    joined = components(materialize(near_fingerprints(names))).select(F.col("node").alias("fid"), F.col("root").alias("bucket"))
    placed = distinct.where("fid is not null").select("sid", "rid", "size", "fid").join(joined, "fid", "left").withColumn("bucket", F.coalesce("bucket", "fid"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = materialize(placed.join(full, "bucket").select("bucket", "sid", "rid", "size"))
    wanted = members.select(F.col("rid").alias("_rid"), "sid")
    texts = marked(docs.select(rid.alias("_rid"), "text"), "_rid", wanted, "_maybe").where("_maybe").join(wanted, "_rid")
    sets = _sets(texts.groupBy("_rid").agg(F.any_value("sid").alias("sid"), F.any_value("text").alias("text")), shingle)
    near = F.least("size", "size2") * 100 >= F.greatest("size", "size2") * percent
    pair = F.least("sid", "sid2").alias("u"), F.greatest("sid", "sid2").alias("v")

    hub = members.groupBy("bucket").agg(F.min(F.struct("sid", "size")).alias("hub"))
    hub = hub.select("bucket", F.col("hub.sid").alias("sid2"), F.col("hub.size").alias("size2"))
    pairs = materialize(members.join(hub, "bucket").where("sid <> sid2").where(near).select(*pair))
    found = materialize(_verified(pairs, sets, percent))

    roots = components(found).withColumnRenamed("node", "sid")
    rooted = materialize(members.join(roots, "sid", "left").select("bucket", "sid", "size", F.coalesce("root", "sid").alias("root")))
    several = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("n > 2 and a <> b").select("bucket", "n")
    apart = materialize(rooted.join(several, "bucket"))
    few = apart.where(F.col("n") <= FEW)
    other = few.select("bucket", F.col("sid").alias("sid2"), F.col("size").alias("size2"), F.col("root").alias("root2"))
    rest = few.join(other, "bucket").where("sid < sid2 and root <> root2").where(near).select(*pair).join(pairs, ["u", "v"], "left_anti")
    found = materialize(found.union(_verified(materialize(rest), sets, percent)).union(_crowded(apart.where(F.col("n") > FEW), sets, percent)))
    roots = components(found).withColumnRenamed("node", "sid")
    return distinct.select("sid").join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"))
