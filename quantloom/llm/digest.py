"""Document fingerprints: improbable-feature digests in chained Bloom filters.

Every window of WINDOW bytes gets its Shannon entropy. How rare that entropy is among
all windows of the corpus ranks the window, windows of one rank being told apart by a hash of their
bytes. The most improbable window of each neighbourhood of NEAR windows is a feature of the text;
at both ends neighbourhoods are as short as one window, and a text shorter than a window is filled
up with zero bytes, so every text but the empty one has a feature. A text's distinct
features go, in the order in which they appear, into a chain of Bloom filters of fixed size,
CAPACITY features each. Likeness compares bits in common with those expected by
chance, normalised to 0..1.

All windows of a batch are handled at once: an arriving or leaving byte changes
the entropy by a table value of its count in the window, and the counts are
sums of byte comparisons at the distances 1 to WINDOW - 1.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quantloom.llm.storage import map_texts, small_batches

WINDOW, NEAR = 16, 24
#: Entropies are told apart in so many steps.
STEPS = 512
FILTER_BYTES, CAPACITY, HASHES = 256, 256, 4
#: Bytes handled at once, and of one long text; a longer text is handled in overlapping parts.
PIECE = 1 << 20
_UNIT = 1 << 16
_NLOGN = np.array([0] + [round(n * math.log2(n) * _UNIT) for n in range(1, WINDOW + 2)], dtype=np.int32)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A window's key: its rank above, a hash of its bytes below.
_HASH_BITS = np.uint64(55)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy step (0 to STEPS - 1) of the window at each byte; needs WINDOW bytes at least."""
    n = len(data)
    after, before = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    same = np.empty(n, dtype=bool)
    for d in range(1, WINDOW):
        np.equal(data[d:], data[:-d], out=same[: n - d])
        after[: n - d] += same[: n - d]
        before[d:] += same[: n - d]
    windows = n - WINDOW + 1
    total = np.empty(windows, dtype=np.int64)
    total[0] = _NLOGN[np.bincount(data[:WINDOW], minlength=256)].sum()
    gone, come = after[: windows - 1], before[WINDOW:]
    step = (_NLOGN[come + np.uint8(1)] - _NLOGN[come]).astype(np.int64) - (_NLOGN[gone + np.uint8(1)] - _NLOGN[gone])
    np.cumsum(step, out=step)
    total[1:] = total[0] + step
    top = math.log2(WINDOW)
    value = top - total / (WINDOW * _UNIT)
    return np.clip((value * ((STEPS - 1) / top)).round(), 0, STEPS - 1).astype(np.int32)


def _filled(raw: bytes) -> bytes:
    """A text of at least one whole window; the empty one stays empty."""
    return raw.ljust(WINDOW, b"\0") if raw else raw


@dataclass
class _Row:
    """Texts laid in a row: their numbers, where their windows begin, how many these are, and the same of their neighbourhoods."""

    data: np.ndarray
    texts: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    begin: np.ndarray
    count: np.ndarray


def _rows(raws: Sequence[bytes]) -> Iterator[_Row]:
    """About PIECE bytes at once, with NEAR zero bytes before and after each text. A longer text comes alone, in parts that overlap by a neighbourhood and a window."""
    gap, part, size = bytes(NEAR), [], 0

    def flush() -> _Row:
        texts = [_filled(raws[i]) for i in part]
        lengths = np.array([len(t) for t in texts])
        first = np.cumsum(lengths + NEAR) - lengths
        windows = np.maximum(lengths - WINDOW + 1, 0)
        count = np.where(windows > 0, windows + NEAR - 1, 0)
        return _Row(np.frombuffer(gap + b"".join(t + gap for t in texts), dtype=np.uint8), np.array(part), first, windows, first - NEAR + 1, count)

    for i, raw in enumerate(raws):
        if part and size + len(raw) > PIECE:
            yield flush()
            part, size = [], 0
        if len(raw) > PIECE:
            total = len(raw) - WINDOW + 1
            for k in range(0, total, PIECE):
                piece = raw[k : k + PIECE + WINDOW + NEAR - 2]
                begin = NEAR if k else 1
                end = NEAR + (PIECE if k + PIECE < total else total - k)
                yield _Row(np.frombuffer(gap + piece + gap, dtype=np.uint8), *(np.array([x]) for x in (i, NEAR, len(piece) - WINDOW + 1, begin, end - begin)))
            continue
        part.append(i)
        size += len(raw) + NEAR
    if part:
        yield flush()


def _inside(first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Whether each place lies in one of the runs of ``count`` places from ``first`` on."""
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count, -1)
    return np.cumsum(edge)[:size] > 0


def histogram(raws: Sequence[bytes]) -> np.ndarray:
    """Windows at each entropy step over all texts."""
    out = np.zeros(STEPS, dtype=np.int64)
    for row in _rows(raws):
        at = entropies(row.data)
        own = np.minimum(row.windows, PIECE)  # what parts of a long text share is counted in the later one
        out += np.bincount(at[_inside(row.first, own, len(at))], minlength=STEPS)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy step, 0 for the rarest; steps that never occur come last."""
    order = np.lexsort((np.arange(STEPS), np.where(counts > 0, counts, np.iinfo(np.int64).max)))
    out = np.empty(STEPS, dtype=np.int64)
    out[order] = np.arange(STEPS)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _keys(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Key of the window at each byte: smaller is rarer; equal keys are equal windows."""
    n = len(data) - WINDOW + 1
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = _mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(WINDOW))
    h = _mixed((h ^ words[8 : 8 + n]) * np.uint64(0x9E3779B97F4A7C15))
    return (rank[entropies(data)].astype(np.uint64) << _HASH_BITS) | (h >> (np.uint64(64) - _HASH_BITS))


def _rarest(key: np.ndarray) -> np.ndarray:
    """The smallest key of each NEAR neighbours in a row."""
    size = 1
    while size * 2 <= NEAR:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (NEAR - size)], key[NEAR - size :]) if size < NEAR else key


def features(raws: Sequence[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Keys of the distinct features of each text, in the order in which they appear first."""
    found: list[list[np.ndarray]] = [[] for _ in raws]
    for row in _rows(raws):
        key = _keys(row.data, rank)
        key[~_inside(row.first, row.windows, len(key))] = _NONE
        low = _rarest(key)
        fresh = np.ones(len(low), dtype=bool)
        fresh[1:] = low[1:] != low[:-1]
        fresh[row.begin[row.count > 0]] = True
        at = np.flatnonzero(fresh & _inside(row.begin, row.count, len(low)))
        bounds = np.searchsorted(at, np.concatenate((row.begin, [len(low)])))
        for k, i in enumerate(row.texts):
            found[i].append(low[at[bounds[k] : bounds[k + 1]]])
    out = []
    for parts in found:
        every = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        _, nth = np.unique(every, return_index=True)
        out.append(every[np.sort(nth)])
    return out


def digests(raws: Sequence[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Chain of filters of each text, uint8 (filters, FILTER_BYTES); the empty text's only filter has no bit."""
    found = features(raws, rank)
    h = _mixed(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64))
    filters = np.array([max(1, -(-len(f) // CAPACITY)) for f in found], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(filters)))
    nth = np.concatenate([b + np.arange(len(f)) // CAPACITY for b, f in zip(base, found, strict=False)] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    bits = np.zeros((base[-1], FILTER_BYTES * 8), dtype=bool)
    for k in range(HASHES):
        bits[nth, (h >> np.uint64(11 * k)) & np.uint64(FILTER_BYTES * 8 - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:z] for a, z in zip(base[:-1], base[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of either chain against its best match in the other, weighed by its bits. Both empty: 1, one empty: 0."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    p, q = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    na, nb = np.bitwise_count(p).sum(axis=1, dtype=np.int64), np.bitwise_count(q).sum(axis=1, dtype=np.int64)
    if not na.sum() or not nb.sum():
        return 0.0
    here, there = np.zeros(len(p)), np.full(len(q), -np.inf)  # a best match may share less than chance, either way
    for i in range(len(p)):
        shared = np.bitwise_count(p[i] & q).sum(axis=1, dtype=np.int64)
        chance = na[i] * nb / (FILTER_BYTES * 8)
        room = np.minimum(na[i], nb) - chance
        part = np.where(room > 0, (shared - chance) / np.maximum(room, 1e-9), 0.0)
        here[i] = part.max()
        np.maximum(there, part, out=there)
    return float(np.clip(((here * na).sum() + (there * nb).sum()) / (na.sum() + nb.sum()), 0, 1))


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def _raws(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def corpus_ranks(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Rarity of each entropy step over all windows of all texts: STEPS counts, summed on the executors."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS, dtype=np.int64)
        for b in batches:
            total += histogram(_raws(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS, dtype=np.int32)), pa.array(total)], names=["step", "n"])

    counts = np.zeros(STEPS, dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r["step"]] = r["n"]
    return ranks(counts)


def fingerprint(docs: DataFrame, rank: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """Add ``fingerprint`` to ``docs`` (an input column of this name is replaced); null texts count as empty, equal texts have equal fingerprints."""
    added = StructType().add("fingerprint", "string")
    return map_texts(docs, [c for c in docs.columns if c != "fingerprint"], text_col, added, lambda texts: [[encode(x) for x in digests(_raws(texts), rank)]])


def _at_most(bound: Column, id_: Column, h: Column) -> Column:
    """Whether the bound comes no later than a row, by descending id, nulls last, then hash."""
    with_id = bound["id"].isNotNull() & ((bound["id"] > id_) | ((bound["id"] == id_) & (bound["h"] <= h)))
    return F.coalesce(F.when(id_.isNull(), bound["id"].isNotNull() | (bound["h"] <= h)).otherwise(with_id), F.lit(False))


def in_order(docs: DataFrame, *, id_col: str, text_col: str, rows_per_range: int = 4096) -> DataFrame:
    """``id``, ``text``, ``extra`` dealt by ranges of descending id (nulls last, equal ids by a hash of the text), sorted, each range followed by the next one's first row (``extra``).

    A range is a partition. Its bound, its first row's id and hash, comes of a sort of ids and
    hashes alone, so a null or repeated id is split like any other; rows equal in both stay together. The bounds are
    one for ``rows_per_range`` rows, looked up in two steps. Ids are of any type that Spark orders. The last range is followed by the first row of all.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = F.col("id").desc_nulls_last(), F.col("h").asc()
    n = docs.count()
    ranges = max(1, math.ceil(n / rows_per_range), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 64))
    keys = rows.select("id", "h").repartitionByRange(ranges, *order).select("id", F.bitwise_not("h").alias("g"), F.spark_partition_id().alias("range"))
    firsts = keys.groupBy("range").agg(F.max(F.struct("id", "g")).alias("x")).orderBy("range").collect()
    kind = dict(rows.dtypes)["id"]
    bounds = [(r["x"]["id"], ~r["x"]["g"]) for r in firsts]
    wide = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[k : k + wide] for k in range(0, len(bounds), wide)] or [[]]

    def ladder(part: list[tuple]) -> Column:
        return F.array(*(F.struct(F.lit(i).cast(kind).alias("id"), F.lit(h).cast("long").alias("h")) for i, h in part)).cast(f"array<struct<id:{kind},h:bigint>>")

    def passed(part: Column) -> Column:
        """The number of the last bound that comes no later than the row."""
        return F.greatest(F.size(F.filter(part, lambda x: _at_most(x, F.col("id"), F.col("h")))) - 1, F.lit(0))

    dealt = rows.withColumn("block", passed(ladder([b[0] for b in blocks if b])))
    dealt = dealt.withColumn("part", F.get(F.array(*map(ladder, blocks)), F.col("block"))).withColumn("nth", passed(F.col("part")))
    dealt = dealt.withColumn("range", F.col("block") * wide + F.col("nth"))
    bound = F.get("part", F.col("nth"))
    heads = dealt.where(bound["id"].eqNullSafe(F.col("id")) & (bound["h"] == F.col("h"))).groupBy("range", "id").agg(F.min("text").alias("text"))
    tails = heads.select("id", "text", F.pmod(F.col("range") - 1, F.lit(max(1, len(bounds)))).alias("range"), F.lit(True).alias("extra"), F.lit(0).cast("long").alias("h"))
    every = dealt.select("id", "text", "range", F.lit(False).alias("extra"), "h").unionByName(tails)
    return every.repartitionById(max(1, len(bounds)), F.col("range").cast("int")).sortWithinPartitions("extra", *order, "text").select("id", "text", "extra")


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness, and that to the next document by descending id.

    Null texts count as empty; two empty ones are alike (1). Rows of one id are ordered by a hash of their
    text, null ids come last, and the first document follows the last. Long texts are read whole. Other columns are not looked at; an empty table gives an empty result.
    Returns ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    rank = corpus_ranks(docs, text_col=text_col)
    rows = in_order(docs, id_col=id_col, text_col=text_col)
    schema = docs.select(F.col(id_col)).schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, kind)
    arrow = to_arrow_schema(schema)

    def emit(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """Rows of all texts but the last, which follows them."""
        raws = _raws(texts)
        raws2 = _raws([edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)])
        one, two = digests(raws, rank), digests(raws2, rank)
        columns = [
            ids.cast(arrow.field(0).type), [len(t) for t in texts[:-1]], [hashlib.sha256(r).hexdigest() for r in raws2], [encode(x) for x in one[:-1]], [encode(x) for x in two],
            [likeness(a, b) for a, b in zip(one, two, strict=False)], [likeness(a, b) for a, b in zip(one[:-1], one[1:], strict=True)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) if isinstance(c, list) else c for c, t in zip(columns, arrow, strict=True)], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, over = [], [], 0, False
        for b in batches:
            for k, (text, extra) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if over:  # the next range's first row came already
                    break
                if texts and (extra or size >= PIECE):
                    yield emit(pa.concat_arrays(ids), [*texts, text])
                    ids, texts, size = [], [], 0
                over = extra
                if not extra:
                    ids.append(b.column(0).slice(k, 1))
                    texts.append(text)
                    size += len(text)

    return rows.mapInArrow(run, schema)
