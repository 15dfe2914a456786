"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes a vector of document statistics. Random Fourier features
approximate a Gaussian kernel over the standardised statistics. Each partition
sums its share of the normal equations; the shares are added row by row of the
matrix on the executors and only the final D x D system reaches the driver. The
ridge scores are binned on a fixed grid, so that the isotonic fit (pool adjacent
violators) is bounded too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quantloom.llm.storage import materialize, small_batches

#: Classes of ASCII characters; bytes from 128 on are counted as letters' bytes.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".?!", "loud": b"!", "comma": b",;:", "symbol": b"#*$%&|<>^~=+_\\/", "bar": b"|", "mark": b"#*$%&<>", "quote": b"\"'`()[]{}", "at": b"@", "high": bytes(range(128, 256))}
FEATURES = ("log_bytes", "log_words", "mean_word", "unique_words", "unique_lines", "words_per_line", "top_word", "short_words", *(f"share_{k}" for k in CLASSES))
_TABLE = np.zeros((256, len(CLASSES)))
for _i, _chars in enumerate(CLASSES.values()):
    _TABLE[list(_chars), _i] = 1


def statistics(text: str | None) -> np.ndarray:
    """FEATURES of one whole text; null counts as empty, and an empty text is all zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return np.zeros(len(FEATURES))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n = max(1, len(words))
    low = [w.lower() for w in words]
    unique = Counter(low)
    top = max(unique.values(), default=0)
    own = (np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, len(unique) / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))), top / n, sum(len(w) < 4 for w in unique) / max(1, len(unique)))
    return np.concatenate((own, np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _TABLE / len(raw)))


def features(docs: DataFrame, keys: list[str], *, text_col: str = "text") -> DataFrame:
    """``keys`` and ``x`` (array of FEATURES) for every row."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keys).schema.add("x", ArrayType(DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(x=[statistics(t if isinstance(t, str) else None).tolist() for t in b[text_col]])

    return docs.select(*keys, text_col).mapInPandas(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        d = self.w.shape[1]
        return np.column_stack((np.ones(len(z)), z, np.sqrt(2 / d) * np.cos(z @ self.w + self.b)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.lift(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(at: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by ``at``; the blocks' mean places and levels."""
    blocks: list[list[float]] = []
    for x, n, k in zip(at, total, ones, strict=True):
        blocks.append([x * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.01) / (b[1] + 0.02) for b in blocks])


def fit(train: DataFrame, *, size: int = 192, width: float = 4.0, ridge: float = 1.0, grid: int = 2000, seed: int = 7) -> Model:
    """``train``: ``x`` and ``y`` (0 or 1), without nulls. ``size`` random features, ``width`` of the kernel in standard deviations."""
    k = len(FEATURES)
    empty = Model(np.zeros(k), np.ones(k), np.zeros((k, size)), np.zeros(size), np.zeros(1 + k + size), np.array([]), np.array([]))
    moments = train.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{s}{i}") for i in range(k) for s, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["n"]:
        return empty
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{i}"] for i in range(k)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(k)])
    model = Model(mean, np.maximum(scale, 1e-6), rng.normal(size=(k, size)) / width, rng.uniform(0, 2 * np.pi, size), empty.beta, empty.knots, empty.levels)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 + k + size, 2 + k + size))
        for b in batches:
            if len(b):
                z = model.lift(np.array(b["x"].tolist()))
                total += z.T @ np.column_stack((z, b["y"].to_numpy(dtype=float)))
        yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(rows["v"].tolist(), axis=0)]})

    # Rows of the matrix are added within shares of the partitions, about as many as a share has partitions, then over the shares: no task gathers a row of every partition.
    parts = train.mapInPandas(shares, "i int, v array<double>").withColumn("part", F.spark_partition_id())
    wide = max(1, math.isqrt(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = parts.groupBy("i", F.pmod("part", F.lit(wide)).alias("share")).applyInPandas(added, "i int, v array<double>")
    sums = some.groupBy("i").applyInPandas(added, "i int, v array<double>").collect()
    a = np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])
    model.beta = np.linalg.solve(a[:, :-1] + ridge * np.eye(len(a)), a[:, -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"bin": np.round(model.raw(np.array(b["x"].tolist())) * grid).astype(np.int64), "y": b["y"].to_numpy(dtype=float)})

    bins = train.mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("k")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(np.array([r["bin"] / grid for r in bins]), np.array([float(r["n"]) for r in bins]), np.array([r["k"] for r in bins]))
    return model


def predict(vectors: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to rows with ``x``; ``x`` goes."""
    kept = vectors.drop("score", "predicted")
    schema = kept.drop("x").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(np.array(b["x"].tolist()).reshape(len(b), -1)) if len(b) else np.zeros(0)
            yield b.drop(columns="x").assign(score=s, predicted=(s >= threshold).astype(np.int32))

    return kept.mapInPandas(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: F.Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """Train on labelled rows that are not ``held_out`` and score every row of ``docs``.

    Returns ``id_col``, ``held_out``, ``score``, ``predicted``, one row per input
    row, repeats included and alike; texts of any length are read whole. Of equally common words none is preferred, and equal ridge scores calibrate alike.
    Other columns are not looked at; an empty table gives an empty result. A document with several labels counts with their
    mean, rounded; null labels and labels of null ids are ignored. Null texts are empty. With no
    label at all every score is 0.5.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), held_out.alias("held_out"))
    vectors = materialize(features(rows, [id_col, "held_out"], text_col=text_col))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.round(F.avg(label_col)).alias("y"))
    train = vectors.where(~F.coalesce("held_out", F.lit(False))).join(marks, id_col).select("x", "y")
    return predict(vectors, fit(train, **options))
