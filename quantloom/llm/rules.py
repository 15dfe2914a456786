"""Quality rules: a decision list learned by sequential covering.

Conjunctions of thresholds on document statistics are grown by information gain
on two thirds of a bounded labelled sample, pruned on the remaining third, and
taken in order while they stay precise there. Each rule rejects; they are
emitted as one ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.storage import materialize, small_batches

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_loud", "n_unique_words")
#: A candidate condition's name and its expression over STATS.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"), "digit_ratio": ("n_digits", "word_chars"), "loud_ratio": ("n_loud", "n_words"), "unique_ratio": ("n_unique_words", "n_words"), "words_a_line": ("n_words", "n_lines"),
}
_SPACES = [9, 10, 11, 12, 13, 32]


def count_text(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text; null counts as a text with no word."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return (0,) * len(STATS)
    each = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    repeated = 0
    if len(ids) >= 4:
        pair = ids[:-1] * len(seen) + ids[1:]
        if len(seen) >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, counts = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= twice
        repeated = int(covered.sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = int(each.sum() - each[128:192].sum())
    return (len(words), chars - int(each[_SPACES].sum()), int(each[list(b"#*$%&|<>")].sum()), len(lines) - len(set(lines)), repeated, len(lines), int(each[65:91].sum()), int(each[48:58].sum()), int(each[33]), len(seen))


def statistics(docs: DataFrame, keys: list[str], *, text_col: str = "text") -> DataFrame:
    """``keys`` and STATS (long) of every row."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keys).schema
    for k in STATS:
        schema = schema.add(k, "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.array([count_text(t if isinstance(t, str) else None) for t in b[text_col]], dtype=np.int64).reshape(len(b), len(STATS))
            yield b[keys].assign(**{k: got[:, i] for i, k in enumerate(STATS)})

    return docs.select(*keys, text_col).mapInPandas(run, schema)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # else at or below
    at: float


@dataclass
class Rules:
    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def expression(self) -> Column:
        """The number of the first rule that holds (from 0), or null: an ordered conditional expression."""
        out = None
        for i, rule in enumerate(self.rules):
            test = F.lit(True)
            for c in rule:
                test = test & ((ratio(c.name) > c.at) if c.above else (ratio(c.name) <= c.at))
            out = F.when(test, i) if out is None else out.when(test, i)
        return F.lit(None).cast("int") if out is None else out


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    inside, rule = np.ones(len(bad), dtype=bool), []
    while len(rule) < most and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for name, at in cuts.items():
            hi = x[name][:, None] > at[None, :]
            for above in (True, False):
                took = (hi if above else ~hi) & inside[:, None]
                p, n = (took & bad[:, None]).sum(axis=0), (took & ~bad[:, None]).sum(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                if g.max(initial=0) > gain:
                    gain, best = g.max(), Condition(name, above, float(at[g.argmax()]))
        if best is None:
            break
        rule.append(best)
        inside &= (x[best.name] > best.at) == best.above
    return rule


def _holds(x: dict[str, np.ndarray], rule: list[Condition], size: int) -> np.ndarray:
    out = np.ones(size, dtype=bool)
    for c in rule:
        out &= (x[c.name] > c.at) == c.above
    return out


def fit(train: DataFrame, *, max_rows: int = 20_000, max_rules: int = 12, max_conditions: int = 4, cuts: int = 48, precision: float = 0.95, least: int = 5) -> Rules:
    """Learn from rows with STATS, ``y`` (1 good, 0 bad) and a ``h`` that is random by row.

    ``max_rows`` bounds the sample: about that many rows, chosen by ``h``. A
    rule needs ``precision`` and ``least`` bad rows among the pruning rows.
    """
    total = train.count()
    if not total:
        return Rules()
    top = 1 << 20
    part = max_rows / total
    sample = train if part >= 1 else train.where(F.pmod(F.xxhash64("h"), F.lit(top)) < int(part * top))
    got = sample.select(*(ratio(k).alias(k) for k in RATIOS), "y", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(3)).alias("part")).toPandas()
    got = got.sort_values([*RATIOS, "y", "part"])
    x = {k: got[k].to_numpy(dtype=float) for k in RATIOS}
    bad, grown = got["y"].to_numpy() == 0, got["part"].to_numpy() > 0
    left, rules = np.ones(len(bad), dtype=bool), []
    edges = {k: np.unique(np.concatenate((np.quantile(v, np.linspace(0, 1, cuts)), np.quantile(v[bad], np.linspace(0, 1, cuts))))) for k, v in x.items()} if bad.any() else {}
    while len(rules) < max_rules and (bad & grown & left).any():
        g, p = grown & left, ~grown & left
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], edges, max_conditions)
        if not rule:
            break
        rest = {k: v[p] for k, v in x.items()}

        def worth(r: list[Condition], rest=rest, mine=bad[p]) -> tuple[float, int]:
            held = _holds(rest, r, len(mine))
            good, ill = int((held & ~mine).sum()), int((held & mine).sum())
            return ((ill - good) / (ill + good) if ill + good else -1.0, ill)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        value, hits = worth(rule)
        if hits < least or (value + 1) / 2 < precision:
            break
        rules.append(tuple(rule))
        left &= ~_holds(x, rule, len(bad))
    return Rules(rules)


def apply(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """Statistics and verdict of every row of ``docs``, the rules learned from ``labels``.

    Returns ``id_col``, STATS, ``base_failed`` (under 50 words, or over half of
    the words in repeated windows), ``rule`` (the learned rule that rejected
    it, else null) and ``kept``. Null or empty texts have no word and fail the
    base; texts of any length are read whole. Repeated rows come out alike, other columns of
    ``docs`` are not looked at, and an empty table gives an empty result. Of equally good conditions the first in the order of RATIOS and thresholds is taken. Null labels are ignored, several labels
    of an id count with their rounded mean; with no usable label nothing is
    learned and the base alone decides.
    """
    stats = materialize(statistics(docs, [id_col], text_col=text_col))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.round(F.avg(label_col)).alias("y"))
    rules = fit(stats.where(~base).join(marks, id_col).select(*STATS, "y", F.col(id_col).alias("h")), **options)
    out = stats.withColumn("base_failed", base).withColumn("rule", rules.expression())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
