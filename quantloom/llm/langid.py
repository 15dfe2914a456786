"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed greedily against each automaton: the longest match from
the current place is one phrase, the next phrase starts after it. Phrases times
log2(reference length) per character estimate the cross entropy; the language
with the fewest normalised phrases wins, ties going to the smaller name.

A batch of texts is parsed one character per step over all texts and languages at
once with numpy. Transitions on the most frequent letters are in a table (a failing character ends
a phrase and continues from the root), those on all others in a hash table of edges, so that memory follows the number of edges
and not states times alphabet. Long texts are cut into blocks that are parsed side by side from the root; then each block's beginning
is parsed again from the state in which the block before it ends, until both parses are in
one state, as they are from there on. The sum is the parse of the whole text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quantloom.llm.storage import map_texts, materialize

#: Normalised characters that are parsed in a row before blocks are put together.
BLOCK = 4096
#: The table has a column for each letter, the most frequent ones first, as far as so many bytes go; the first column is for what is no letter, the last for letters without one.
TABLE_BYTES = 96 << 20
#: Steps after which blocks that are done leave the parse.
STRIDE = 64
#: Raw characters taken into memory at once.
PIECE = 1 << 20
UND = "und"


@dataclass(frozen=True)
class Model:
    """Reference text of each language, sorted by language. Bounded: languages x ``docs_per_lang`` x ``doc_chars``."""

    langs: tuple[str, ...]
    refs: tuple[str, ...]


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 64, doc_chars: int = 512) -> Model:
    """Learn from labelled rows; nulls in either column are ignored, repeated texts count once, every label is learned.

    The sample is bounded by ``docs_per_lang`` texts a language, chosen by their hashes among its distinct texts, and by
    ``doc_chars`` characters of each, which begin at a hashed place of the whole text. The model holds every language; so does the driver.
    """
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    # Distinct texts are thinned by their hashes to about four times what is needed of each language, so that next to nothing is sorted; a language with fewer keeps all.
    span, enough = 1 << 40, F.lit(float(4 * docs_per_lang))
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts
    thin = rows.select("lang", "h").join(counts, "lang").where(F.pmod("h", F.lit(span)) < F.ceil(enough / F.col("n") * span)).select("lang", "h").distinct()
    picked = materialize(thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= docs_per_lang))
    first = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - doc_chars + 1, F.lit(1))).cast("int") + 1
    window = rows.join(picked, ["lang", "h"]).groupBy("lang", "k").agg(F.min(F.substring("text", first, F.lit(doc_chars))).alias("text"))
    parts: dict[str, list[str]] = {}
    for r in window.orderBy("lang", "k").collect():
        parts.setdefault(r["lang"], []).append(r["text"])
    langs = tuple(sorted(parts))
    return Model(langs, tuple("\n".join(parts[k]) for k in langs))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``codes``; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class _Edges:
    """A hash table of (state, letter) to the next state with open addressing; at most half of its places are taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(2 * len(keys) + 1).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.values = np.zeros(len(self.keys), dtype=np.int64)
        place = self._place(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[place[todo]] < 0]
            slot, first = np.unique(place[free], return_index=True)
            self.keys[slot], self.values[slot] = keys[free[first]], values[free[first]]
            todo = np.setdiff1d(todo, free[first], assume_unique=True)
            place[todo] = (place[todo] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The next state of each, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        place, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            found = self.keys[place[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[place[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            place[todo] = (place[todo] + 1) & (len(self.keys) - 1)
        return out


@dataclass
class _Compiled:
    code: np.ndarray  # of each code point: 0 for no letter, from 1 on by frequency in the references, the last for letters that none has
    width: int
    table: np.ndarray  # twice the next state's place (width times its number), one more if the phrase ended, at state's place + column
    edges: _Edges  # state's number * codes + code to the next state's place, for codes that share the last column
    roots: np.ndarray
    restart: np.ndarray  # by language and code, the place after a phrase has ended
    logs: np.ndarray


@lru_cache(maxsize=4)
def _compiled(model: Model) -> _Compiled:
    lows = [ref.lower() for ref in model.refs]
    seen, counts = np.unique(np.frombuffer("".join(lows).encode("utf-32-le", "replace"), dtype=np.uint32), return_counts=True)
    known = _letters()[seen]
    letters = seen[known][np.argsort(-counts[known], kind="stable")]
    codes = len(letters) + 2
    code = np.where(_letters(), codes - 1, 0).astype(np.int32)
    code[letters] = np.arange(1, codes - 1)
    built, logs, states = [], [], 0
    for low in lows:
        ids = _normal(code, low, False, True)
        nxt = suffix_automaton(ids.tolist())
        a = np.repeat(np.arange(len(nxt), dtype=np.int64), [len(e) for e in nxt])
        c = np.fromiter((c for e in nxt for c in e), dtype=np.int32, count=len(a))
        q = np.fromiter((q for e in nxt for q in e.values()), dtype=np.int64, count=len(a))
        built.append((states, len(nxt), a + states, c, q + states))
        logs.append(math.log2(len(ids) + 2))
        states += len(nxt)
        del nxt
    width = min(codes, max(2, TABLE_BYTES // (4 * states)))
    kind = np.int64 if states * width * 2 >= 2**31 else np.int32
    table, restarts, keys, values = np.empty((states, width), dtype=kind), [], [], []
    for base, size, a, c, q in built:
        restart = np.full(codes, base * width, dtype=np.int64)
        restart[c[a == base]] = q[a == base] * width
        own = c < width - 1
        table[base : base + size, : width - 1] = restart[: width - 1] * 2 + 1
        table[base : base + size, width - 1] = base * width * 2 + 1
        table[a[own], c[own]] = q[own] * width * 2
        keys.append(a[~own] * codes + c[~own])
        values.append(q[~own] * width)
        restarts.append(restart)
    return _Compiled(code, width, table.ravel(), _Edges(np.concatenate(keys), np.concatenate(values)), np.array([b[0] for b in built]) * width, np.array(restarts), np.array(logs))


def _normal(code: np.ndarray, text: str, after_letter: bool, last: bool) -> np.ndarray:
    """Codes of a lower-cased text, or of a part of it, runs of non-letters as one 0; none at the beginning, one at the end."""
    flat = code[np.frombuffer((text + "\n" * last).encode("utf-32-le", "replace"), dtype=np.uint32)]
    keep = flat != 0
    keep[1:] |= flat[:-1] != 0
    if len(flat):
        keep[0] |= after_letter
    return flat[keep]


def _step(m: _Compiled, state: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the next places, one more where a phrase ended; ``state`` by language and block, ``c`` by block."""
    last = m.width - 1
    rare = np.flatnonzero(c >= last) if m.width < m.restart.shape[1] else ()
    t = m.table[state + (np.minimum(c, last) if len(rare) else c)]
    if len(rare):
        key = state[:, rare].astype(np.int64) // m.width * m.restart.shape[1] + c[rare]
        to = m.edges(key.ravel()).reshape(key.shape)
        t[:, rare] = np.where(to >= 0, to * 2, m.restart[:, c[rare]] * 2 + 1)
    return t


def _walk(m: _Compiled, flat: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parse each block of ``flat`` in each language from the given places: phrases that ended, and the last places."""
    order = np.argsort(-length, kind="stable")
    state = state[:, order].astype(m.table.dtype)
    ended = np.zeros(state.shape, dtype=np.int32)
    from_, sizes = start[order], length[order]
    live = len(order) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(order) else 0), side="right")
    for k, w in enumerate(live):
        t = _step(m, state[:, :w], flat[from_[:w] + k])
        ended[:, :w] += t & 1
        state[:, :w] = t >> 1
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return ended[:, back].astype(np.int64), state[:, back].astype(np.int64)


def _mend(m: _Compiled, flat: np.ndarray, start: np.ndarray, length: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parse blocks from ``old`` and ``new`` places side by side until they meet: phrases that end more, the last new places, and where they met."""
    more, end, met = np.zeros(old.shape, dtype=np.int64), new.copy(), old == new
    todo, k = np.arange(len(start)), 0
    while len(todo):
        a, b, extra = old[:, todo], new[:, todo], np.zeros((len(old), len(todo)), dtype=np.int64)
        for i in range(k, k + STRIDE):
            on = i < length[todo]
            c = flat[np.minimum(start[todo] + i, len(flat) - 1)]
            s, t = _step(m, a, c), _step(m, b, c)
            extra += np.where(on, (t & 1).astype(np.int64) - (s & 1), 0)  # nothing once they have met
            a, b = np.where(on, s >> 1, a), np.where(on, t >> 1, b)
        more[:, todo] += extra
        old[:, todo], new[:, todo] = a, b
        met[:, todo] = a == b
        end[:, todo] = b
        k += STRIDE
        todo = todo[~met[:, todo].all(axis=0) & (length[todo] > k)]
    return more, end, met


def parse(parts: list[np.ndarray], model: Model, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each normalised part, by language, and the states at its end. ``entry``: the states (language, part) to begin in, else the roots."""
    m = _compiled(model)
    langs = len(model.langs)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    n = np.array([len(p) for p in parts], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(n)))
    blocks = np.maximum(-(-n // BLOCK), 1)
    unit = np.repeat(np.arange(len(parts)), blocks)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = at[:-1][unit] + nth * BLOCK
    length = np.minimum(BLOCK, n[unit] - nth * BLOCK)
    fresh = np.repeat(m.roots[:, None], len(unit), axis=1)
    begin = fresh.copy()
    if entry is not None:
        begin[:, nth == 0] = entry
    phrases, state = _walk(m, flat, start, length, begin)
    own, todo = begin.copy(), np.flatnonzero(nth > 0)
    while len(todo):  # blocks whose true beginning is not the one they were parsed from
        todo = todo[(state[:, todo - 1] != own[:, todo]).any(axis=0)]
        if not len(todo):
            break
        true = state[:, todo - 1]
        more, end, met = _mend(m, flat, start[todo], length[todo], own[:, todo], true.copy())
        phrases[:, todo] += more
        state[:, todo] = np.where(met, state[:, todo], end)
        own[:, todo] = true
        todo = np.unique(todo + 1)
        todo = todo[(todo < len(unit))]
        todo = todo[nth[todo] > 0]
    total = np.zeros((langs, len(parts)), dtype=np.int64)
    for i in range(langs):
        total[i] = np.bincount(unit, weights=phrases[i], minlength=len(parts)).astype(np.int64)
    return total, state[:, np.cumsum(blocks) - 1] if len(parts) else np.zeros((langs, 0), dtype=np.int64)


def identify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a character of each whole text."""
    out_lang, out_score, out_bits = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if not model.langs:
        return out_lang, out_score, out_bits
    m = _compiled(model)
    phrases = np.ones((len(model.langs), len(texts)), dtype=np.int64)
    n, letter = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    parts: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if parts:
            phrases[:, owner] += parse(parts, model)[0]
        parts.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        low = (text or "").lower()
        state, after_letter = None, False
        for k in range(0, len(low), PIECE):
            last = k + PIECE >= len(low)
            part = _normal(m.code, low[k : k + PIECE], after_letter, last)
            n[i] += len(part)
            letter[i] |= bool(part.any())
            if last and state is None:
                parts.append(part)
                owner.append(i)
                size += len(part)
                if size >= PIECE:
                    flush()
            elif len(part):  # a long text, one piece after the other
                ended, state = parse([part], model, state)
                phrases[:, i] += ended[:, 0]
                after_letter = part[-1] != 0
    flush()
    bits = phrases * m.logs[:, None] / np.maximum(n, 1)
    best = bits.argmin(axis=0)
    low = bits.min(axis=0)
    share = np.exp2(-(bits - low) * np.minimum(n, 50)).sum(axis=0)
    for i in np.flatnonzero(letter):
        out_lang[i], out_score[i], out_bits[i] = model.langs[best[i]], 1 / share[i], low[i]
    return out_lang, out_score, out_bits


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``bits_per_char`` to ``docs`` (columns of these names are replaced).

    Null texts and texts with no letter get ``und``, 0 and 0; so does every text
    if nothing was learned. Every text is parsed whole, whatever its length. Of languages that need equally many phrases the smaller name wins.
    Repeated rows come out alike, an empty table gives an empty result, and other columns pass
    through untouched.
    """
    added = StructType().add("lang_pred", "string").add("score", "double").add("bits_per_char", "double")
    return map_texts(docs, [c for c in docs.columns if c not in added.names], text_col, added, lambda texts: identify(texts, model))
