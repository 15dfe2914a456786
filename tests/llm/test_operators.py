"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import components, digest, langid, licences, linededup, mixing, packing, quality, rules, simhash, storage, warc

SF = "/root/testdata/sf0.001"
PATHS = {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "1234 %%", "word", "Ünïcode ß 漢字 ﬀ", "a b c d " * 30000, "one two three four five", "one two three four five", "x\n\n\nx\n"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None), rows[7]], SCHEMA)


def plain_codes(text):
    """Lower-case letters, every run of anything else as one blank, none at the beginning, one at the end."""
    out = ""
    for c in text.lower() + "\n":
        out += c if c.isalpha() else " " if out[-1:] not in ("", " ") else ""
    return out


def plain_identify(text, model):
    """Longest matches one after the other, found by substring search."""
    best = []
    if not any(c.isalpha() for c in text or ""):
        return langid.UND
    for lang, ref in zip(model.langs, map(plain_codes, model.refs), strict=True):
        now, phrases = "", 1
        for c in plain_codes(text):
            if now + c in ref:
                now += c
            else:
                now, phrases = (c if c in ref else ""), phrases + 1
        best.append((phrases * np.log2(len(ref) + 2), lang, phrases))
    return min(best)[1], [p for _, _, p in best]


def phrases_of(text, model):
    part = langid._normal(langid._compiled(model).code, text.lower(), False, True)
    return (langid.parse([part], model)[0][:, 0] + 1).tolist()


def test_language_parse_equals_a_plain_one(spark, docs):
    model = langid.fit(docs.select("text", "lang"))
    texts = [r.text for r in docs.limit(12).collect()] + [model.refs[0], model.refs[1] * 2, "漢字ß Ünïcode ﬀ", "zz"]
    texts = [t[:3000] for t in texts]
    old = langid.BLOCK, langid.PIECE
    try:
        for langid.BLOCK, langid.PIECE in (old, (64, 1000), (7, 50)):
            for t in texts if langid.BLOCK > 7 else texts[-8:]:
                assert phrases_of(t, model) == plain_identify(t, model)[1]
            assert langid.identify(texts, model)[0] == [plain_identify(t, model)[0] for t in texts]
            bits = langid.identify(texts, model)[2]
            langid.BLOCK, langid.PIECE = old
            assert np.allclose(bits, langid.identify(texts, model)[2])
    finally:
        langid.BLOCK, langid.PIECE = old


def test_language_learns_every_label_whatever_is_repeated(spark, docs):
    few = docs.where("lang = 'en'").limit(40).select("text", "lang")
    copies = spark.range(3000).select(F.lit("Der schnelle braune Fuchs springt über den faulen Hund und schläft dann im Wald").alias("text"), F.lit("de").alias("lang"))
    model = langid.fit(few.union(copies).union(spark.createDataFrame([(None, "xx"), ("a text with no label", None), ("solo", "one")], "text string, lang string")))
    assert model.langs == ("de", "en", "one")
    assert langid.identify(["der Fuchs schläft im Wald"], model)[0] == ["de"]


def test_language_model_of_many_scripts_is_small():
    rng = np.random.default_rng(6)
    refs = tuple("".join(map(chr, 0x4E00 + rng.integers(0, 20_000, 4000))) for _ in range(12))
    model = langid.Model(tuple(f"l{i:02d}" for i in range(12)), refs)
    m = langid._compiled(model)
    assert m.table.nbytes + m.edges.keys.nbytes + m.edges.values.nbytes < 120e6 and m.width < m.restart.shape[1]
    assert langid.identify([r[500:900] for r in refs], model)[0] == list(model.langs)
    assert phrases_of(refs[3][100:400] + refs[4][:100], model) == plain_identify(refs[3][100:400] + refs[4][:100], model)[1]


def test_language_accuracy_and_edges(spark, docs, odd):
    model = langid.fit(docs.where("doc_id % 2 = 0").select("text", "lang"))
    got = langid.predict(docs.where("doc_id % 2 = 1"), model).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.9
    rows = langid.predict(odd.withColumn("score", F.lit("mine")).withColumn("_text", F.lit(1)), model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)] == ["und"] * 4
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.identify(ODD[:6], model)[0] == [langid.identify([t], model)[0][0] for t in ODD[:6]]


def test_quality_held_out(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out_of = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    got = quality.classify(docs, labels, out_of).join(labels, "doc_id").toPandas()
    test = got[got.held_out]
    assert len(got) and ((test.score >= 0.3) == (test.quality == 1)).mean() > 0.9
    assert quality.classify(odd, labels.limit(0), F.lit(False)).where("score = 0.5").count() == len(ODD) + 2
    assert quality.classify(docs.limit(0), labels, out_of).count() == 0
    knots, levels = quality.isotonic(np.array([0.0, 1, 2, 3]), np.ones(4), np.array([0.0, 1, 0, 1]))
    assert list(knots) == [0, 1.5, 3] and (np.diff(levels) > 0).all()


def test_quality_equals_a_direct_solution(spark, docs):
    """The same features solved in one piece, calibrated by a plain pool of adjacent violators."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    rows = docs.select("doc_id", "text").toPandas().merge(labels, on="doc_id")
    x = np.array([quality.statistics(t) for t in rows["text"]])
    y = rows["quality"].to_numpy(dtype=float)
    model = quality.fit(spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5), size=32)
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(scale, 1e-6))
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    lifted = np.column_stack((np.ones(len(z)), z, np.sqrt(2 / 32) * np.cos(z @ model.w + model.b)))
    beta = np.linalg.solve(lifted.T @ lifted + np.eye(lifted.shape[1]), lifted.T @ y)
    assert np.allclose(model.beta, beta, atol=1e-6)
    at = np.round(np.clip(lifted @ beta, -0.5, 1.5) * 2000)
    blocks = [[k, 1, t] for k, t in sorted(zip(at, y, strict=True))]
    merged = [[k, sum(b[1] for b in blocks if b[0] == k), sum(b[2] for b in blocks if b[0] == k)] for k in sorted(set(at))]
    i = 0
    while i + 1 < len(merged):
        (a, n, k), (b, m, j) = merged[i], merged[i + 1]
        if k / n >= j / m:
            merged[i : i + 2] = [[(a * n + b * m) / (n + m), n + m, k + j]]
            i = max(0, i - 1)
        else:
            i += 1
    knots, levels = np.array([a / 2000 for a, _, _ in merged]), np.array([(k + 0.01) / (n + 0.02) for _, n, k in merged])
    assert np.allclose(model.score(x), np.clip(np.interp(np.clip(lifted @ beta, -0.5, 1.5), knots, levels), 0, 1), atol=1e-3)
    assert quality.statistics("The the a")[quality.FEATURES.index("top_word")] == 2 / 3


def plain_stats(text):
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit))


def test_rule_statistics_and_verdict(spark, docs, odd):
    for t in [*ODD, "a b c d e a b c", *[r.text for r in docs.limit(60).collect()]]:
        got = rules.count_text(t)
        want = plain_stats(t)
        assert want[0] == 0 or got[:5] == want, t
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.apply(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    live = got[~got.base_failed]
    assert (live.kept == (live.quality == 1)).mean() > 0.95 and live[live.quality == 1].kept.mean() > 0.98
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({k: F.lit(1) for k in ("n_words", "rule", "kept", "y", "h")})
    learnt, apart = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    held = rules.apply(whole, learnt).join(apart, "doc_id").toPandas()
    held = held[~held.base_failed]
    assert len(held) > 20 and (held.kept == (held.quality == 1)).mean() > 0.9  # rows that the list did not learn from
    stats = storage.materialize(rules.statistics(docs, ["doc_id"]))
    list_ = rules.Rules([(rules.Condition("unique_ratio", False, 0.5), rules.Condition("mean_word", True, 4.0)), (rules.Condition("digit_ratio", True, 0.0),)])
    for r in stats.withColumn("rule", list_.expression()).collect():
        ratio = {k: r[a] / max(r[b], 1) for k, (a, b) in rules.RATIOS.items()}
        hits = [i for i, rule in enumerate(list_.rules) if all((ratio[c.name] > c.at) == c.above for c in rule)]
        assert r.rule == (hits[0] if hits else None)
    none = rules.apply(odd, labels.limit(0))
    assert none.count() == len(ODD) + 2 and none.where("kept = base_failed").count() == 0
    assert rules.apply(docs.limit(0), labels).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, near):
    label = {n: n for n in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                label[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def test_simhash_equals_brute_force(spark, docs, odd):
    every = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**6))
    got = simhash.near_duplicates(every.select("doc_id", "text", F.lit(1).alias("fp"), F.lit(2).alias("cell"))).collect()
    texts = every.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    fps = {r.doc_id: plain_fingerprint(r.text) for r in texts}
    top = reach(sorted(set(fps.values())), lambda a, b: bin(a ^ b).count("1") <= 4)
    low = {}
    for i, f in fps.items():
        if i is not None:
            low[top[f]] = min(low.get(top[f], i), i)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == low[top[fps[r.doc_id]]]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_in_crowded_cells(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 400:
        f = base if rng.random() < 0.5 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 63, rng.integers(1, 5)):
            f ^= 1 << int(b)
        fps.add(f)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = reach(sorted(fps), lambda a, b: bin(a ^ b).count("1") <= 4)
    for block in (4096, 16):
        roots = {r.node: r.root for r in components.components(simhash.links(table, block=block)).collect()}
        groups, mine = collections.defaultdict(set), collections.defaultdict(set)
        for f in fps:
            groups[want[f]].add(f)
            mine[roots.get(f, f)].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000)], "u long, v long")
    got = components.components(edges).collect()
    assert len(got) == 301 and len({r.root for r in got}) == 1
    assert components.components(edges.limit(0)).count() == 0


def plain_dedup(rows, least):
    """All pairs of runs: a line goes if some run of ``least`` words that holds it began earlier elsewhere."""
    docs = []
    for doc, text in sorted(rows):
        raw = text.split("\n")
        docs.append((doc, raw, [i for i, x in enumerate(raw) if x.strip()]))
    starts = [(d, i) for d, (_, _, idx) in enumerate(docs) for i in range(len(idx))]
    gone = collections.defaultdict(set)
    line = lambda d, i: docs[d][1][docs[d][2][i]]
    for b in range(len(starts)):
        for a in range(b):
            (d1, i), (d2, j) = starts[a], starts[b]
            n = words = 0
            while i + n < len(docs[d1][2]) and j + n < len(docs[d2][2]) and line(d1, i + n) == line(d2, j + n):
                words += len(line(d2, j + n).split())
                n += 1
            if n and words >= least:
                ends = [*docs[d2][2], len(docs[d2][1])]
                gone[d2].update(range(ends[j], ends[j + n]))
    return {doc: "\n".join(x for i, x in enumerate(raw) if i not in gone[d]) for d, (doc, raw, _) in enumerate(docs)}


def test_line_dedup_equals_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    pool = [" ".join(f"w{rng.integers(99)}" for _ in range(n)) for n in (1, 2, 3, 5, 8, 1, 4)]
    for least in (1, 6, 10):
        rows = []
        for i in range(40):
            lines = [pool[rng.integers(len(pool))] if rng.random() < 0.8 else rng.choice(["", " ", f"own {i} {rng.integers(9)}"]) for _ in range(rng.integers(1, 14))]
            rows.append((i, "\n".join(lines)))
        got = linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()
        assert {r.doc_id: r.text for r in got} == plain_dedup(rows, least)
    out = linededup.deduplicate(odd.withColumn("n_removed", F.lit("mine")))
    assert out.count() == len(ODD) + 2 and out.where("text is null").count() == 1
    assert linededup.deduplicate(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    rows = [(i, "w " * (i % 7 + 1), None, f"s{min(i % 9, 4)}", None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.where("doc_id is null or doc_id <> 6").withColumn("doc_id", F.col("doc_id") + 10**6))
    plan = mixing.plan(docs.withColumns({k: F.lit(1) for k in ("size", "h", "stratum", "id", "copies")}))
    got = plan.toPandas().merge(docs.select("doc_id", "source").distinct().toPandas(), on="doc_id", how="left")
    assert len(got) == docs.count() and sorted(got["taken"]) == sorted(mixing.plan(docs.repartition(5)).toPandas()["taken"])
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"))
    names = sorted((s for s in by.index if isinstance(s, str))) + [s for s in by.index if not isinstance(s, str)]
    size = {s: by.loc[[s], "size"].iloc[0] if isinstance(s, str) else by[by.index.isna()]["size"].iloc[0] for s in names}
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(size.values())
    full = set()
    while True:
        rest, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / w > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        want = 3 * size[s] if s in full else weight[s] * rest / w
        have = by.loc[s, "target"] if isinstance(s, str) else by[by.index.isna()]["target"].iloc[0]
        assert abs(have - want) < 1e-6
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["size"] * got["copies"]).all()
    assert mixing.mix(docs).count() == got[got["size"] > 0]["copies"].sum()
    assert mixing.mix(docs.withColumn("size", F.lit(1)).withColumn("target", F.lit(2))).columns == [*docs.columns, "size", "target"]
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_comes_near_its_targets(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = mixing.plan(table).toPandas().merge(table.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in got.groupby("source", dropna=False):
        off = abs(g["taken"].sum() - g["target"].iloc[0])
        assert off <= g["size"].max() and (len(g) < 50 or off <= 0.02 * g["target"].iloc[0])


def test_mixing_draws_have_the_rates_fraction(spark):
    """Over many sources of like documents, one of them much longer, each is drawn about as often as the fraction says."""
    rows = [(1000 * s + i, "w " * (200 if i == 0 else 10 + i), f"s{s:03d}") for s in range(300) for i in range(12)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["more"] = got["copies"] - (got["target"] / got["source_size"]).apply(np.floor)
    part = got["target"] / got["source_size"] % 1
    for chosen in (got["doc_id"] % 1000 == 0, got["doc_id"] % 1000 == 5):
        assert abs(got[chosen]["more"].mean() - part[chosen].mean()) < 0.1
    assert (got["more"].isin([0, 1])).all()


def plain_features(raw, rank):
    """The rarest key of every neighbourhood, at the ends down to one window, in the order of their first appearance."""
    raw = raw.ljust(digest.WINDOW, b"\0") if raw else raw
    keys = digest._keys(np.frombuffer(raw, dtype=np.uint8), rank).tolist() if raw else []
    return list(dict.fromkeys(min(keys[max(0, s) : s + digest.NEAR]) for s in range(1 - digest.NEAR, len(keys)))) if keys else []


def test_digest_entropy_and_features(spark, docs):
    x = np.random.default_rng(0).integers(97, 110, 400).astype(np.uint8)
    got = digest.entropies(x)
    for i in (0, 7, 200, len(got) - 1):
        p = np.bincount(x[i : i + digest.WINDOW]) / digest.WINDOW
        p = p[p > 0]
        assert abs(got[i] - -(p * np.log2(p)).sum() * (digest.STEPS - 1) / np.log2(digest.WINDOW)) <= 0.51
    raws = [(t or "").encode() for t in ODD] + [r.text.encode() for r in docs.limit(80).collect()] + [bytes(x[:k]) for k in (1, 15, 16, 17, 39, 40, 41, 63)]
    rank = digest.ranks(digest.histogram(raws))
    plain = np.zeros(digest.STEPS, dtype=int)
    for r in (digest._filled(r) for r in raws if len(r) < 3000):
        for i in range(len(r) - digest.WINDOW + 1):
            plain[digest.entropies(np.frombuffer(r[i : i + digest.WINDOW], dtype=np.uint8))[0]] += 1
    assert (plain == digest.histogram([r for r in raws if len(r) < 3000])).all()
    found = digest.features(raws, rank)
    assert all(f.tolist() == plain_features(r, rank) for f, r in zip(found, raws, strict=True) if len(r) < 3000)
    old, digest.PIECE = digest.PIECE, 3000
    try:
        assert all((a == b).all() for a, b in zip(digest.features(raws, rank), found, strict=True))
        assert (digest.ranks(digest.histogram(raws)) == rank).all()
    finally:
        digest.PIECE = old
    for r, d in zip(raws, digest.digests(raws, rank), strict=True):
        assert (digest.digests([r], rank)[0] == d).all() and digest.likeness(d, d) == 1


def test_digest_of_texts_that_repeat_and_of_every_short_length():
    raws = [b"", b"a" * 500, b"b" * 900, b"ab" * 300, b"0123456789" * 60, b"spam " * 60, b"\n" * 300, b"a", b"buy now! " * 40]
    rng = np.random.default_rng(4)
    text = bytes(rng.choice(np.frombuffer(b"etaoin shrdlu cmfwyp", dtype=np.uint8), 300))
    rank = digest.ranks(digest.histogram([*raws, text]))
    found = digest.digests(raws, rank)
    assert len({digest.encode(d) for d in found}) == len(raws)
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert (digest.likeness(a, b) == 1) if i == j else digest.likeness(a, b) < 0.5 if 0 in (i, j) else True
    for n in range(150, 251):
        one, longer, middle = text[:n], text[: n + 8], text[: n // 2] + b"#" + text[n // 2 : n]
        a, b, c = digest.digests([one, longer, middle], rank)
        assert digest.likeness(a, b) > 0.5 and digest.likeness(a, c) > 0.5


def plain_likeness(a, b):
    """Shared bits beyond chance over the most that could be shared, each filter's best, both ways, weighed by bits."""
    x, y = ([np.unpackbits(f).astype(int) for f in c] for c in (a, b))
    if not sum(map(sum, x)) or not sum(map(sum, y)):
        return float(sum(map(sum, x)) == sum(map(sum, y)))

    def part(f, g):
        chance = f.sum() * g.sum() / len(f)
        room = min(f.sum(), g.sum()) - chance
        return ((f & g).sum() - chance) / room if room > 0 else 0

    ways = [(max(part(f, g) for g in there), f.sum()) for here, there in ((x, y), (y, x)) for f in here]
    return min(1.0, max(0.0, sum(p * n for p, n in ways) / sum(n for _, n in ways)))


def test_likeness_is_the_same_either_way_where_filters_share_less_than_chance():
    r, below = np.random.default_rng(1), 0
    for _ in range(60):
        a, b = (np.packbits(r.random((r.integers(1, 4), 2048)) < r.choice([0.01, 0.05, 0.3]), axis=1) for _ in range(2))
        b[0] |= a[0]
        assert abs(digest.likeness(a, b) - digest.likeness(b, a)) < 1e-12
        assert abs(digest.likeness(a, b) - plain_likeness(a, b)) < 1e-9
        below += min(len(a), len(b)) > 1
    assert below > 10


def test_digest_neighbours(spark, docs, odd):
    every = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**6)).withColumns({k: F.lit(1) for k in ("h", "range", "extra", "fingerprint", "id", "_text")})
    got = digest.compare_neighbours(every).collect()
    rows = sorted((((-r.doc_id if r.doc_id is not None else 1, r.h), r.text or "", r.doc_id) for r in every.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()))
    pairs = list(zip(rows, [*rows[1:], rows[0]], strict=True))
    want = collections.Counter((i, len(t), hashlib.sha256(digest.edited(t, nxt[1]).encode()).hexdigest()) for (_, t, i), nxt in pairs)
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    rank = digest.ranks(digest.histogram([t.encode() for _, t, _ in rows]))
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    for (_, t, i), (_, nxt, _) in pairs:
        if len(t) < 3000 and len(nxt) < 3000:
            changed = digest.edited(t, nxt)
            one, two, three = digest.digests([t.encode(), changed.encode(), nxt.encode()], rank)
            r = by[i, len(t), hashlib.sha256(changed.encode()).hexdigest()]
            assert (r.fingerprint, r.edited_fingerprint) == (digest.encode(one), digest.encode(two))
            assert abs(r.near_edited - plain_likeness(one, two)) < 1e-9 and abs(r.near_next - plain_likeness(one, three)) < 1e-9
    long = [r for r in got if 100 < r.n_chars < 50000]
    assert np.quantile([r.near_edited for r in long], 0.02) > 0.4 and np.median([r.near_next for r in long]) < 0.1
    split = digest.in_order(every, id_col="doc_id", text_col="text", rows_per_range=30)
    assert split.where("not extra").count() == every.count() and 1 < split.where("extra").count() < 20
    assert split.where("not extra").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 90
    assert digest.compare_neighbours(docs.limit(0)).count() == 0
    assert digest.compare_neighbours(docs.limit(1)).count() == 1


def test_digest_of_any_id_and_of_many_null_ids(spark):
    rows = [(None if i % 3 else f"id {i:04d}", f"text number {i} of these") for i in range(900)] + [(None, "same")] * 5
    table = spark.createDataFrame(rows, "doc_id string, text string")
    spread = digest.in_order(table, id_col="doc_id", text_col="text", rows_per_range=60).where("not extra").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 10 and max(r["count"] for r in spread) < 200
    got = digest.compare_neighbours(table).collect()
    order = [r for r in sorted((r for r in rows if r[0]), reverse=True)]
    want = {i: hashlib.sha256(digest.edited(t, n).encode()).hexdigest() for (i, t), (_, n) in zip(order[:-1], order[1:], strict=True)}
    assert len(got) == len(rows) and all(r.edited_sha256 == want[r.doc_id] for r in got if r.doc_id in want)
    big = spark.createDataFrame([(2**60 + 1, "a"), (None, "b"), (2**60 + 3, "c")], "doc_id long, text string")
    assert {r.doc_id for r in digest.compare_neighbours(big).collect()} == {2**60 + 1, None, 2**60 + 3}
    made = digest.fingerprint(big.withColumn("fingerprint", F.lit("mine")), digest.ranks(np.zeros(digest.STEPS, dtype=int)))
    assert made.columns == ["doc_id", "text", "fingerprint"] and made.select("fingerprint").distinct().count() == 3


@pytest.fixture(scope="module")
def pages(spark):
    more = spark.createDataFrame([(None, None, None), (10**6, "u", ""), (10**6, "u", ""), (10**6, "v", ""), (10**6 + 1, "w", "long " * 300_000)], "page_id long, url string, html string")
    return spark.read.parquet(f"{SF}/pages.parquet").unionByName(more)


def test_warc_audit_of_lost_cut_added_and_moved_records(spark, pages):
    recs = warc.records(pages.withColumn("key", F.lit("mine")).withColumn("digest", F.lit(1)))
    placed = storage.materialize(warc.layout(warc.manifest(recs), file_bytes=100_000))
    files = placed.agg(F.max("file")).first()[0] + 1
    assert files > 1 and placed.count() == pages.distinct().count()
    rows = placed.orderBy("file", "offset").collect()
    cut, lost, twice, moved = rows[3].key, rows[10].key, rows[20].key, rows[30].key
    bytes_ = F.when(F.col("key") == cut, F.expr("substring(record, 1, octet_length(record) - 1)")).otherwise(F.col("record"))
    copied = recs.withColumn("record", bytes_).where(F.col("key") != lost)
    copied = copied.union(copied.where(F.col("key") == twice).withColumn("key", F.lit("a new key")))
    replica = storage.materialize(warc.layout(warc.manifest(copied), files=files))
    got = warc.fixity(placed, replica).collect()
    assert {(r.key, r.status) for r in got if r.status != "ok"} == {(cut, "corrupt"), (lost, "missing"), ("a new key", "added")}
    assert sorted(r.key for r in got if r.status != "added") == sorted(r.key for r in rows)
    elsewhere = replica.withColumn("file", F.when(F.col("key") == moved, (F.col("file") + 1) % files).otherwise(F.col("file")))
    assert {(r.key, r.status) for r in warc.fixity(placed, elsewhere).collect()} - {(r.key, r.status) for r in got} == {(moved, "moved")}
    first, second = [r for r in rows if r.file == rows[0].file][-2:]
    last = F.when(F.col("key") == first.key, F.lit(10**9)).otherwise(F.col("offset"))
    turned = {r.key: r.status for r in warc.fixity(placed, placed.withColumn("offset", last), fanout=10**6).collect()}
    assert len({first.key, second.key, rows[0].key}) == 3 and turned[second.key] == "moved" and turned[rows[0].key] == "ok"
    assert set(r.status for r in warc.fixity(placed, placed).collect()) == {"ok"}
    assert set(r.status for r in warc.fixity(placed, placed.limit(0)).collect()) == {"missing"}
    assert set(r.status for r in warc.fixity(placed.limit(0), placed).collect()) == {"added"}
    assert warc.fixity(placed.limit(0), placed.limit(0)).count() == 0


def test_warc_audit_reads_only_below_what_differs(spark):
    recs = spark.range(5000).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.encode(F.concat(F.lit("bytes "), F.col("id").cast("string")), "UTF-8").alias("record"))
    placed = warc.layout(warc.manifest(recs), files=2)
    replica = warc.layout(warc.manifest(recs.where("id <> 77")), files=2)
    levels = warc.depth(placed)
    one, two = (warc.tree(warc.ranged(x, levels), levels) for x in (placed, replica))
    assert levels == 2 and [t.count() for t in one][-1] == 2 and warc.audit(one, two).count() == 1


def test_warc_files_round_trip(spark, pages, tmp_path):
    recs = warc.records(pages)
    placed = storage.materialize(warc.layout(recs, file_bytes=100_000))
    warc.write(placed, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).toPandas()
    want = pages.distinct().fillna("").toPandas()
    assert sorted(zip(back["url"], back["body"], strict=True)) == sorted(zip(want["url"], want["html"], strict=True))


def test_packing_round_trip(spark, docs, odd):
    every = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(spark.createDataFrame([(77_777_777, "a <|endoftext|> b", None, None, None)], SCHEMA))
    got = packing.pack(every, with_ids=True, **PATHS).toPandas()
    tok = Tokenizer.from_file(PATHS["path"])
    want = collections.Counter(tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in every.select("text").collect())
    texts = got[got.doc_id.isin([r.doc_id for r in docs.select("doc_id").collect()])].sort_values(["doc_id", "piece"])
    joined = collections.Counter(tuple(i for x in g["ids"] for i in x) for _, g in texts.groupby("doc_id"))
    assert joined == collections.Counter(tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.select("text").collect())
    assert got["length"].sum() == sum(len(k) * n for k, n in want.items())
    assert (got["length"] <= 1024).all() and (got[got.piece > 0]["length"] == 1024).all()
    assert all(zlib.crc32(np.array(x, dtype="<u4").tobytes()) == c for x, c in zip(got["ids"], got["ids_crc32"], strict=True))
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id")["length"].cumsum() - s["length"] == s["offset"]).all() and s.groupby("sequence_id")["length"].sum().max() <= 1024
    hist = np.bincount(got["length"], minlength=1025)
    assert got["sequence_id"].nunique() <= min(sum(n for _, n in packing.best_fit(hist, 1024)), -(-got["length"].sum() // 1024) * 1.02 + 1)
    assert packing.pack(docs.limit(0), **PATHS).count() == 0


def test_nnls_is_near_optimal():
    rng = np.random.default_rng(1)
    hist = np.bincount(rng.integers(1, 1024, 20_000), minlength=1025)
    packed = packing.plan(hist, 1024)
    used = np.zeros(1025, dtype=np.int64)
    for p, n in packed:
        assert sum(p) <= 1024
        np.add.at(used, list(p), n)
    assert (used == hist).all()
    assert sum(n for _, n in packed) <= 1.01 * (hist @ np.arange(1025)) / 1024


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_scan(texts, templates, anchors=4, share=0.85):
    """Every start of every template that a file's words point to, with the words' frequencies counted in Python."""
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in texts]
    idf = {w: np.log((len(files) + 2) / (sum(w in f for f in map(set, files)) + 1)) for t in templates for w in t.text.split()}
    out = []
    for words in files:
        own, places, names, good, score = set(words), [], set(), set(), 0.0
        for t in templates:
            p, k = t.text.split(), t.key.split()
            at = next(j for j in range(len(p)) if p[j : j + len(k)] == k)
            hits = [i for i in range(len(words) - len(p) + 1) if t.base and words[i : i + len(p)] == p]
            places += hits
            names |= {t.label} if hits else set()
            if not own >= set(k):
                continue
            rank = lambda ws: sorted(set(ws), key=lambda w: (-idf[w], w))
            look = {rank(k)[0], *([] if t.base else [w for w in rank(p) if w in own][:anchors])}
            for i in {i - j for i, w in enumerate(words) if w in look for j, x in enumerate(p) if x == w and j <= i}:
                stands = [i + j < len(words) and words[i + j] == x for j, x in enumerate(p)]
                part = sum(max(idf[x], 1e-3) for x, y in zip(p, stands, strict=True) if y) / sum(max(idf[x], 1e-3) for x in p)
                key = all(stands[at : at + len(k)])
                good |= {t.label} if key and (t.base or part >= share) else set()
                score = max(score, part if key or part < share else part / 2)
            whole = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]  # none may be passed over
            assert not whole or t.label in good
        out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(good)), min(1.0, score)))
    return out


def test_licence_scan_equals_brute_force(spark, docs, odd):
    mit = next(t.text for t in licences.TEMPLATES if "sublicense" in t.text)
    texts = [
        "CC BY cc by-CC By", "the GNU  general\npublic license; mit LICENSE. gnu general public", "cc", "License mit license mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "gnu lesser general public license", mit.title(), mit.replace("sublicense", "share").replace("merge", "join").replace("furnished", "given").replace("publish", "print"), mit.replace("restriction", "limit"), " ".join(mit.split()[::-1]),
        " ".join(t.text for t in licences.TEMPLATES), "Redistributions of source code must retain the above notice",
    ]
    extra = spark.createDataFrame([(10**7 + i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    every = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(extra).where("doc_id is not null").withColumns({k: F.lit(1) for k in ("labels", "score", "_words", "_id", "n_words")})
    source = {r.doc_id: r.text for r in every.select("doc_id", "text").collect()}
    rows = every.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain_scan([r.text for r in rows], licences.TEMPLATES), strict=True))
    got = licences.scan(every).collect()
    assert len(got) == len(rows) and set(source) == set(want)
    for r in got:
        assert r[1:7] == want[r.doc_id][:6] and abs(r.score - want[r.doc_id][6]) < 1e-9
    labels = {r.doc_id - 10**7: r.labels for r in got}
    assert labels[4] == "mit" and labels[5] == "lgpl" and "mit" in labels[6] and "mit" in labels[7] and "isc" in labels[10]
    assert licences.scan(docs.limit(0)).count() == 0


def test_packing_reads_long_runs_of_blanks():
    paths = PATHS
    fast, slow = packing.encoder(**paths), packing.encoder(paths["path"], None)
    for text in (" " * 1_000_000, "\n" * 500_000, "a " * 1000 + " " * 300_000 + "b"):
        assert fast(text) == slow(text)


def test_licences_in_a_long_text_of_nothing_else(spark):
    docs = spark.createDataFrame([(1, "Apache License " * 200_000)], "doc_id long, text string")
    row = licences.scan(docs).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (400_000, 200_000, 0, 399_998, "apache")


def test_line_dedup_of_long_copies(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nits own end")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in linededup.deduplicate(docs).collect()}
    assert rows[1]["text"] == text and rows[1]["n_removed"] == 0
    assert rows[2]["text"] == "its own end" and rows[2]["n_removed"] == 40_000


def test_queries_return_their_contracts_columns(spark):
    """Names and types that other programs rely on; more columns may follow."""
    from quantloom.llm.queries import QUERIES

    want = {
        "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double", "op2_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
        "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op4_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint", "op5_line_dedup": "doc_id bigint, text string", "op6_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op7_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op9_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op10_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    }
    for name, columns in want.items():
        assert set(columns.split(", ")) <= {f"{k} {t}" for k, t in QUERIES[name](spark, SF).dtypes}, name
