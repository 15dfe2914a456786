"""The pipeline against the same steps in plain Python, and the registered queries."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__  # noqa: E402
from quantloom.llm import langid, mixing, packing, queries, shingles, storage  # noqa: E402
from tests.llm.test_operators import plain_codes, plain_dedup, plain_identify  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = storage.materialize(f(spark, docs, SF))
        seen.append((name, before, docs))
        if name != "best-fit packing":
            assert docs.dtypes == before.dtypes
    (_, raw, lang), (_, _, lines), (_, _, near), (_, _, mixed), (_, _, packed) = seen
    assert lang.count() >= 0.97 * raw.count()
    kept = {r.doc_id: r.text for r in lines.collect()}
    for r in lang.collect():
        if r.doc_id in kept and kept[r.doc_id] != r.text:
            mine = kept[r.doc_id].split("\n")
            assert all(x in r.text.split("\n") for x in mine)
    long = collections.Counter(x for t in kept.values() for x in t.split("\n") if len(x.split()) >= 50)
    assert max(long.values(), default=1) == 1
    ids = [r.doc_id for r in near.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= set(kept)
    assert set(r.doc_id for r in mixed.collect()) <= set(ids)
    tokens = packing.pieces(mixed, **queries.tokenizer_paths()).agg({"length": "sum"}).first()[0]
    assert packed.agg({"length": "sum"}).first()[0] == tokens
    assert packed.select("sequence_id").distinct().count() <= -(-tokens // 1024) * 1.02 + 1


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = storage.materialize(f(spark, docs, SF))
    want = collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())
    got = collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_queries_are_registered():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def _words(seed, n=200):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]


def _jaccard(a, b):
    a, b = ({tuple(x.lower().split()[k : k + 5]) for k in range(len(x.split()) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_removes_what_reaches_four_fifths(spark):
    rows, want, seen = [], set(), collections.Counter()
    for k in range(60):
        base = _words(k)
        edited = list(base)
        for j in range(1 + k % 8):  # each changed word changes five shingles
            edited[10 + 20 * j] = f"new{k}x{j}"
        a, b = " ".join(base), " ".join(edited)
        rows += [(2 * k, a), (2 * k + 1, b)]
        near = _jaccard(a, b) >= 0.8
        seen[near] += 1
        want |= {2 * k} if near else {2 * k, 2 * k + 1}
    assert min(seen.values()) > 20
    assert {r.doc_id for r in corpus_pipeline.deduplicate_near(spark, _rows(spark, rows), SF).collect()} == want


def test_near_dedup_of_a_crowded_group_equals_brute_force(spark):
    base, r, texts = _words("hub"), random.Random(7), []
    for k in range(120):
        w = list(base)
        for at in r.sample(range(200), r.randint(2, 6)):
            w[at] = f"new{k}x{at}"
        texts.append(" ".join(w))
    sets = [set(shingles.shingle_set(t).tolist()) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    want = {find(i) for i in range(len(texts))}
    assert 1 < len(want) < 120
    assert {x.doc_id for x in corpus_pipeline.deduplicate_near(spark, _rows(spark, enumerate(texts)), SF).collect()} == want
    few = [shingles.shingle_set(t) for t in texts[:5]]
    assert shingles.overlaps(few, few).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in few] for a in few]


def _fingerprints(n=400):
    """Random fingerprints, and some of each with 1 to 130 bits changed; names and words as ``classes`` passes them."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2, (n // 8, 448), dtype=np.uint8)
    bits = np.concatenate([base ^ (r.random(base.shape) < share) for share in (0, 0.002, 0.05, 0.1, 0.15, 0.2, 0.25, 0.29)])
    words = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return bits, words, shingles._names(words[:, : shingles.CHECKED])


@pytest.mark.parametrize("block", [4096, 3])
def test_fingerprints_meet_in_sub_grids_as_by_brute_force(spark, block):
    """Within 55 of 448 bits every pair meets; beyond, those whose segment bit counts differ by one at most in a sub-grid. Crowded cells too, and rows of a cell in several batches."""
    bits, words, names = _fingerprints()
    counts = bits.reshape(len(bits), 28, 8, 2).sum(axis=3).astype(int)
    top = {int(x): int(x) for x in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    seen = collections.Counter()
    for i, j in itertools.combinations(range(len(bits)), 2):
        apart = int((bits[i] != bits[j]).sum())
        met = bool((np.abs(counts[i] - counts[j]).sum(axis=1) <= 1).any())
        assert met or apart > 55
        near = met and int((bits[i, :192] != bits[j, :192]).sum()) <= 52
        seen[met, near, apart > 55] += 1
        if near:
            top[find(int(names[i]))] = find(int(names[j]))
    assert len(seen) >= 4 and seen[True, True, True] > 50
    frame = spark.createDataFrame([(int(f), w.view(np.int64).tolist()) for f, w in zip(names, words, strict=True)], "fid long, words array<long>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = {x: x for x in top}
    links = shingles.near_fingerprints(frame, block=block).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in links:
        got[root(r.u)] = root(r.v)
    groups = lambda f: sorted(sorted(x for x in top if f(x) == y) for y in {f(x) for x in top})
    assert groups(root) == groups(find)


@pytest.mark.parametrize("depth", [0, 1, 3, 6, 8])
@pytest.mark.parametrize("most", [1, 5, 10**6])
def test_groups_of_any_depth_and_blocks_of_any_size_meet_the_same_pairs(monkeypatch, depth, most):
    """What looks into a block comes in parts of some rows, large cells are compared in parts, and packets of a block lie in several batches."""
    monkeypatch.setattr(shingles, "LOOKING", 30)
    monkeypatch.setattr(shingles, "SIDE", 3 if most == 5 else 512)
    monkeypatch.setattr(shingles, "DEALT", 50)
    bits, words, names = _fingerprints(200)
    bits[8:60] = bits[8] ^ (np.random.default_rng(8).random((52, 448)) < 0.02)
    words = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    names = shingles._names(words[:, : shingles.CHECKED])
    counts = bits.reshape(len(bits), 28, 8, 2).sum(axis=3).astype(int)
    met = np.array([(np.abs(counts - c).sum(axis=2) <= 1).any(axis=1) for c in counts])
    near = met & np.array([(bits[:, :192] != b[:192]).sum(axis=1) <= 52 for b in bits])
    x, y = np.nonzero(near & ~np.eye(len(bits), dtype=bool))
    want = shingles._forest(names[x], names[y])
    assert len(want[0]) > 100
    groups = shingles._grid(words, depth)[0]
    blocks = np.maximum(1, -(-np.bincount(groups.ravel(), minlength=28 * 3**depth) // most))
    sent = [pa.RecordBatch.from_arrays([pa.array(w.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["words"]) for w in np.array_split(words, 7)]
    dealt = pa.Table.from_batches(shingles._deal(depth, blocks)(iter(sent))).sort_by("at")
    if most == 10**6:
        assert sum(len(x.as_py()) for x in dealt["rows"]) == shingles.ROW.itemsize * (groups.size + np.count_nonzero(shingles._grid(words, depth)[2] >= 0))
    made = pa.Table.from_batches(shingles._meet(depth)(iter(dealt.to_batches(max_chunksize=11))))
    got = shingles._forest(made["u"].to_numpy(), made["v"].to_numpy())
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == dict(zip(want[0].tolist(), want[1].tolist(), strict=True))


def _shuffled(spark, f):
    """MB that ``f`` writes to shuffle files."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    f()
    return (total() - before) / 1e6


def test_near_dedup_sends_few_bytes_of_fingerprints_and_only_texts_of_candidates(spark):
    """Not a row for each of some 196 cells, and no shuffle of all texts where the candidates are too many to be broadcast."""
    r = np.random.default_rng(9)
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(r.integers(-(2**63), 2**63, (10000, 7)).tolist())], "fid long, words array<long>")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 100)  # with few, a task's rows of one fingerprint lie together and are compressed
    try:
        met = _shuffled(spark, lambda: shingles.near_fingerprints(frame).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert met < 3000e-6 * 10000
    rows = [(k, " ".join(_words(f"b{k}", 3000))) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " end") for k in range(3)]
    docs = storage.materialize(_rows(spark, rows))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    kept = []
    try:
        sent = _shuffled(spark, lambda: kept.extend(x.doc_id for x in corpus_pipeline.deduplicate_near(spark, docs, SF).select("doc_id", "text").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(kept) == list(range(300))
    assert sent < 0.4 * sum(len(t) for _, t in rows) / 1e6


def test_a_bit_table_marks_all_that_is_wanted(spark):
    keys = np.random.default_rng(10).integers(-(2**63), 2**63, 4000).tolist()
    rows = spark.createDataFrame([(k,) for k in [*keys, -1, 0, 63, 64]], "k long")
    for wanted in ([], keys[:300], [-1, 0, 63, 64, keys[0]]):
        got = storage.marked(rows, "k", spark.createDataFrame([(k,) for k in wanted], "k long"), "maybe")
        assert got.columns == ["k", "maybe"] and got.count() == 4004
        marked = {x.k for x in got.where("maybe").collect()}
        assert set(wanted) <= marked and len(marked) <= len(wanted) + 400


def test_trees_of_a_crowded_cell_connect_what_all_pairs_do():
    r = np.random.default_rng(6)
    for share in (0.02, 0.1, 0.7):
        near = r.random((40, 60)) < share
        x, y = shingles._trees(near)
        assert near[x, y].all() and len(x) <= 100
        u, v = shingles._forest(x, 40 + y)
        every = shingles._forest(*(a + b for a, b in zip(np.nonzero(near), (0, 40), strict=True)))
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == dict(zip(every[0].tolist(), every[1].tolist(), strict=True))


def test_near_dedup_compares_only_what_fingerprints_connect(spark, monkeypatch):
    """The stage's candidates are those of the SimHash sub-grids; no other path finds pairs."""
    rows = [(2 * k + j, " ".join(_words(k)[: 200 - 5 * j])) for k in range(8) for j in range(2)]
    near = lambda: {r.doc_id for r in corpus_pipeline.deduplicate_near(spark, _rows(spark, rows), SF).collect()}
    assert near() == set(range(0, 16, 2))
    monkeypatch.setattr(shingles, "near_fingerprints", lambda names: spark.createDataFrame([], "u long, v long"))
    assert near() == set(range(16))


def test_near_dedup_keeps_unrelated_documents_with_no_id_or_the_same_id(spark):
    texts = [" ".join(_words(f"t{k}", 60)) for k in range(9)]
    edited = texts[8] + " end"
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0])] + [(5, t) for t in texts[4:8]] + [(7, texts[4]), (None, texts[5]), (None, edited), (9, texts[8])]
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.deduplicate_near(spark, _rows(spark, rows), SF).collect())
    assert got == collections.Counter([(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:8]] + [(9, texts[8])])


def plain_mix(docs):
    """Documents with the number of their copies, by the words of module ``mixing``: targets, then strata from the largest down."""
    size = {i: len(t.split()) for i, (_, t, _) in enumerate(docs)}
    names = sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    total = {s: sum(size[i] for i, d in enumerate(docs) if d[2] == s) for s in names}
    weight, full = {s: k % 3 + 1 for k, s in enumerate(names)}, set()
    while True:
        rest, left = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest / left >= 3 * total[s]}
        if not over:
            break
        full |= over
    out = {}
    for s in names:
        target = 3.0 * total[s] if s in full else weight[s] * rest / left
        mine = [i for i, d in enumerate(docs) if d[2] == s]
        base = math.floor(target / total[s])
        missing, words = target - base * total[s], float(total[s])
        stratum = lambda i: max(0, size[i].bit_length() - 6) * 64 + (size[i] >> max(0, size[i].bit_length() - 6))
        draw = lambda i: hashlib.md5(f"mix:{'null' if docs[i][0] is None else docs[i][0]}:{docs[i][1]}".encode()).hexdigest()[:12]
        for k in sorted({stratum(i) for i in mine}, reverse=True):
            here = sorted((i for i in mine if stratum(i) == k), key=draw)
            toss = int(hashlib.md5(f"mix:{'null' if s is None else s}:{k}".encode()).hexdigest()[:12], 16) / mixing.SPAN
            take = min(len(here), math.floor(min(1.0, max(0.0, missing / words)) * len(here) + toss))
            held = sum(size[i] for i in here)
            missing, words = missing - take * held / len(here), words - held
            out |= {i: base + (n < take) for n, i in enumerate(here)}
    return out


def plain_run(docs, model):
    """``(doc_id, text, source)`` in, the pieces' ``(doc_id, piece, start, length, crc32)`` out."""
    kept = []
    for i, t, s in docs:
        found = plain_identify(t, model)
        if found == langid.UND:
            continue
        n = len(plain_codes(t))
        bits = [p * math.log2(len(plain_codes(r)) + 2) / n for p, r in zip(found[1], model.refs, strict=True)]
        if 1 / sum(2.0 ** -((b - min(bits)) * min(n, 50)) for b in bits) >= 0.5:
            kept.append((i, t, s))
    lines = plain_dedup([((i is None, i or 0), t) for i, t, _ in kept], 50)
    kept = [(i, lines[i is None, i or 0], s) for i, _, s in kept]
    kept = [d for d in kept if d[1].split()]
    top = list(range(len(kept)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t, _ in kept)]
    for a, b in itertools.combinations(range(len(kept)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            top[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, d in enumerate(kept):
        groups[find(k)].append(d)
    kept = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    tok, out = Tokenizer.from_file(queries.tokenizer_paths()["path"]), collections.Counter()
    for k, copies in plain_mix(kept).items():
        ids = np.array([*tok.encode(kept[k][1], add_special_tokens=False).ids, 2], dtype="<u4")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for n, (a, z) in enumerate(itertools.pairwise(edges)):
            out[kept[k][0], n, a, z - a, zlib.crc32(ids[a:z].tobytes())] += copies
    return +out


def test_run_equals_five_plain_stages(spark, tmp_path):
    """Nulls, an empty and a long text, junk, a repeated passage of lines, exact and near copies, a null id, and columns with the operators' own names."""
    real = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 300 and 2500").orderBy("doc_id").limit(36).collect()]
    r = random.Random(3)
    passage = "\n".join(" ".join(_words(f"p{k}", 20)) for k in range(4))
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in real]
    rows += [(10**6, None, "en", "src1"), (10**6 + 1, "", "en", "src1"), (10**6 + 2, "1234 %% 99", None, None), (None, "a document with no id " + real[3].text[::-1], "en", None)]
    rows += [(10**6 + 3 + k, real[k].text + "\n" + passage + "\n" + real[k + 9].text[:200], "en", "src2") for k in range(3)]
    rows += [(10**6 + 10 + k, real[k].text, "en", "src3") for k in (5, 6)]
    near = real[7].text.split(" ")
    near[len(near) // 2] = "changed"
    rows += [(10**6 + 20, " ".join(near), "en", "src4"), (10**6 + 21, " ".join(r.sample(real[8].text.split(), len(real[8].text.split())) * 6), real[8].lang, "src4")]
    made = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made = made.withColumns({k: F.lit("mine") for k in ("score", "lang_pred", "n_lines", "n_removed", "_rid", "_lines", "rid", "copies", "target", "h")})
    made.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs.where(~F.coalesce(queries.held(4, 2), F.lit(False))).select("text", "lang"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == plain_run([(i, t, s) for i, t, _, s in rows], model)
    first = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {x.score for x in first.collect()} == {"mine"}
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        empty = storage.materialize(f(spark, empty, str(tmp_path)))
        assert empty.count() == 0
