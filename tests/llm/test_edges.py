"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns of clashing names, for every operator and stage."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from samelode.llm import byte_bpe, decontam, line_dedup, ngram_join, pii, quality, recurrent_lm, secrets, suffix_dedup, vptree
from samelode.llm.common import id_text
from samelode.llm.q_byte_bpe import vocabulary

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

EXTRA = "n_tokens long, d string, t string, gone string, h long, class long, component_id long, key long, vec_id long, w string, th string, runs string, lang string, n_chars long"
WORDS = random.Random(7)
LONG = " ".join(WORDS.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(WORDS.randrange(999)) for _ in range(30_000))
COPY = " ".join(f"word{i}" for i in range(80))
ROWS = [(1, None), (2, ""), (3, "short text"), (4, LONG), (5, COPY), (6, COPY), (6, COPY), (7, COPY + " end"), (None, COPY), (8, " \n\t "), (9, "é😀 naïve")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *[None] * 14) for i, t in ROWS], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 0), (5, 1), (7, 1), (7, 1), (8, None), (99, 1), (None, 0)], "doc_id long, quality int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_ngram_join(docs, none):
    got = by_id(ngram_join.joined(docs))
    assert {k: r["component_id"] for k, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, None: None}
    assert [got[k]["n_shingles"] for k in (1, 2, 3, 5, 7, 8, 9, None)] == [0, 0, 1, 77, 78, 0, 1, 77]
    assert ngram_join.joined(none).count() == 0
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4", "5", "8", "9", "None"]


def test_ngram_join_with_clashing_names(spark):
    df = spark.createDataFrame([(1, COPY, 5), (2, COPY, 6)], "doc_id long, text string, _gone long").withColumnRenamed("_gone", "gone").withColumn("_gone", F.lit(1)).withColumn("GONE_", F.lit(2))
    left = ngram_join.one_of_each(df)
    assert left.columns == df.columns and [r["doc_id"] for r in left.collect()] == [1]


def test_ngram_join_like_brute_force(spark):
    """Sets of many sizes around the bound, in families, against all pairs."""
    r = random.Random(12)
    rows = []
    for f in range(14):
        base = [f"w{f}x{i}" if r.random() < 0.7 else f"c{r.randrange(30)}" for i in range(r.choice([5, 12, 40, 160]))]
        for _ in range(7):
            words = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 15)):
                words[r.randrange(len(words))] = f"v{r.randrange(400)}"
            rows.append((len(rows) + 1, " ".join(words[: len(words) - r.randrange(0, 3)])))
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or {tuple(w)} for i, w in ((i, t.split()) for i, t in rows)}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and part[a] != part[b]:
                lo, hi = sorted((part[a], part[b]))
                part = {i: lo if c == hi else c for i, c in part.items()}
    got = by_id(ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: g["component_id"] for i, g in got.items()} == part and {i: g["n_shingles"] for i, g in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(part.values())) < len(rows)


def test_unshared_shingles_are_not_shuffled(spark, monkeypatch):
    """Of 300 texts that share nothing but one pair's words, only a few bytes for each shingle of a prefix go through shuffles before the postings stand."""
    r, sc = random.Random(4), spark.sparkContext._jsc.sc()
    rows = [(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(2000))) for i in range(300)]
    rows.append((300, rows[7][1] + " more"))
    seen, plain = {}, ngram_join.stored

    def stored(df, label):
        out = plain(df, label)
        sc.listenerBus().waitUntilEmpty()
        seen.setdefault(label, (sc.statusStore().executorList(False).apply(0).totalShuffleWrite(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    got = by_id(ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: g["component_id"] for i, g in got.items()} == {i: 7 if i == 300 else i for i in range(301)}
    assert seen["postings"][0] - seen["records"][0] < 1_500_000 and 500 < seen["postings"][1] < 700


def test_prefixes_keep_what_sets_of_like_sizes_share(spark):
    import numpy as np

    r = np.random.default_rng(2)
    sizes = [1, 1, 5, 84, 85, 100, 100, 118, 119, 400]
    prefixes = [r.choice(60, min(s, 20), replace=False).astype(np.int64) * 0x123456789ABCD for s in sizes]
    rows = [(i, s, [int(x) for x in p], [0] * (len(p) * ngram_join.PARTS // 4)) for i, (s, p) in enumerate(zip(sizes, prefixes))]
    reps = spark.createDataFrame(rows, "doc_id long, size long, prefix array<long>, rest array<long>").repartition(3)
    bits = spark.sparkContext.broadcast(ngram_join.shared_bits(reps, 85))
    got = {(p["doc_id"], p["pos"], p["gram"]) for p in ngram_join.postings(reps, 85, bits).collect()}
    every = {(i, k, int(g)) for i, p in enumerate(prefixes) for k, g in enumerate(p)}
    like = lambda a, b: 100 * min(a, b) >= 85 * max(a, b)
    need = {(i, k, g) for i, k, g in every if any(i != j and g in prefixes[j] and like(sizes[i], sizes[j]) for j in range(len(sizes)))}
    assert need and need <= got <= every and not any(i == 9 for i, _, _ in got)


def test_suffix_filter_bounds_what_suffixes_share():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(50):
        grams = np.unique(r.integers(0, 1 << 64, r.integers(1, 300), dtype=np.uint64))
        ranked = r.permutation(grams)
        keep = ranked[: len(ranked) // 2 + 1]
        got = ngram_join.behind(keep, grams).view("<u2").reshape(len(keep), -1)
        for i in (0, len(keep) // 2, len(keep) - 1):
            want = np.bincount((ranked[i + 1 :] >> np.uint64(61)).astype(np.int64), minlength=ngram_join.PARTS)
            assert (got[i] == want).all()


def test_secrets(docs, none):
    blobs = secrets.unseen(id_text(docs), None, secrets.BASE)
    assert blobs.count() == 7 and secrets.scan(blobs, secrets.BASE).filter(F.size("spans") > 0).count() == 0
    assert secrets.update(none.select("doc_id", "text"), None, secrets.BASE).count() == 0


def test_secret_places(spark):
    """Positions after emoji, accents and very long texts, by plain patterns."""
    import re

    texts = ["😀é Password: 'abc.def' x", "z" * 300_000 + "\nAKIA" + "Q" * 20 + " " + "0123456789abcdef" * 2, None, "", "api_key=short api-key = nope_token:longenough1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    history = id_text(df)
    rows = secrets.findings(history, secrets.update(history, None, secrets.BASE), secrets.BASE, ["doc_id"]).collect()
    got = {r["doc_id"]: {f["kind"]: [tuple(s) for s in f["spans"]] for f in r["found"] if f["spans"]} for r in rows}
    for i, t in enumerate(texts):
        want = {r.kind: [m.span() for m in re.finditer(r.pattern, t or "") if len(m[r.group]) >= r.least] for r in secrets.BASE}
        assert got[i] == {k: v for k, v in want.items() if v}


def test_ledger_scans_only_what_it_lacks(spark):
    h = spark.createDataFrame([("a", 1, "password = hunter22"), ("b", 1, "password = hunter22"), ("a", 2, "x AKIA" + "Q" * 20)], "path string, version int, text string")
    ledger = secrets.update(h, None, secrets.BASE).cache()
    assert ledger.count() == 6
    assert secrets.unseen(h, ledger, secrets.BASE).count() == 0
    newer = (*secrets.BASE[:2], secrets.Rule("hex", 2, "[0-9a-f]+", 0, 30, "[0-9a-f]{30}"))
    # one new version of one rule, one new content: what is scanned are just the pairs that lack
    more = h.unionByName(spark.createDataFrame([("c", 1, "new text")], h.schema))
    need = {r["text"]: {tuple(n) for n in r["need"]} for r in secrets.unseen(more, ledger, newer).collect()}
    assert need == {"password = hunter22": {("hex", 2)}, "x AKIA" + "Q" * 20: {("hex", 2)}, "new text": {("assign", 1), ("access", 1), ("hex", 2)}}
    added = secrets.update(more, ledger, newer).select("kind", "version").collect()
    assert sorted(map(tuple, added)) == [("access", 1), ("assign", 1), ("hex", 2), ("hex", 2), ("hex", 2)]
    got = secrets.findings(h, ledger.unionByName(ledger), secrets.BASE, ["path", "version"]).collect()
    assert {(r["path"], r["version"]): [(f["kind"], [tuple(s) for s in f["spans"]]) for f in r["found"]] for r in got} == {("a", 1): [("assign", [(0, 19)])], ("b", 1): [("assign", [(0, 19)])], ("a", 2): [("access", [(2, 26)])]}


def test_pii(spark, docs, none):
    field = pii.fit(pii.labelled(spark))
    assert pii.found(none, field).count() == 0
    got = by_id(pii.found(docs, field))
    assert len(got) == 10 and all(not got[k]["base"] for k in got)
    texts = ["mail a.b@c.example.org, now", "é at 10.0.0.255 or 10.0.0.256", "card 4111 1111 1111 1111!", "tel +1 (555) 010-9999 x", "call 555-010-1234 now"]
    rows = by_id(pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field))
    spans = lambda i, c: [(s["kind"], texts[i][s["start"] : s["stop"]]) for s in rows[i][c]]
    assert [spans(i, "base") for i in range(5)] == [[("email", "a.b@c.example.org")], [("ip", "10.0.0.255")], [("card", "4111 1111 1111 1111")], [("phone", "+1 (555) 010-9999")], []]
    assert spans(4, "more") == [("phone", "555-010-1234")]


def test_viterbi_finds_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    field = pii.Field(r.standard_normal((9, 5)), r.standard_normal((5, 5)))
    sizes = np.array([1, 2, 4, 4])
    starts = np.array([0, 2, 5, 9])
    e = field.emissions(r.integers(0, 9, (13, 3)))
    got = field.decode(e, starts, sizes)
    for lo, n in zip(starts, sizes):
        value = lambda y: sum(e[lo + i, k] for i, k in enumerate(y)) + sum(field.change[a, b] for a, b in zip((0, *y), (*y, 0)))  # noqa: B023, E731
        assert tuple(got[lo : lo + n]) == max(itertools.product(range(5), repeat=int(n)), key=value)


def test_cutting_the_chain_leaves_the_best_path():
    import numpy as np

    r = np.random.default_rng(2)
    cut = 0
    for _ in range(200):
        field = pii.Field(np.zeros((1, 5)), r.standard_normal((5, 5)) * 0.7)
        sizes = r.integers(0, 30, 6)
        at = np.concatenate([[0], np.cumsum(sizes)])
        e = r.standard_normal((at[-1], 5)) * 2
        e[:, 0] += 3
        cut += int(field.surely_out(e).sum()) if len(e) else 0
        full = field.decode(e, at[:-1][sizes > 0], sizes[sizes > 0])
        assert (field.labels(e, at) == full).all()
    assert cut > 1000


def test_pii_precision_and_recall_on_held_out_rows(spark):
    """Words of held-out labelled rows (other values, words and sentences), by the field alone."""
    import numpy as np

    field, rolling = pii.fit(pii.labelled(spark)), pii.Rolling()
    hit = told = true = 0
    for r in pii.labelled(spark, seed=99, copies=10).collect():
        x = pii.of_words(r["words"], rolling)
        got, want = field.labels(field.emissions(x), np.array([0, len(x)])), np.array([pii.LABELS.index(z) for z in r["labels"]])
        hit, told, true = hit + ((got == want) & (want > 0)).sum(), told + (got > 0).sum(), true + (want > 0).sum()
    print("precision", hit / told, "recall", hit / true)
    assert hit / told >= 0.95 and hit / true >= 0.85


def test_pii_long_words_and_spelt_addresses(spark):
    field = pii.fit(pii.labelled(spark))
    texts = ["x" * 5000 + "1" * 200 + " call 555-010-1234 " + "w " * 3000, "write to susan [at] corner [dot] org today", "look at the dot on it"]
    rows = by_id(pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field))
    got = [[(s["kind"], texts[i][s["start"] : s["stop"]]) for s in rows[i]["more"]] for i in range(3)]
    assert got == [[("phone", "555-010-1234")], [("email", "susan [at] corner [dot] org")], []]


def test_quality(docs, none, labels):
    model = quality.fit(docs, labels)
    got = by_id(quality.scored(docs, model))
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["score"] == got[2]["score"] == model.prior
    assert quality.scored(none, model).count() == 0
    empty = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, empty).collect()} == {0.5}
    assert quality.kept(docs, labels).columns == docs.columns


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    n, right = scores.agg(F.count("*"), F.sum(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("int"))).first()
    assert right / n >= 0.9


def test_vptree(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    got = [tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 4, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 3, 0.0), (50, 3, 4, 0.0)]
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_vptree_skips_and_still_finds(spark):
    import numpy as np

    r = np.random.default_rng(2)
    centre = r.standard_normal((40, 8))
    v = centre[r.integers(0, 40, 4000)] + 0.05 * r.standard_normal((4000, 8))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit[::50] @ unit.T
    cos[np.arange(80), np.arange(0, 4000, 50)] = -2
    best = np.argsort(-cos, axis=1, kind="stable")[:, :5]
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        _, at = vptree.Tree(unit, leaf=64).search(unit[::50], np.arange(0, 4000, 50), np.arange(4000), 5, factor)
        assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(at, best)]) >= least


def test_decontam(spark, docs, none):
    bench = spark.createDataFrame([(1, "WORD3 word4, word5 word6 word7 word8 word9 word10 word11 word12 word13"), (2, None), (3, ""), (4, "naïve"), (1, "short text")], "item_id long, text string")
    got = by_id(decontam.judged(docs, bench))
    assert {k: (r["n_words"], r["n_hit"], r["n_items"]) for k, r in got.items()} == {1: (0, 0, 0), 2: (0, 0, 0), 3: (2, 2, 1), 4: (30000, 0, 0), 5: (80, 11, 1), 6: (80, 11, 1), 7: (81, 11, 1), None: (80, 11, 1), 8: (0, 0, 0), 9: (2, 1, 1)}
    assert got[9]["items_sha256"] == hashlib.sha256(b"4").hexdigest()
    assert decontam.judged(none, bench).count() == 0
    assert decontam.judged(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare1 x x rare2"), (2, "rare1 x x x x x x x x rare2"), (3, "rare2 only")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "rare1 rare2")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.proximity(docs, bench, slop=3).collect()} == {1}


def test_proximity_and_hits_on_random_texts(spark):
    """One stored index, two benchmarks, against slow counting."""
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    docs = [(i, text(r.randrange(0, 60))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    postings = decontam.index(decontam.id_text(frame))
    freq = {}
    for _, t in docs:
        for w in t.split():
            freq[w] = freq.get(w, 0) + 1
    for size, slop in ((4, 2), (3, 0)):
        items = [(i, text(r.randrange(1, 9))) for i in range(12)]
        got = by_id(decontam.judged(frame, spark.createDataFrame(items, "item_id long, text string"), size, slop, postings))
        for i, t in docs:
            ws, hit, names, near = t.split(), set(), set(), set()
            for j, x in items:
                xs = x.split()
                k = min(size, len(xs))
                for s in range(len(xs) - k + 1):
                    at = [p for p in range(len(ws) - k + 1) if ws[p : p + k] == xs[s : s + k]]
                    hit |= {q for p in at for q in range(p, p + k)}
                    names |= {j for _ in at}
                    rare = sorted((freq.get(xs[q], 0), q) for q in range(s, s + k))
                    a = [p - rare[0][1] for p, w in enumerate(ws) if w == xs[rare[0][1]]]
                    b = [p - rare[1][1] for p, w in enumerate(ws) if w == xs[rare[1][1]]] if k > 1 else a
                    near |= {j for p in a for q in b if abs(p - q) <= slop}
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["n_near"]) == (len(ws), len(hit), len(names), len(near))


def test_language_model(docs, none):
    got = recurrent_lm.scored(docs).collect()
    assert len(got) == len(ROWS) and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 30001, 5: 81, 6: 81, 7: 82, None: 81, 8: 1, 9: 3}
    assert recurrent_lm.scored(none).count() == 0


def test_language_model_sequences_cover_every_word(spark, docs):
    import numpy as np

    ids = recurrent_lm.id_text(docs)
    lexi = recurrent_lm.lexicon(recurrent_lm.word_counts(ids))
    rows = recurrent_lm.sequences(ids, spark.sparkContext.broadcast(lexi)).collect()
    seqs = [np.frombuffer(bytes(r["ids"]), np.int16) for r in rows]
    counts = {1: 1, 2: 1, 3: 3, 4: 30001, 5: 81, 6: 81, 7: 82, None: 81, 8: 1, 9: 3}
    sizes = [counts[r["doc_id"]] for r in docs.select("doc_id").collect()]
    assert len(seqs) == sum(-(-n // recurrent_lm.SPAN) for n in sizes)
    assert [len(s) - 1 for s in seqs] == [r["n"] for r in rows] and max(len(s) for s in seqs) == recurrent_lm.SPAN + 1
    assert sum(len(s) - 1 for s in seqs) == sum(sizes) == lexi.total
    assert sum(int(s[0]) == recurrent_lm.VOCAB + recurrent_lm.OPEN for s in seqs) == len(sizes)


def test_language_model_does_not_hang_on_partitions(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(0, 90)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (by_id(recurrent_lm.scored(x)) for x in (df.coalesce(1), df.repartition(7, F.col("doc_id") % 5)))
    assert all(abs(one[i]["score"] - other[i]["score"]) < 1e-3 for i in one) and all(abs(one[i]["base_score"] - other[i]["base_score"]) < 1e-9 for i in one)


def test_window_gradients_agree_with_differences():
    """Truncated backpropagation: the step that descend() takes lies along the slope of the window's log-likelihood, from a carried state."""
    import numpy as np

    r = np.random.default_rng(4)
    w = {k: v.astype(np.float64) for k, v in recurrent_lm.Gru.start().w.items()}
    rows = r.integers(0, 2048, (3, recurrent_lm.WINDOW + 1))
    rows[1, 20:], rows[2, 9:] = -1, -1
    h = r.standard_normal((3, recurrent_lm.HIDDEN)).astype(np.float32) * 0.5

    def value(weights):
        m = recurrent_lm.Gru(weights)
        live = rows[:, 1:].T >= 0
        hs, *_ = m.steps(np.maximum(rows[:, :-1].T, 0), h, live.sum(axis=1))
        return float(m.output(hs[1:][live].astype(np.float64), rows[:, 1:].T[live])[0].sum())

    big = {k: np.full(v.shape, 1e12) for k, v in w.items()}  # so that the step is the gradient times a constant
    moved = recurrent_lm.Gru({k: v.copy() for k, v in w.items()})
    moved.descend(rows, h, 1.0, big)
    for k, at in (("u", (3, 5)), ("u", (1, 60)), ("in", (int(rows[0, 4]), 30)), ("in", (int(rows[2, 2]), 3)), ("wo", (int(rows[0, 5]), 2)), ("bc", (7,))):
        grad = (moved.w[k][at] - w[k][at]) * 1e6 * 3
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        slope = (value(up) - value(down)) / 2e-2
        assert abs(grad - slope) < 2e-2 * max(1, abs(slope))


def test_gru_gradients_agree_with_differences():
    import numpy as np

    m = recurrent_lm.Gru.start()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    r = np.random.default_rng(0)
    hs, ids = r.standard_normal((6, recurrent_lm.HIDDEN)), np.array([0, 5, 70, 2047, recurrent_lm.VOCAB + 3, 64])
    grads = {k: np.zeros_like(v) for k, v in m.w.items()}
    base, dh = m.output(hs, ids, grads)
    for k, at in (("wc", (2, 1)), ("wo", (5, 3)), ("bo", (70,))):
        m.w[k][at] += 1e-6
        assert abs((m.output(hs, ids)[0].sum() - base.sum()) / 1e-6 - grads[k][at]) < 1e-4
        m.w[k][at] -= 1e-6
    hs[1, 2] += 1e-6
    assert abs((m.output(hs, ids)[0].sum() - base.sum()) / 1e-6 - dh[1, 2]) < 1e-4


def test_classes_sum_to_one():
    import numpy as np

    m = recurrent_lm.Gru.start()
    ids = np.arange(recurrent_lm.VOCAB + recurrent_lm.OPEN)
    h = np.tile(np.random.default_rng(0).standard_normal(recurrent_lm.HIDDEN).astype(np.float32), (len(ids), 1))
    assert abs(np.exp(m.output(h, ids)[0].astype(np.float64)).sum() - 1) < 1e-4


def test_state_is_carried_across_blocks():
    import numpy as np

    m = recurrent_lm.Gru.start()
    texts = [np.random.default_rng(i).integers(0, 2048, n) for i, n in enumerate((1, 5, 200, 63, 64, 65))]
    assert np.allclose(m.text_scores(texts, block=64), m.text_scores(texts, block=1000), rtol=1e-5)
    assert np.allclose(m.text_scores(texts, batch=2), [m.text_scores([t])[0] for t in texts], rtol=1e-5)


def test_language_model_counts_words_beyond_its_table(spark, monkeypatch):
    """With a table of few words, the rarer ones' counts reach the texts all the same."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[min(399, int(r.expovariate(0.02)))] for _ in range(r.randrange(0, 60))) + (f" x{i} x{i}" if i % 3 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    full = by_id(recurrent_lm.scored(df))
    monkeypatch.setattr(recurrent_lm, "lexicon", lambda counts, whole=recurrent_lm.lexicon: whole(counts, 20))
    part = by_id(recurrent_lm.scored(df))
    assert set(part) == set(full) and len(full) == 200
    for i, a in full.items():
        b = part[i]
        assert (a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["n_tokens"], b["n_known"], b["train_tokens"])
        assert abs(a["base_score"] - b["base_score"]) < 1e-6 and b["score"] < 0


def test_descent_reads_every_word_once_in_full_windows(monkeypatch):
    """Each sequence's windows come once and in order, with the state carried on, and few windows hold few rows."""
    import numpy as np

    w, r = recurrent_lm.WINDOW, random.Random(6)
    seqs = [np.array([2074, *range(i * 10000, i * 10000 + n)]) for i, n in enumerate([r.randrange(1, 300) for _ in range(400)] + [32, 64, 1500, 1])]
    told, sizes = {}, []

    def descend(self, rows, h, rate, sq):
        lengths = (rows[:, 1:] >= 0).sum(axis=1).tolist()
        assert lengths == sorted(lengths, reverse=True)
        sizes.append(len(rows))
        for row, n, state in zip(rows, lengths, h):
            i, at = divmod(int(row[1]), 10000)
            assert row[: n + 1].tolist() == seqs[i][at : at + n + 1].tolist() and (n == w or at + n == len(seqs[i]) - 1)
            assert state.tolist() == [at / w] * len(state) and told.get(i, 0) == at
            told[i] = at + n
        return h + 1

    monkeypatch.setattr(recurrent_lm.Gru, "descend", descend)
    recurrent_lm.Gru.start().learn(seqs, 0.1, 0)
    assert told == {i: len(s) - 1 for i, s in enumerate(seqs)}
    windows = [-(-(len(s) - 1) // w) for s in seqs]
    assert len(sizes) <= max(max(windows), -(-sum(windows) // 128)) + 2 and max(sizes) <= 128


def test_gru_works_in_memory_it_keeps():
    """Training and scoring touch no new memory once they have run on texts of like sizes."""
    import resource

    import numpy as np

    r = np.random.default_rng(0)
    seqs = [r.integers(0, recurrent_lm.VOCAB + recurrent_lm.OPEN, n) for n in r.integers(2, 400, 300)]
    m, words = recurrent_lm.Gru.start(), sum(map(len, seqs))
    for run in (lambda: m.learn(seqs, 0.1, 0), lambda: m.text_scores(seqs)):
        run()
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        run()
        assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < words / 20


def test_gru_windows_do_not_hang_on_what_lies_past_their_ends():
    """A sequence's states end with it, and one that ends in a window moves the weights as it does alone."""
    import numpy as np

    r, w = np.random.default_rng(2), recurrent_lm.WINDOW
    rows = r.integers(0, 2048, (3, w + 1))
    rows[1, 20:], rows[2, 2:] = -1, -1
    h, start = r.standard_normal((3, recurrent_lm.HIDDEN)) * 0.5, {k: v.astype(np.float64) for k, v in recurrent_lm.Gru.start().w.items()}
    big = {k: np.full(v.shape, 1e12) for k, v in start.items()}

    def moved(x, state):
        m = recurrent_lm.Gru({k: v.copy() for k, v in start.items()})
        after = np.array(m.descend(x, state, 1.0, {k: v.copy() for k, v in big.items()}))
        return after, {k: (m.w[k] - start[k]) * len(x) for k in start}

    after, step = moved(rows, h)
    alone = [moved(rows[i : i + 1], h[i : i + 1]) for i in range(3)]
    assert np.allclose(after, np.concatenate([a for a, _ in alone]))
    assert all(np.allclose(step[k], sum(s[k] for _, s in alone), rtol=1e-6, atol=1e-14) for k in start)


def test_places_of_words():
    import numpy as np

    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 100, 5000):
        words = np.sort(r.integers(0, 1 << 64, n, dtype=np.uint64))
        lexi = recurrent_lm.Lexicon(words, np.arange(n, dtype=np.int32), np.zeros(n), np.zeros(recurrent_lm.OPEN), 0, 0)
        asked = np.concatenate([words, words + np.uint64(1), words - np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        assert (lexi.places(asked) == np.minimum(np.searchsorted(words, asked), n - 1)).all()


def test_byte_bpe(docs, none):
    path, pattern = vocabulary()
    enc = byte_bpe.encoding(path, pattern)
    for chunk, overlap in ((8192, 256), (400, 60)):
        got = byte_bpe.digests(docs, path, pattern, chunk, overlap).collect()
        assert len(got) == len(ROWS)
        for r in got:
            text = next(t for i, t in ROWS if i == r["doc_id"]) or ""
            ids = enc.encode_ordinary(text)
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.digests(none, path, pattern).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern).filter(F.col("doc_id") == 9).first()["data"] == bytearray("é😀 naïve".encode())


def test_byte_bpe_shuffles_only_texts_too_long_for_a_row(spark):
    path, pattern = vocabulary()
    enc, sc = byte_bpe.encoding(path, pattern), spark.sparkContext._jsc.sc()
    texts = [LONG[: 20_000 + 1000 * i] + "😀" * (i % 3) for i in range(12)] + ["x" * 40_000, LONG[:8192], LONG[:8193]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shuffled(**row):
        def now():
            sc.listenerBus().waitUntilEmpty()
            return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

        before, got = now(), by_id(byte_bpe.digests(df, path, pattern, **row))
        for i, t in enumerate(texts):
            ids = enc.encode_ordinary(t)
            assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        return now() - before

    assert shuffled() < 1000
    assert shuffled(row=30_000) > 1000  # the longer ones are dealt over tasks, with the same ids


def stitched(text, size, step, pattern):
    import numpy as np

    offs = list(range(0, max(1, len(text) - size + step), step))
    bounds = [np.array([o + b for b in byte_bpe.boundaries(text[o : o + size], pattern)], np.int64) for o in offs]
    cuts = [0, *byte_bpe.stitch(text, offs, bounds, size, pattern), len(text)]
    return [text[a:z] for a, z in zip(cuts, cuts[1:])]


def test_stitching_random_texts():
    path, pattern = vocabulary()
    enc, r = byte_bpe.encoding(path, pattern), random.Random(3)
    for i in range(600):
        text = "".join(r.choice("ab  \n'stlve9.é!" if i % 2 else "aaaaaaaaab \n") for _ in range(r.randrange(40, 400)))
        pieces = stitched(text, 36, 20, pattern)
        assert "".join(pieces) == text and [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_one_endless_pre_token_in_linear_time():
    import time

    _, pattern = vocabulary()
    seconds = []
    for n in (200_000, 1_600_000):
        text = "a word " + "x" * n + " and more " * 900
        began = time.time()
        pieces = stitched(text, 8192, 7936, pattern)
        seconds.append(time.time() - began)
        assert "".join(pieces) == text and max(map(len, pieces)) <= n + 8192 + 20
    assert seconds[1] < 40 * max(seconds[0], 0.02)


def test_line_dedup(spark, docs, none):
    got = line_dedup.dedup(docs).select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", "kept").collect()
    want = {1: (0, 0, None), 2: (0, 0, ""), 5: (1, 0, COPY), 6: (1, 1, ""), 7: (1, 1, ""), None: (1, 0, COPY), 8: (2, 0, " \n\t ")}
    assert len(got) == len(ROWS) and all((r["n_lines"], r["n_removed"], r["kept"]) == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    assert line_dedup.dedup(none).count() == 0
    left = line_dedup.cleaned(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 5, None, 8, 9}


def test_line_dedup_random(spark):
    r = random.Random(5)
    lines = lambda: "\n".join(" ".join(r.choice("abc") for _ in range(r.randrange(3, 8))) for _ in range(r.randrange(1, 5)))
    rows = [(i, lines()) for i in range(60)]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :] or a == b

    before, short, want = [], set(), {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            w = line.split(" ")
            if len(w) >= 5:
                if not any(near(w, x) for x in before):
                    kept.append(line)
                before.append(w)
            elif line not in short:
                kept.append(line)
                short.add(line)
        want[i] = "\n".join(kept)
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("doc.doc_id").alias("doc_id"), "kept").collect()
    assert {x["doc_id"]: x["kept"] for x in got} == want


def test_line_dedup_short_repeats(spark):
    import corpus_pipeline as p

    long = "http://x/" + "y" * 300
    rows = [(1, f"a b\n\n{long}\na b\n\none two three four five"), (2, f"new\n \n{long}\na b"), (2, f"new\n \n{long}\na b"), (3, f"{long}\na b"), (None, "a b")]
    got = p.line_deduplication(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    want = [(1, f"a b\n\n{long}\n\none two three four five"), (2, "new\n "), (2, "new\n "), (None, "a b")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, want))


def test_suffix_dedup(docs, none):
    got = suffix_dedup.cleaned(docs).collect()
    assert len(got) == len(ROWS)
    n = len(COPY)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"]) == {1: (0, 0, 0), 2: (0, 0, 0), 3: (10, 0, 0), 5: (n, n, 1), 6: (n, n, 1), 7: (n + 4, n, 1), None: (n, n, 1)}[r["doc_id"]] for r in got if r["doc_id"] in (1, 2, 3, 5, 6, 7, None))
    assert suffix_dedup.cleaned(none).count() == 0


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup_random(spark, hot):
    from collections import Counter

    r = random.Random(9)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randrange(20, 90))) for _ in range(12)] + ["z" * 70, "xy" * 60]
    rows = [(i, "".join(r.choice(passages) if r.random() < 0.6 else "".join(r.choice("pqrst") for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    least = 50
    raws = {i: t.encode() for i, t in rows}
    count = Counter(b[s : s + least] for b in raws.values() for s in range(len(b) - least + 1))
    docs = suffix_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {x["doc_id"]: [tuple(y) for y in x["runs"]] for x in suffix_dedup.repeats(docs, least, block=2000, hot=hot).collect()}
    for i, b in raws.items():
        want = [(s, s + least) for s in range(len(b) - least + 1) if count[b[s : s + least]] > 1]
        assert suffix_dedup.without(b, found.get(i, [])) == suffix_dedup.without(b, want)


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = spark.createDataFrame(after.collect(), docs.schema)
    enc = byte_bpe.encoding(*vocabulary())
    want = {r["doc_id"]: len(enc.encode_ordinary(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in p.run(spark, DATA).collect()} == want
    assert os.path.isdir(DATA)
