"""Queries that SQL cannot express, over whole tables, against plain Python that shares nothing with them but their contracts."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from samelode.llm import pii, quality, recurrent_lm, vptree
from samelode.llm.q_byte_bpe import vocabulary
from samelode.llm.registry import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        total += sum(divmod(int(c) * 2, 10)) if i % 2 else int(c)
    return total % 10 == 0


def base_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def check_personal_data(spark, texts, folder):
    got = {r["doc_id"]: r for r in queries()["op2_personal_data"](spark, folder).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = base_spans(t)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert set(joined) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_personal_data(spark, texts):
    check_personal_data(spark, texts, DATA)


def test_personal_data_planted(spark, tmp_path):
    """Base spans next to all that may upset positions: emoji, accents, long texts, repeated matches, nulls."""
    bits = ["😀 a@b.co", "é+1 (555) 010-9999é", "10.0.0.1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "x" * 70000, "+12", "a@b", "a@b.c@d.e", "1.2.3.4.5", "\n\t", "00000000000000", "+1 2 3 4 5 6 7 8 9 0"]
    r = np.random.default_rng(1)
    docs = {i: "".join(str(x) for x in r.choice(np.array(bits, object), r.integers(0, 9))) for i in range(150)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_personal_data(spark, docs, str(tmp_path))


def test_quality_votes(spark, texts):
    """Scores by a loop over all labelled vectors, one cosine at a time."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if crc(r["doc_id"]) % 4 != 2}
    learnt = sorted(i for i in texts if i in known)
    assert model.labels.tolist() == [known[i] for i in learnt]

    def vector(t):
        x = next(v for _, v in quality.terms(quality.pa.RecordBatch.from_arrays([quality.pa.array([0]), quality.pa.array([t])], names=["doc_id", "text"]), quality.Rolling()))
        return model.project(x[None].copy())[0]

    ours = [vector(texts[i]) for i in learnt]
    assert np.allclose(ours, model.vectors, atol=5e-3)
    got = {r["doc_id"]: r for r in queries()["op3_quality"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        v = vector(t).astype(np.float64)
        near = sorted(((float(sum(a * b for a, b in zip(v, w))), y) for w, y in zip(model.vectors.astype(np.float64), model.labels)), reverse=True)[: model.k]
        weights = [max(0.0, c) ** model.power for c, _ in near]
        want = (sum(w * y for w, (_, y) in zip(weights, near)) + 0.02 * model.prior) / (sum(weights) + 0.02)
        assert abs(got[i]["score"] - want) < 5e-3
        assert got[i]["held_out"] == (crc(i) % 4 == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_language_model_base(spark, texts):
    toks = {i: [*SPACES.findall(lower(t)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in toks.items() if crc(i) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries()["op7_language_model"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, ws in toks.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 * len(ws)
    # on held-out texts the model says more than the unigram base
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_language_model_is_a_distribution():
    """All ways to go on from a state add up to one."""
    m = recurrent_lm.Gru.start()
    ids = np.arange(recurrent_lm.VOCAB + recurrent_lm.OPEN)
    seqs = [np.array([5, 7, int(i)]) for i in ids]
    prefix = m.text_scores([np.array([5, 7])])[0]
    assert abs(np.exp(m.text_scores(seqs) - prefix).sum() - 1) < 1e-3


def test_byte_bpe(spark, texts):
    import public_tokenizers
    import tiktoken

    path, pattern = vocabulary()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries()["op8_byte_bpe"](spark, DATA).collect()}
    assert set(got) == set(texts) and any(len(t) > 8192 for t in texts.values()) and pattern == public_tokenizers.PATTERN
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_suffix_dedup(spark, texts):
    raws = {i: t.encode() for i, t in texts.items()}
    count = Counter(b[s : s + 200] for b in raws.values() for s in range(len(b) - 199))
    got = {r["doc_id"]: r for r in queries()["op10_suffix_dedup"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, b in raws.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.5, 0.9)])
def test_nearest_recall_on_embeddings(spark, factor, least):
    """Several shards over the table, some of which queries skip."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in e.collect()}
    ids = np.array(sorted(rows))
    unit = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    got = {}
    for r in vptree.nearest(e, F.col("vec_id") % 50 == 0, factor=factor, shard_rows=40, leaf=16).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[int(i)] & set(ids[np.argsort(-cos[k], kind="stable")[:5]].tolist())) / 5 for k, i in enumerate(ids) if i % 50 == 0]
    print("recall", factor, np.mean(hits))
    assert len(got) == len(hits) and np.mean(hits) >= least


def test_shards_are_skipped_and_copies_spread(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal((12, 8))
    v = [(centre[i % 12] + 0.01 * r.standard_normal(8)).tolist() if i % 3 else centre[0].tolist() for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    placed, _, shards, per = vptree.sharded(vptree.usable(df), 50, 1500)
    assert placed.groupBy("cell", "sub").count().agg(F.max("count")).first()[0] <= 3 * per
    assert shards[:, 4].sum() == 1500
    got = [(x["query_id"], x["vec_id"]) for x in vptree.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=50).collect()]
    assert [w for q, w in got if q == 150] == [] or len([w for q, w in got if q == 150]) == 5
    m = np.array(v)
    for q in (0, 50, 100, 150):
        c = [-2 if j == q else float((m[q] * m[j]).sum() / (np.sqrt((m[q] * m[q]).sum()) * np.sqrt((m[j] * m[j]).sum()))) for j in range(1500)]
        want = sorted(range(1500), key=lambda j: (-c[j], j))[:5]
        assert {w for x, w in got if x == q} == set(want)


def plain_line_dedup(docs):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :] or a == b

    seen, before, out = set(), [], {}
    for i, t in sorted(docs.items()):
        kept, removed = [], 0
        for line in t.split("\n"):
            w, gone = line.split(" "), False
            if re.search(r"[^\x09-\x0D\x20]", line):
                gone = line in seen or (len(w) >= 5 and any(near(w, x) for x in before if abs(len(x) - len(w)) < 2 and (x[:2] == w[:2] or x[-2:] == w[-2:])))
                if line not in seen and len(w) >= 5:
                    before.append(w)
                seen.add(line)
            removed += gone
            kept += [] if gone else [line]
        text = "\n".join(kept)
        if not removed or text.strip(" "):
            out[i] = text
    return out


def test_pipeline_like_plain_python(spark, texts):
    import corpus_pipeline as p

    score = {r["doc_id"]: r["score"] for r in queries()["op3_quality"](spark, DATA).collect()}
    docs = {i: t for i, t in texts.items() if score[i] >= 0.7}
    docs = plain_line_dedup(docs)
    sets = {}
    for i, t in docs.items():
        w = SPACES.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    part = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and sets[b] and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((part[a], part[b]))
                part = {i: lo if c == hi else c for i, c in part.items()}
    docs = {i: t for i, t in docs.items() if part[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = WORDS.findall(lower(r["text"] or ""))
        k = min(10, len(w))
        windows |= {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if w else set()
    for k in {len(w) for w in windows}:
        mine = {w for w in windows if len(w) == k}
        docs = {i: t for i, t in docs.items() if not any(tuple(w[s : s + k]) in mine for w in [WORDS.findall(lower(t))] for s in range(len(w) - k + 1))}
    got = {r["doc_id"]: r["decoded_sha256"] for r in p.run(spark, DATA).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()}


def test_decontamination_stage_with_nulls_and_clashing_names(spark):
    import corpus_pipeline as p

    bad = next(r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(WORDS.findall(r["text"] or "")) >= 10)
    rows = [(None, bad, 1, 2), (None, "clean text", 1, 2), (7, bad, 1, 2), (7, "other text", 1, 2), (8, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit long, n_words long")
    left = p.benchmark_decontamination(spark, docs, DATA)
    assert left.columns == docs.columns and sorted(str(r["text"]) for r in left.collect()) == ["None", "clean text", "other text"]
