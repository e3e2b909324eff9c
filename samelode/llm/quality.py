"""Quality classifier by nearest-neighbour voting in a latent semantic space.

A text's terms are its byte trigrams in hashed buckets (root of the count) and a few measures of its form; a truncated
singular value decomposition of the labelled texts' weighted terms gives the space. The labelled vectors, at most
`most` of them (a documented bound: those with the smallest hashes of their ids, whatever the corpus holds), are
broadcast; each document is compared with all of them in blocks, exactly, and the k most similar vote with weights that
grow with their cosine, next to a small prior of the mean label.

Null and empty texts have the zero vector and score the mean label. Repeated documents score alike; of several labels
of one document the smallest counts, and of several texts under one doc_id the first in order is learnt from; null labels are ignored; without any labels every score is 0.5; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samelode.llm.common import SPACE, Rolling, id_text, slices, small_batches, word_bounds

BUCKETS = 2048
FORM = 10
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(batch: pa.RecordBatch, rolling: Rolling) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, BUCKETS + FORM values) of each row (doc_id, text)."""
    for ids, data, offs in slices(batch):
        starts, ends, at = word_bounds(data, offs)
        words = rolling.of(rolling.sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        wide = data.astype(np.uint32)
        grams = ((wide[:-2] * 65599 + wide[1:-1] * 2654435761 + wide[2:] * 40503) >> np.uint32(7)) % BUCKETS if len(data) > 2 else np.zeros(0, np.uint32)
        upper, digit, letter, space, line = _UPPER[data], _DIGIT[data], _LETTER[data], SPACE[data], data == 10
        for i, doc in enumerate(ids):
            lo, hi = int(offs[i]), int(offs[i + 1])
            out = np.zeros(BUCKETS + FORM, np.float32)
            n = hi - lo
            if n:
                if n > 2:
                    out[:BUCKETS] = np.sqrt(np.bincount(grams[lo : hi - 2], minlength=BUCKETS))
                w = words[at[i] : at[i + 1]]
                k = max(1, len(w))
                share = lambda x: x[lo:hi].sum() / n
                other = 1 - share(letter) - share(digit) - share(space)
                pairs = w[1:] * np.uint64(0x9E3779B97F4A7C15) ^ w[:-1] if len(w) > 1 else w
                repeat = 1 - len(np.unique(pairs)) / max(1, len(pairs))
                out[BUCKETS:] = (share(upper), share(digit), share(letter), other, share(space), share(line), len(np.unique(w)) / k, repeat, min(20, n / k) / 20, np.log1p(n) / 12)
            yield doc, out


@dataclass(frozen=True)
class Model:
    """The space and the labelled vectors in it."""

    idf: np.ndarray
    basis: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    form: float
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    power: float
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of terms; rows without terms are zero."""
        t = x[:, :BUCKETS] * self.idf
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        v = np.concatenate([t @ self.basis, self.form * (x[:, BUCKETS:] - self.mean) / self.scale], axis=1)
        v[~x.any(axis=1)] = 0
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        k = min(self.k, len(self.labels))
        for lo in range(0, len(x), block):
            cos = self.project(x[lo : lo + block]) @ self.vectors.T
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.broadcast_to(np.arange(k), (len(cos), k))
            weight = np.maximum(0, np.take_along_axis(cos, top, 1)).astype(np.float64) ** self.power
            out[lo : lo + block] = ((weight * self.labels[top]).sum(axis=1) + 0.02 * self.prior) / (weight.sum(axis=1) + 0.02)
        return np.clip(out, 0, 1)


def train(x: np.ndarray, labels: np.ndarray, dims: int = 48, k: int = 15, power: float = 8.0, form: float = 0.15) -> Model:
    """The space of the rows of terms, and their vectors."""
    prior = float(labels.mean()) if len(labels) else 0.5
    n = max(1, len(x))
    idf = np.log((1 + n) / (1 + (x[:, :BUCKETS] > 0).sum(axis=0))).astype(np.float32) + 1
    t = x[:, :BUCKETS] * idf
    t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
    _, vec = np.linalg.eigh(t.T @ t)
    basis = np.ascontiguousarray(vec[:, ::-1][:, :dims], dtype=np.float32)
    tail = x[:, BUCKETS:]
    mean = tail.mean(axis=0) if len(x) else np.zeros(FORM, np.float32)
    scale = np.maximum(tail.std(axis=0), 1e-3) if len(x) else np.ones(FORM, np.float32)
    model = Model(idf, basis, mean, scale, form, np.zeros((0, dims + FORM), np.float32), labels.astype(np.float64), k, power, prior)
    return Model(**model.__dict__ | {"vectors": model.project(x)})


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Model:
    """The model of at most `most` labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("quality")).dropna()
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    text = id_text(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("r")).select("doc_id", "r.text", "r.quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            rows = [x.astype(np.float16).tobytes() for _, x in terms(b, rolling)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "quality", "terms"])

    rows = text.mapInArrow(run, "doc_id long, quality double, terms binary").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["terms"], np.float16) for r in rows], np.float32).reshape(len(rows), BUCKETS + FORM)
    return train(x, np.array([r["quality"] for r in rows]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            x = [x for _, x in terms(b, rolling)]
            score = shared.value.score(np.stack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.7, most: int = 4000) -> DataFrame:
    """The documents, with all their columns, that score at least `least`; rows of a null doc_id are judged like others."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    small_batches(docs.sparkSession)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            text = b.column("text")
            rows = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), pa.array(["" if x is None else x for x in text.to_pylist()], pa.string())], names=["doc_id", "text"])
            x = [x for _, x in terms(rows, rolling)]
            if x:
                yield b.filter(pa.array(shared.value.score(np.stack(x)) >= least)).select(names)

    return docs.mapInArrow(run, schema)
