"""Gated recurrent language model with a class-factored output, trained by truncated backpropagation in numpy.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lowered; every text ends with one end token. The corpus counts of all
words of all training texts give the unigram base and the vocabulary: the `VOCAB` most frequent words in classes of equal
size, by frequency. P(word) = P(class | state) * P(word | class, state); any other word belongs to one of a few open
classes, told by its last byte and by whether it is ASCII, within which words follow their corpus counts.

Training reads every word of every training text. A text is a sequence (one longer than `SPAN` words is several, each told
the word before it); backpropagation is truncated to windows of `WINDOW` words, and the state goes on from window to
window. The model starts as the unigram model of the corpus counts. One pass over all sequences follows, in `PARTS` parts:
the sequences are dealt by a hash to groups of about `GROUP` words and to parts; for each part, every group starts from the
common weights and reads its sequences in an order that hangs on them alone, and the weights are averaged by numbers of
words. So the model does not hang on how the rows lie in files or partitions. Scoring reads each whole text; the hidden state is carried from window to
window, so a text's score is its full log-likelihood.

At most `KNOWN` words' counts, the most frequent, are broadcast; the counts of rarer words reach the texts by a join. Texts are
read twice, for the counts and for the numbers of their words, which are stored; training and scoring read those.

Null and empty texts are their end token alone; repeated rows each get their score; an empty table gives an empty table,
and without training texts every word is unknown; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samelode.llm.common import LOWER, Rolling, drop_stored, id_text, slices, small_batches, stored, word_bounds

VOCAB, PER_CLASS, HIDDEN, WINDOW, KNOWN = 2048, 64, 24, 32, 1 << 20
SPAN, GROUP, PARTS = 4096, 1 << 20, 4
END = np.uint64(0x454E44)
#: Kinds of last bytes: letters, digits, the common marks each alone, non-ASCII, others.
_KIND = np.zeros(256, np.int64)
_KIND[48:58] = 1
for _i, _c in enumerate(".,!*$%&#?"):
    _KIND[ord(_c)] = 2 + _i
_KIND[[*range(33), *"\"'()-/:;<=>@[\\]^_`{|}~+".encode()]] = 11
_KIND[128:] = 12
OPEN = 26
CLASSES = VOCAB // PER_CLASS
#: The class of each number, and its place there.
_CLASS = np.concatenate([np.arange(VOCAB) // PER_CLASS, CLASSES + np.arange(OPEN)]).astype(np.int16)
_INSIDE = np.arange(VOCAB + OPEN) % PER_CLASS
#: Memory that the models of a process work in.
_KEPT: dict[tuple, np.ndarray] = {}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0


def tokens(batch: pa.RecordBatch, rolling: Rolling) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word hashes, open classes, offsets): the words of each text and its end token."""
    # slices whose arrays stay in the cache and in memory that is used again
    for ids, data, offs in slices(batch, 1 << 18):
        data = LOWER[data]
        starts, ends, at = word_bounds(data, offs)
        n = len(starts)
        words = rolling.of(rolling.sums(data), starts, ends) if n else np.zeros(0, np.uint64)
        # from one word's start to the next there are but the word and spaces, which are ASCII
        kinds = _KIND[data[ends - 1]] * 2 + (np.maximum.reduceat(data, starts) > 127) if n else np.zeros(0, np.int64)
        out = np.full(n + len(ids), END)
        open_ = np.zeros(n + len(ids), np.int64)
        place = np.arange(n) + np.repeat(np.arange(len(ids)), np.diff(at))
        out[place], open_[place] = words, kinds
        yield ids, out, open_, at + np.arange(len(ids) + 1)


def distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, order, first): each word once, the order of all, and where each one's run begins in it; equal words in any order."""
    order = np.argsort(words)
    words = words[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    return words[first], order, first


def word_counts(docs: DataFrame, flush: int = 1 << 20) -> DataFrame:
    """(word, open, c): how often each word stands in the texts, added up by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, size = Rolling(), [], 0

        def add() -> pa.RecordBatch:
            w, k, c = (np.concatenate(x) for x in zip(*held))
            u, order, first = distinct(w)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(k[order[first]].astype(np.int32)), pa.array(np.add.reduceat(c[order], first))], names=["word", "open", "c"])

        for b in batches:
            for _, words, kinds, _ in tokens(b, rolling):
                u, order, first = distinct(words)
                held.append((u, kinds[order[first]], np.diff(first, append=len(words))))
                size += len(u)
            if size > flush:
                yield add()
                held, size = [], 0
        if held:
            yield add()

    return docs.mapInArrow(run, "word long, open int, c long").groupBy("word").agg(F.min("open").alias("open"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words (sorted hashes) with their rank by count and log10(count + 0.1); logarithms of the open classes' masses."""

    words: np.ndarray
    rank: np.ndarray
    logs: np.ndarray
    mass: np.ndarray
    total: int
    types: int

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where the first word of the table that is not less stands (the last one, if all are less): words are hashes, so their first bits tell nearly where."""
        if not hasattr(self, "starts"):
            self.shift = np.uint64(63 - len(self.words).bit_length())
            self.starts = np.r_[0, np.cumsum(np.bincount((self.words >> self.shift).astype(np.int64), minlength=2 << len(self.words).bit_length()))]
        most = len(self.words) - 1
        at = np.minimum(self.starts[words >> self.shift], most)
        less = np.flatnonzero(self.words[at] < words)
        while len(less):
            less = less[at[less] < most]
            at[less] += 1
            less = less[self.words[at[less]] < words[less]]
        return at

    def look(self, words: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, place, id): whether each word is in the table, where, and its number in the model."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64), VOCAB + kinds
        place = self.places(words)
        known = self.words[place] == words
        rank = self.rank[place]
        return known, place, np.where(known & (rank < VOCAB), rank, VOCAB + kinds)


def lexicon(counts: DataFrame, known: int = KNOWN) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the least count whose words all fit in the table, from a histogram of a few hundred steps
    step = F.floor(F.log2("c") * 8)
    held, least = 0, 1 << 30
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > known:
            break
        least = r["s"]
    top = counts.filter(step >= least).select("word", "open", "c").toArrow()
    order = np.lexsort((top["word"].to_numpy(), -top["c"].to_numpy()))
    words, c, kinds = (top[k].to_numpy()[order] for k in ("word", "c", "open"))
    words, c = words.view(np.uint64), c.astype(np.float64)
    mass = np.full(OPEN, 0.1)
    for r in counts.groupBy("open").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect():
        mass[r["open"]] += r["s"] + 0.1 * r["n"]
    np.subtract.at(mass, kinds[:VOCAB], c[:VOCAB] + 0.1)
    order = np.argsort(words)
    return Lexicon(words[order], order.astype(np.int32), np.log10(c[order] + 0.1), np.log10(np.maximum(mass, 0.1)), int(total["n"]), int(total["v"]))


class Gru:
    """Weights of the model; inputs are numbers of words, VOCAB + open class for others, and VOCAB + OPEN before a text."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    def room(self, name: str, shape: tuple, kind: np.dtype) -> np.ndarray:
        """An array of any content in memory that is kept for the next call under this name, of any model: new memory costs more than what is done in it."""
        size = math.prod(shape)
        if (name, kind) not in _KEPT or _KEPT[name, kind].size < size:
            _KEPT[name, kind] = np.empty(size, kind)
        return _KEPT[name, kind][:size].reshape(shape)

    def by_row(self, name: str, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the rows of (steps, n, size), numbered step by step, those of the numbers `at`."""
        flat = self.room(name, x.shape, x.dtype)
        np.copyto(flat, x)
        return self.taken(name, flat.reshape(-1, x.shape[2]), at)

    def taken(self, name: str, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.take(table, rows, axis=0, out=self.room(name + " taken", (len(rows), table.shape[1]), table.dtype), mode="clip")

    @classmethod
    def start(cls, lexi: Lexicon | None = None, seed: int = 3) -> Gru:
        """Small random weights; with a lexicon, the biases make its unigram model."""
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s, k=0.1: (k * r.standard_normal(s)).astype(np.float32)
        bc, bo = np.zeros(CLASSES + OPEN), np.zeros(VOCAB)
        if lexi is not None and len(lexi.words):
            counts = np.full(VOCAB, 0.1)
            common = lexi.rank < VOCAB
            counts[lexi.rank[common]] = 10 ** lexi.logs[common]
            bo = np.log(counts)
            bc = np.concatenate([np.log(counts.reshape(CLASSES, PER_CLASS).sum(axis=1)), lexi.mass * np.log(10)])
            bo, bc = bo - np.repeat(bo.reshape(CLASSES, PER_CLASS).max(axis=1), PER_CLASS), bc - bc.max()
        return cls({"in": f(VOCAB + OPEN + 1, 3 * h), "u": f(h, 3 * h, k=0.2), "wc": f(h, CLASSES + OPEN), "bc": bc.astype(np.float32), "wo": f(VOCAB, h), "bo": bo.astype(np.float32)})

    def steps(self, xs: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States before and after each step (steps, n, HIDDEN), the gates z, r and c, and what u makes of the states (steps, n, 3 * HIDDEN), of inputs (steps, n);
        at step t only the first sizes[t] rows go on. The arrays lie in memory unit by unit, and hold until the next call."""
        m, k, u = xs.shape[0], HIDDEN, np.ascontiguousarray(self.w["u"].T)
        # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2; the halves are taken of whole arrays, not in each step
        u[: 2 * k] *= 0.5
        gates, hus = (self.room(x, (m, 3 * k, len(h)), u.dtype) for x in ("gates", "hus"))
        np.copyto(gates, self.taken("in", self.w["in"], xs.reshape(-1)).reshape(m, len(h), 3 * k).transpose(0, 2, 1))
        gates[:, : 2 * k] *= 0.5
        hs, rh = self.room("hs", (m + 1, k, len(h)), u.dtype), np.empty((k, len(h)), u.dtype)
        hs[0] = h.T
        for n, old, new, hu, hzr, hc, zr, z, r, c in zip(sizes, hs, hs[1:], hus, hus[:, : 2 * k], hus[:, 2 * k :], gates[:, : 2 * k], gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]):
            np.matmul(u, old, out=hu)
            zr += hzr
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(r, hc, out=rh)
            c += rh
            np.tanh(c, out=c)
            np.subtract(old, c, out=new)
            new *= z
            new += c
            if n < len(h):
                new[:, n:] = old[:, n:]
        return tuple(x.transpose(0, 2, 1) for x in (hs, gates, hus))

    def output(self, hs: np.ndarray, ids: np.ndarray, grads: dict | None = None, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of P(id | state), an open class standing for all its words; with grads, puts the gradients there, times scale, and returns that of hs; they hold until the next call."""
        w, n, k = self.w, len(ids), hs.shape[1]
        cls = _CLASS[ids]
        # rows are kept by class from here on, so that what is done within classes is done on one array
        order = np.argsort(cls, kind="stable")
        cls, ids = cls[order], ids[order]
        edge = np.searchsorted(cls, np.arange(CLASSES + 1))
        inner = int(edge[-1])
        blocks = [(int(a), int(b), slice(c * PER_CLASS, (c + 1) * PER_CLASS)) for c, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]
        one = self.room("one", (n, k + 1), hs.dtype)
        one[:, :k], one[:, k] = self.taken("by class", hs, order), 1
        # logits stay within +-60, so that no row needs a maximum of its own
        p = np.matmul(one, np.concatenate([w["wc"], w["bc"][None]]), out=self.room("p", (n, CLASSES + OPEN), hs.dtype))
        np.clip(p, -60, 60, out=p)
        told, flat = np.arange(0, p.size, p.shape[1]) + cls, p.reshape(-1)
        logp = flat[told]
        np.exp(p, out=p)
        s = p @ np.ones(p.shape[1], p.dtype)
        logp -= np.log(s)
        wo = self.room("wo", (VOCAB, k + 1), w["wo"].dtype)
        wo[:, :k], wo[:, k] = w["wo"], w["bo"]
        e = self.room("e", (inner, PER_CLASS), hs.dtype)
        for a, b, block in blocks:
            np.matmul(one[a:b], wo[block].T, out=e[a:b])
        np.clip(e, -60, 60, out=e)
        own, inside = np.arange(0, e.size, PER_CLASS) + _INSIDE[ids[:inner]], e.reshape(-1)
        logp[:inner] += inside[own]
        np.exp(e, out=e)
        t = e @ np.ones(PER_CLASS, e.dtype)
        logp[:inner] -= np.log(t)
        out, dh = np.empty_like(logp), None
        out[order] = logp
        if grads is not None:
            p *= (-scale / s)[:, None]
            flat[told] += hs.dtype.type(scale)
            both = one.T @ p
            grads["wc"], grads["bc"] = both[:k], both[k]
            d = np.matmul(p, w["wc"].T, out=self.room("d", (n, k), hs.dtype))
            e *= (-scale / t)[:, None]
            inside[own] += hs.dtype.type(scale)
            back, both = self.room("back", (inner, k), hs.dtype), self.room("both", wo.shape, wo.dtype)
            if len(blocks) < CLASSES:
                both[:] = 0
            for a, b, block in blocks:
                np.matmul(e[a:b].T, one[a:b], out=both[block])
                np.matmul(e[a:b], w["wo"][block], out=back[a:b])
            grads["wo"], grads["bo"] = both[:, :k], both[:, k]
            d[:inner] += back
            dh = self.room("dh", d.shape, d.dtype)
            dh[order] = d
        return out, dh

    def learn(self, seqs: list[np.ndarray], rate: float, seed: int, batch: int = 128) -> None:
        """One pass of descent over sequences (the number before, then the numbers to tell), window after window, the state carried on. Sequences go side by side in
        lanes; where one ends, another starts with the next window. There are as many lanes, `batch` at most, as have sequences until the longest has ended."""
        sq = {k: np.full_like(v, 1e-4) for k, v in self.w.items()}
        windows = [-(-(len(s) - 1) // WINDOW) for s in seqs]
        lanes = [(0, i, []) for i in range(min(batch, -(-sum(windows) // max(windows, default=1))))]
        for i in sorted(range(len(seqs)), key=lambda i: -windows[i]):
            # the lane of the fewest windows takes the next longest sequence, so that all end together
            n, lane, mine = lanes[0]
            heapq.heapreplace(lanes, (n + windows[i], lane, mine))
            mine.append(i)
        r = np.random.default_rng(seed)
        queues = [[seqs[mine[j]] for j in r.permutation(len(mine))] for _, _, mine in sorted(lanes, key=lambda x: x[1])]
        live = [(q.pop(), 0, np.zeros(HIDDEN, np.float32), q) for q in queues]
        while live:
            live.sort(key=lambda x: x[1] - len(x[0]))
            rows = np.full((len(live), WINDOW + 1), -1, np.int64)
            for row, (s, at, _, _) in zip(rows, live):
                x = s[at : at + WINDOW + 1]
                row[: len(x)] = x
            after = self.descend(rows, np.stack([h for _, _, h, _ in live]), rate, sq).copy()
            before, live = live, []
            for (s, at, _, q), h in zip(before, after):
                if at + WINDOW < len(s) - 1:
                    live.append((s, at + WINDOW, h, q))
                elif q:
                    live.append((q.pop(), 0, np.zeros(HIDDEN, np.float32), q))

    def descend(self, rows: np.ndarray, h: np.ndarray, rate: float, sq: dict[str, np.ndarray]) -> np.ndarray:
        """One step on windows of inputs and targets (n, WINDOW + 1), -1 past the end of a sequence, longest first, from the states h; returns the states behind them."""
        k, y, kind = HIDDEN, rows[:, 1:], self.w["u"].dtype
        sizes = (y >= 0).sum(axis=0)
        m = int((sizes > 0).sum())
        y, xs = np.ascontiguousarray(y[:, :m].T).reshape(-1), np.maximum(rows[:, :m].T, 0)
        hs, gates, hus = self.steps(xs, h, sizes)
        g: dict[str, np.ndarray] = {}
        live = np.flatnonzero(y >= 0)
        _, dh = self.output(self.by_row("states", hs[1:], live), y[live], g, 1 / len(rows))
        # past the end of a sequence nothing comes back, so all its slopes are zero there
        flat = self.room("slopes by row", (m * len(h), k), kind)
        flat[:] = 0
        flat[live] = dh
        dhs = self.room("slopes", (m, k, len(h)), kind)
        np.copyto(dhs, flat.reshape(m, len(h), k).transpose(0, 2, 1))
        hs, gates, hus = (x.transpose(0, 2, 1) for x in (hs, gates, hus))
        z, r, c = (gates[:, i * k : (i + 1) * k] for i in range(3))
        # what a slope of the state is multiplied by to be one of the inputs of c, z and r, of the recurrent part of c, and of the state before by z
        to, flow = (self.room(x, (m, 5, k, len(h)), kind) for x in ("to", "flow"))
        to_c, to_z, to_r, to_h = (to[:, i] for i in range(4))
        rest = np.subtract(1, z, out=self.room("rest", z.shape, kind))
        np.multiply(c, c, out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= rest
        rest *= z
        np.subtract(hs[:-1], c, out=to_z)
        to_z *= rest
        np.multiply(to_c, r, out=to_h)
        np.subtract(1, r, out=to_r)
        to_r *= to_h
        to_r *= hus[:, 2 * k :]
        to[:, 4] = z
        lead = np.concatenate([self.w["u"], np.eye(k, dtype=kind)], axis=1)
        back = np.zeros((k, len(h)), kind)
        flat = flow.reshape(m, 5 * k, len(h))
        for d, x, f, u in zip(dhs[::-1], to[::-1], flow[::-1], flat[::-1, k:]):
            d += back
            np.multiply(d, x, out=f)
            np.matmul(lead, u, out=back)
        g["u"] = np.matmul(hs[:-1], flat[:, k : 4 * k].transpose(0, 2, 1)).sum(axis=0)
        at = xs.reshape(-1)[live].astype(np.int16)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        inputs = np.add.reduceat(self.by_row("inputs", flat[:, : 3 * k].transpose(0, 2, 1), live[order]), first, axis=0)
        inputs = np.concatenate([inputs[:, k:], inputs[:, :k]], axis=1)
        for name, grad in g.items():
            square = np.multiply(grad, grad, out=self.room("square", grad.shape, kind))
            sq[name] += square
            np.sqrt(sq[name], out=square)
            np.divide(grad, square, out=square)
            square *= kind.type(rate)
            self.w[name] += square
        at = at[first]
        seen = sq["in"][at] + inputs * inputs
        sq["in"][at] = seen
        self.w["in"][at] += kind.type(rate) * inputs / np.sqrt(seen)
        return hs[m].T

    def text_scores(self, texts: list[np.ndarray], batch: int = 256, block: int = 32) -> np.ndarray:
        """Natural log-likelihood of each text's numbers, whole; the state goes on from block to block."""
        out = np.zeros(len(texts))
        order = np.argsort([len(t) for t in texts], kind="stable")[::-1]
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            sizes = np.array([len(texts[i]) for i in part])
            h = np.zeros((len(part), HIDDEN), np.float32)
            last = np.full(len(part), VOCAB + OPEN)
            for t0 in range(0, int(sizes[0]), block):
                steps, n = min(block, int(sizes[0]) - t0), int((sizes > t0).sum())
                ids = np.full((n, steps), -1)
                for j in range(n):
                    x = texts[part[j]][t0 : t0 + steps]
                    ids[j, : len(x)] = x
                ids = np.ascontiguousarray(ids.T)
                xs = np.concatenate([last[None, :n], np.maximum(ids[:-1], 0)])
                hs, *_ = self.steps(xs, h[:n], (ids >= 0).sum(axis=1))
                h[:n], last[:n] = hs[steps], ids[-1]
                live = np.flatnonzero(ids >= 0)
                logp, _ = self.output(self.by_row("states", hs[1:], live), ids.reshape(-1)[live])
                out[part[:n]] += np.bincount(live % n, logp.astype(np.float64), minlength=n)
        return out


def _as_bytes(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values from each place in `at` to the next, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def numbered(docs: DataFrame, lex) -> DataFrame:
    """(doc_id, n, known, logs, inner, rare, ids): each text's tokens, those in the table of words, the sum of their logarithms and of those
    within open classes, and as bytes the words not in the table and the numbers of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            for docs, words, kinds, at in tokens(b, rolling):
                known, place, num = lex.value.look(words, kinds)
                logs = np.where(known, lex.value.logs[place], 0.0) if len(lex.value.logs) else np.zeros(len(words))
                inner = np.where(num >= VOCAB, logs - lex.value.mass[np.maximum(num - VOCAB, 0)], 0.0)
                lack = ~known
                # every text has its end token, so no sum is of nothing
                n, lacks = np.diff(at), np.add.reduceat(lack.astype(np.int64), at[:-1])
                cols = [pa.array(docs, pa.int64()), *(pa.array(x) for x in (n, n - lacks, np.add.reduceat(logs, at[:-1]), np.add.reduceat(inner, at[:-1])))]
                cols += [_as_bytes(words[lack], np.concatenate([[0], np.cumsum(lacks)])), _as_bytes(num.astype(np.int16), at)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "known", "logs", "inner", "rare", "ids"])

    return docs.mapInArrow(run, "doc_id long, n long, known long, logs double, inner double, rare binary, ids binary")


def rare_words(numbers: DataFrame) -> DataFrame:
    """(key, word, tf): how often each word that is not in the table stands in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = []
            for key, rare in zip(b.column("key").to_pylist(), b.column("rare").to_pylist()):
                u, order, first = distinct(np.frombuffer(rare, np.int64))
                cols.append((np.full(len(u), key), u, np.diff(first, append=len(order))))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols)], names=["key", "word", "tf"])

    return numbers.filter(F.length("rare") > 0).select("key", "rare").mapInArrow(run, "key long, word long, tf long")


def cut(numbers: DataFrame, span: int = SPAN) -> DataFrame:
    """(mix, n, ids): the sequences of each numbered text, that tell all its words once: the number before, then at most `span` numbers, as
    bytes; n counts them; mix is a hash of the id and of the sequence's place."""
    start = np.int16(VOCAB + OPEN).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = ([], [], [])
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                for k, a in enumerate(range(0, len(ids), 2 * span)):
                    told = ids[a : a + 2 * span]
                    for c, v in zip(cols, (zlib.crc32(f"{doc} {k}".encode()), len(told) // 2, (ids[a - 2 : a] if k else start) + told)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["mix", "n", "ids"])

    return numbers.select("doc_id", "ids").mapInArrow(run, "mix long, n long, ids binary")


def sequences(docs: DataFrame, lex, span: int = SPAN) -> DataFrame:
    """The sequences of texts."""
    return cut(numbered(docs, lex), span)


def _local(shared, rate: float, seed: int):
    """A group's own descent from the shared weights: (salt, grp, n, w)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix", "ids"], kind="stable")
        mine, n = Gru(pickle.loads(shared.value)), int(rows["n"].sum())
        mine.learn([np.frombuffer(x, np.int16) for x in rows["ids"]], rate, seed)
        return pd.DataFrame({"salt": [key[0] % 16], "grp": [key[0]], "n": [n], "w": [pickle.dumps(mine.w)]})

    return run


def train(seqs: DataFrame, model: Gru, total: int, parts: int = PARTS, group: int = GROUP) -> Gru:
    """The model after one pass of averaged local descent over all sequences, `total` words in all, a part at a time."""
    groups = max(1, -(-total // group))
    deal = F.pmod(F.xxhash64("mix"), F.lit(groups * parts))
    dealt = stored(seqs.withColumn("group", F.floor(deal / parts).cast("int")).withColumn("part", (deal % parts).cast("int")), "sequences", "part")
    schema = "salt int, grp int, n long, w binary"
    for i in range(parts):
        shared = seqs.sparkSession.sparkContext.broadcast(pickle.dumps(model.w))

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            salt, n, total = None, 0, None
            for b in batches:
                for s, m, blob in zip(b["salt"], b["n"], b["w"]):
                    if s != salt and total is not None:
                        yield pd.DataFrame({"salt": [salt], "grp": [0], "n": [n], "w": [pickle.dumps(total)]})
                        n, total = 0, None
                    w = {k: v.astype(np.float64) * m for k, v in pickle.loads(blob).items()}
                    salt, n, total = s, n + int(m), w if total is None else {k: total[k] + w[k] for k in w}
            if total is not None:
                yield pd.DataFrame({"salt": [salt], "grp": [0], "n": [n], "w": [pickle.dumps(total)]})

        learnt = dealt.filter(F.col("part") == i).drop("part").repartitionByRange(groups, "group").groupBy("group").applyInPandas(_local(shared, 0.1, i), schema)
        folded = learnt.repartition(16, "salt").sortWithinPartitions("salt", "grp").mapInPandas(fold, schema).collect()  # at most 16 rows
        n, total_w = 0, None
        for r in sorted(folded, key=lambda r: r["salt"]):
            w = pickle.loads(r["w"])
            n, total_w = n + r["n"], w if total_w is None else {k: total_w[k] + w[k] for k in w}
        if n:
            model = Gru({k: (v / n).astype(np.float32) for k, v in total_w.items()})
    drop_stored(dealt)
    return model


def scored(docs: DataFrame, most_tokens: int = 1 << 21) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document, learnt from those not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = id_text(docs)
    learnt = ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    counts = stored(word_counts(docs.filter(learnt)), "word-counts")
    lexi = lexicon(counts)
    numbers = stored(numbered(docs, spark.sparkContext.broadcast(lexi)).withColumn("key", F.monotonically_increasing_id()), "numbers")
    model = train(cut(numbers.filter(learnt)), Gru.start(lexi), lexi.total)
    shared = spark.sparkContext.broadcast(pickle.dumps(model.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru, held, size = Gru(pickle.loads(shared.value)), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lm, at = gru.text_scores([np.frombuffer(x, np.int16) for b in held for x in b.column("ids").to_pylist()]) / np.log(10), 0
            for b in held:
                told = pa.array(lm[at : at + b.num_rows] + b.column("inner").to_numpy())
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("key", "doc_id", "n", "known", "logs")] + [told], names=["key", "doc_id", "n", "known", "logs", "lm"])

        for b in batches:
            held.append(b)
            size += int(b.column("n").to_numpy().sum())
            if size >= most_tokens:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    rows = stored(numbers.drop("rare").mapInArrow(run, "key long, doc_id long, n long, known long, logs double, lm double"), "scores")
    unknown = stored(rare_words(numbers), "rare-words")
    drop_stored(numbers)
    looked = unknown.join(counts.select("word", "c"), "word", "left")
    more = looked.groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("found"))
    spread = float(np.log10(lexi.total + 0.1 * (lexi.types + 1)))
    more_logs, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return rows.join(more, "key", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + found).cast("long").alias("n_known"),
        F.lit(lexi.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n") * F.lit(spread)).alias("base_score"),
        (F.col("lm") + more_logs).alias("score"),
    )
