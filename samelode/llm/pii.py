"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base kinds email, ip, card and phone come from patterns, leftmost and non-overlapping for each kind. The random
field adds spans of the same kinds that the patterns miss (a phone number without its plus sign, a card number with
dots, an address spelt with "at" and "dot"). It labels every word of every text by its shape, its neighbours' shapes, the
words themselves and what they hold; it is trained by gradient ascent on the log-likelihood (forward-backward in numpy)
of a small labelled table of at most `most` sentences. Viterbi runs in numpy batches. A word whose emissions prefer O by
more than any neighbours' transitions can make up for is O on the best path whatever stands around it; the chain is cut
there, which leaves the best path as it is, and the runs between are decoded together by length. A span it adds overlaps
no base span.

Null and empty texts hold nothing; repeated rows give repeated rows; an empty table gives an empty table; extra columns
are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.llm.common import LOWER, Rolling, id_text, slices, small_batches, word_bounds

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
FEATURES = 1 << 16

# The base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards: a run of local characters, cut at the last match, and a domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = text[done:at]
        start = done + len(left.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each base kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return out


#: Bytes to classes: digits, small and capital letters, non-ASCII; any other byte is its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = 1, 2, 3, 4
#: How much of a run of a class the shape keeps.
_CAP = np.ones(256, np.int64)
_CAP[1:5] = 4
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,:;!?")] = True


def _number(kind: int, *values: np.ndarray) -> np.ndarray:
    """Feature numbers of values of one kind."""
    x = np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for v in values:
        x = (x ^ v.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(20)).astype(np.int64) % FEATURES


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, rolling: Rolling) -> np.ndarray:
    """(words, kinds) feature numbers of the words of texts; at: the number of words before each text."""
    if not len(starts):
        return np.zeros((0, 11), np.int64)
    cls = _CLASS[data]
    new = np.r_[True, cls[1:] != cls[:-1]]
    new[starts] = True
    run = np.arange(len(cls)) - np.maximum.accumulate(np.where(new, np.arange(len(cls)), 0))
    kept = run < _CAP[cls]
    before = np.concatenate([[0], np.cumsum(kept)])
    shape = rolling.of(rolling.sums(cls[kept]), before[starts], before[ends])
    low = LOWER[data]
    a, z = starts.copy(), ends.copy()
    for _ in range(3):  # marks at the edges of a word, three of them
        z -= (z > a + 1) & _EDGE[data[z - 1]]
        a += (z > a + 1) & _EDGE[data[a]]
    word = rolling.of(rolling.sums(low), a, z)
    inside = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask)]))
    digits, ats, dots = inside(cls == 1), inside(data == 64), inside(data == 46)
    first, last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    last[at[1:][at[:-1] < at[1:]] - 1] = True
    back = lambda x: np.where(first, np.uint64(1), np.r_[x[:1], x[:-1]])
    on = lambda x: np.where(last, np.uint64(2), np.r_[x[1:], x[-1:]])
    return np.stack(
        [_number(1, shape), _number(2, back(shape), shape), _number(3, shape, on(shape)), _number(4, np.minimum(digits, 24)), _number(5, np.minimum(ats, 2), np.minimum(dots, 4)),
         _number(6, data[starts]), _number(7, back(word)), _number(8, on(word)), _number(9, word), _number(10, back(digits.astype(np.uint64)), digits, on(digits.astype(np.uint64))), _number(11, back(word), on(word))],
        axis=1,
    )


def of_words(words: list[str], rolling: Rolling) -> np.ndarray:
    """Features of one text, given as its words."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, at = word_bounds(data, np.array([0, len(data)]))
    return features(data, starts, ends, at, rolling)


@dataclass(frozen=True)
class Field:
    """Weights by feature and label, and of neighbouring labels; label O surrounds each run."""

    weight: np.ndarray
    change: np.ndarray

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        """(..., labels) of features (..., kinds)."""
        out = self.weight[feats[..., 0]]
        for k in range(1, feats.shape[-1]):
            out = out + self.weight[feats[..., k]]
        return out

    def surely_out(self, e: np.ndarray) -> np.ndarray:
        """The words that are O on every best path: no neighbours can make up for what another label lacks there."""
        gain = (self.change - self.change[:, :1]).max(axis=0) + (self.change - self.change[:1]).max(axis=1)
        return (e[:, :1] - e[:, 1:] > gain[1:] + 1e-4).all(axis=1)

    def decode(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best label of each word, by Viterbi over all runs of a length together; a run is e[start : start + size], with O around it, and words in no run are O."""
        out = np.zeros(len(e), np.int64)
        for n in np.unique(sizes):
            at = starts[sizes == n]
            x = e[at[:, None] + np.arange(n)]
            best, back = x[:, 0] + self.change[0], []
            for t in range(1, n):
                step = best[:, :, None] + self.change[None]
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + x[:, t]
            label = (best + self.change[:, 0]).argmax(axis=1)
            out[at + n - 1] = label
            for t in range(n - 2, -1, -1):
                label = back[t][np.arange(len(at)), label]
                out[at + t] = label
        return out

    def labels(self, e: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Best label of every word of texts; at: the number of words before each text."""
        open_ = ~self.surely_out(e)
        new = open_.copy()
        new[1:] &= ~open_[:-1]
        edge = at[:-1][at[:-1] < len(e)]
        new[edge] = open_[edge]
        starts = np.flatnonzero(new)
        ends = np.flatnonzero(open_ & np.r_[(~open_ | new)[1:], True]) + 1
        return self.decode(e, starts, ends - starts)


def _sums(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(runs: list[np.ndarray], labels: list[list[int]], rounds: int = 80, rate: float = 0.2, decay: float = 2e-3) -> Field:
    """The field of greatest penalised likelihood, by Adam on exact gradients; runs: the features of each sentence."""
    k = len(LABELS)
    by_length = defaultdict(list)
    for r, y in zip(runs, labels):
        if len(r):
            by_length[len(r)].append((r, y))
    # only features that occur have weights to learn; the words of all sentences lie one after the other
    used, all_ = np.unique(np.concatenate([np.stack([r for r, _ in g]).ravel() for _, g in sorted(by_length.items())]), return_inverse=True) if by_length else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    groups, at = [], 0
    for n, g in sorted(by_length.items()):
        size = len(g) * n * g[0][0].shape[1]
        groups.append((n, all_[at : at + size].reshape(len(g), n, -1), np.array([y for _, y in g])))
        at += size
    order = np.argsort(all_, kind="stable")
    first = np.searchsorted(all_[order], np.arange(len(used)))
    owner = order // (groups[0][1].shape[2] if groups else 1)
    w, c = np.zeros((len(used), k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)]
    for step in range(1, rounds + 1 if groups else 1):
        gc, field, off = -decay * c, Field(w, c), []
        for n, x, y in groups:
            e = field.emissions(x)
            fwd = [e[:, 0] + c[0]]
            for t in range(1, n):
                fwd.append(_sums(fwd[-1][:, :, None] + c[None], 1) + e[:, t])
            bwd = [np.broadcast_to(c[:, 0], e[:, 0].shape)]
            for t in range(n - 1, 0, -1):
                bwd.append(_sums(c[None] + (bwd[-1] + e[:, t])[:, None, :], 2))
            bwd = bwd[::-1]
            total = _sums(fwd[-1] + c[:, 0], 1)
            d = np.eye(k)[y] - np.exp(np.stack(fwd, 1) + np.stack(bwd, 1) - total[:, None, None])
            off.append(d.reshape(-1, k))
            gc[0] += d[:, 0].sum(axis=0)
            gc[:, 0] += d[:, -1].sum(axis=0)
            for t in range(n - 1):
                both = np.exp(fwd[t][:, :, None] + c[None] + (bwd[t + 1] + e[:, t + 1])[:, None, :] - total[:, None, None])
                gc -= both.sum(axis=0)
                np.add.at(gc, (y[:, t], y[:, t + 1]), 1)
        gw = np.add.reduceat(np.concatenate(off)[owner], first, axis=0) - decay * w
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (c, gc, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weight = np.zeros((FEATURES, k), np.float32)
    weight[used] = w
    return Field(weight, c.astype(np.float32))


def labelled(spark: SparkSession, seed: int = 5, copies: int = 24) -> DataFrame:
    """A small labelled table (words, labels): values of each kind, and numbers that are none, among invented words. Another seed gives other values, words and sentences."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))

    def word() -> str:
        w = "".join(pick(["th", "an", "er", "ou", "le", "ch", "é", "ü", "i", "o", "nd", "ra", "st", "ment", "ión"]) for _ in range(int(rng.integers(1, 5))))
        w = pick([str, str, str, str.capitalize, str.upper])(w)
        return w + pick(["", "", "", "", ",", ".", "!!", "&&&", ":"])

    def name() -> str:
        return "".join(pick("abcdefghijklmnoprstuvw") for _ in range(int(rng.integers(3, 8))))

    def card(sep: str) -> str:
        body = d(15)
        digits = body + next(x for x in "0123456789" if luhn(body + x))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    end = lambda: pick(["com", "org", "net", "de", "fr"])
    forms = {
        "phone": [lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(3)}"],
        "card": [lambda: card(" "), lambda: card("-"), lambda: card(""), lambda: card(".")],
        "ip": [lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), lambda: "[.]".join(str(x) for x in rng.integers(0, 256, 4))],
        "email": [lambda: f"{name()}{d(2)}@{name()}.{end()}", lambda: f"{name()}.{d(2)}@mail{d(1)}.{name()}.{end()}", lambda: f"{name()} [at] {name()} [dot] {end()}", lambda: f"{name()}(at){name()}.{end()}", lambda: f"{name()} at {name()} dot {end()}"],
        "O": [lambda: d(4), lambda: d(2), lambda: d(1), lambda: f"{d(1)}.{d(2)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: f"x{d(3)}", lambda: f"{d(1)},{d(3)}", lambda: f"#{d(5)}", lambda: "@home", lambda: f"{d(3)}%", lambda: f"a{d(12)}f", lambda: f"{d(2)} {d(4)}", lambda: f"{d(1)} {d(1)} {d(2)}", lambda: d(20), lambda: f"{word()} at {word()}", lambda: f"dot {word()}", lambda: d(7)],
    }
    cues = ["call", "tel", "the number is", "write to", "seen at", "pay with", "from", "in", "mail", "by", "card", "it", "with"]
    rows = []
    for _ in range(copies):
        for kind, makers in forms.items():
            for make in makers:
                value = make().split(" ")
                lead = [word() for _ in range(int(rng.integers(0, 5)))] + (pick(cues).split(" ") if rng.random() < 0.5 else [])
                tail = [word() for _ in range(int(rng.integers(0, 5)))]
                if rng.random() < 0.3:
                    value[-1] += pick([".", ",", "!"])
                rows.append((lead + value + tail, ["O"] * len(lead) + [kind] * len(value) + ["O"] * len(tail)))
    return spark.createDataFrame(rows, "words array<string>, labels array<string>")


def fit(table: DataFrame, most: int = 2000) -> Field:
    """The field of a labelled table (words, labels) of at most `most` rows; more are refused."""
    rows = table.select("words", "labels").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    rolling = Rolling()
    return train([of_words(r["words"], rolling) for r in rows], [[LABELS.index(x) for x in r["labels"]] for r in rows])


_TRIM = ".,;:!?()[]{}<>\"'"
#: Digits that a span of each kind must hold to be added, fewest and most.
_SPELT = re.compile(r"\w(?:@|\s?[\[(]?\bat\b[\])]?\s?)\w+(?:\.|\s?[\[(]?\bdot\b[\])]?\s?)\w", re.IGNORECASE)
_DIGITS = {"email": (0, 99), "ip": (4, 12), "card": (13, 19), "phone": (9, 15)}


def added(words: list[tuple[int, int, str]], labels: np.ndarray, base: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Spans of a decoded run of words (start, end, word): neighbours of one label together, trimmed, that look right and overlap no base span."""
    i = 0
    while i < len(words):
        j = i + 1
        while j < len(words) and labels[j] == labels[i]:
            j += 1
        if labels[i]:
            kind, start, end = LABELS[labels[i]], words[i][0], words[j - 1][1]
            start += len(words[i][2]) - len(words[i][2].lstrip(_TRIM))
            end -= len(words[j - 1][2]) - len(words[j - 1][2].rstrip(_TRIM))
            text = " ".join(w for _, _, w in words[i:j])
            n = sum(c in "0123456789" for c in text)
            fits = _DIGITS[kind][0] <= n <= _DIGITS[kind][1] and (kind != "email" or _SPELT.search(text)) and (kind != "card" or luhn(_NO_DIGITS.sub("", text)))
            if kind == "ip":
                parts = [p for p in _NO_DIGITS.split(text) if p]
                fits = fits and len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
            if end > start and fits and all(b <= start or a >= end for a, b in base):
                yield kind, start, end
        i = j


def found(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, more) of each document: arrays of (kind, start, end); `more` are the spans that the field adds."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    mark = np.zeros(256, bool)
    mark[[64, *range(48, 58)]] = True
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, field = Rolling(), shared.value
        for b in batches:
            texts, done, base, more = b.column("text"), 0, [], []
            for ids, data, offs in slices(b):
                starts, ends, at = word_bounds(data, offs)
                marks = np.concatenate([[0], np.cumsum(mark[data])])
                labels = field.labels(field.emissions(features(data, starts, ends, at, rolling)), at)
                told = np.concatenate([[0], np.cumsum(labels > 0)])
                for i in range(len(ids)):
                    base.append([])
                    more.append([])
                    lo, hi = int(at[i]), int(at[i + 1])
                    plain = marks[offs[i + 1]] == marks[offs[i]]
                    if plain and told[hi] == told[lo]:
                        continue
                    text = texts[done + i].as_py()
                    flat = []
                    if not plain:
                        spans = base_spans(text)
                        base[-1] = [{"kind": k, "start": a, "stop": z} for k in KINDS for a, z in spans[k]]
                        flat = [s for k in KINDS for s in spans[k]]
                    w = lo + np.flatnonzero(labels[lo:hi])
                    if not len(w):
                        continue
                    # code points before each byte of the text
                    chars = np.concatenate([[0], np.cumsum((data[offs[i] : offs[i + 1]] & 0xC0) != 0x80)])
                    where = lambda x: int(chars[int(x) - int(offs[i])])  # noqa: B023, E731
                    for part in np.split(w, np.flatnonzero(np.diff(w) > 1) + 1):
                        words = [(where(starts[j]), where(ends[j]), text[where(starts[j]) : where(ends[j])]) for j in part]
                        more[-1] += [{"kind": k, "start": s, "stop": e} for k, s, e in added(words, labels[part], flat)]
                done += len(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, kind), pa.array(more, kind)], names=["doc_id", "base", "more"])

    span = "array<struct<kind:string,start:long,stop:long>>"
    return id_text(docs).mapInArrow(run, f"doc_id long, base {span}, more {span}")


def joined(col: str) -> Column:
    """kind:start:end by kind as listed, then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    rows = F.array_sort(F.transform(col, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
