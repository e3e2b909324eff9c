"""Exact removal of repeated passages: every byte that a string of `least` bytes covers which also starts elsewhere.

Sorting all suffixes of a corpus one symbol a round would take as many rounds as the longest text has bytes, so the
column-wise construction works on what can repeat at all:

1. Each window of `least` bytes names the place of its smallest hashed 32-byte gram (leftmost of equals). Equal windows
   name equal grams, so windows of grams that stand only once in the corpus are settled. Consecutive windows with the same
   gram form a span.
2. Spans that are equal in hash, length and place of the gram repeat as wholes; all their windows are settled.
3. What is left are the spans at the edges of passages. They, and one copy of each repeated span of the same gram, are
   sorted column-wise: in blocks of whole gram groups, round j inserts the suffixes of length j of all strings at once
   by ranking the symbols before those of length j - 1 in the block's Burrows-Wheeler transform. In the final order equal
   windows are neighbours, and their common prefixes are taken by comparing neighbours byte by byte. Spans that share
   neither the bytes before nor those after their gram with another of its spans cannot hold a repeat and are left out.
   A gram with more than `hot` such spans is not sorted in one task: its windows are hashed (two 64-bit hashes) and
   counted with partial aggregation instead.

A block's transform lies in memory (it is as small as `block`), not in files: executors share no local disk.

Null and empty texts and texts shorter than `least` keep all their bytes; repeated rows repeat each other's passages;
an empty table gives an empty table; extra columns are ignored. Rows are told apart by doc_id and a 64-bit hash of the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samelode.llm.common import Rolling, drop_stored, id_text, settled, slices, small_batches, stored

GRAM = 32
DOC = ["doc_id", "th"]
#: Most intervals or spans, in all rows, that are broadcast; beyond it, joins shuffle.
SMALL = 1 << 20


def small(df: DataFrame, col: str, bound: int = SMALL) -> DataFrame:
    """df, marked for broadcast if its arrays `col` hold at most `bound` entries; no row's array is empty."""
    return F.broadcast(df) if (df.agg(F.sum(F.size(col))).first()[0] or 0) <= bound else df


def _numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with row numbers as doc_id."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest gram of each run of w grams, leftmost of equals (by 32 bits of the hash)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    pad = np.full(-len(key) % w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([key, pad]).reshape(-1, w)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(rows, axis=1).ravel()
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def spans(docs: DataFrame, least: int) -> DataFrame:
    """(h, g, doc_id, th, a, w, o): the spans of each text: gram, hash of the span and its gram's place, first window, number of windows after it, place of the gram after the first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            doc, th, out = b.column("doc_id").to_pylist(), b.column("th").to_pylist(), []
            for ids, data, offs in slices(_numbered(b)):
                n = len(data) - least + 1
                if n <= 0:
                    continue
                sums = rolling.sums(data)
                at = np.arange(len(data) - GRAM + 1)
                grams = rolling.of(sums, at, at + GRAM)
                place = window_minima(grams, least - GRAM + 1)
                owner = np.searchsorted(offs, np.arange(n), side="right") - 1
                whole = np.arange(n) + least <= offs[owner + 1]
                new = np.r_[True, (np.diff(place) != 0) | (np.diff(owner) != 0)]
                new[1:] |= whole[1:] != whole[:-1]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], n] - 1
                keep = whole[first]
                first, last = first[keep], last[keep]
                p, who = place[first], owner[first]
                g = rolling.of(sums, first, last + least) ^ ((p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                out.append((grams[p].view(np.int64), g.view(np.int64), np.array(ids)[who], first - offs[who], last - first, p - first))
            if out:
                h, g, who, a, w, o = (np.concatenate(x) for x in zip(*out))
                arrays = [pa.array(h), pa.array(g), b.column("doc_id").take(pa.array(who)), b.column("th").take(pa.array(who)), pa.array(a.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(o.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "g", "doc_id", "th", "a", "w", "o"])

    return docs.mapInArrow(run, "h long, g long, doc_id long, th long, a int, w int, o int")


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of all non-empty suffixes in sorted order, equal ones by string; no string holds byte 0xFF.

    Column-wise: `bwt` holds the symbol before each suffix of fewer than j symbols, in order; 0xFF stands before a whole
    string. Ranking the symbols before the newest suffixes places those one symbol longer.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    symbol = lambda who, j: np.where(sizes[who] >= j, text[np.maximum(ends[who] - j, 0)], 255).astype(np.uint8)
    who, pos = np.arange(m), np.arange(m)
    bwt = symbol(who, 1) if len(text) else np.full(m, 255, np.uint8)
    for j in range(2, int(sizes.max(initial=0)) + 2):
        go = bwt[pos] != 255
        who, pos = who[go], pos[go]
        fresh = np.zeros(len(bwt), bool)
        fresh[pos] = True
        order = np.argsort(bwt, kind="stable")
        placed = np.flatnonzero(fresh[order])
        by_pos = np.argsort(pos)
        who = who[by_pos][np.searchsorted(pos[by_pos], order[placed])]
        pos = m + placed
        old = np.ones(len(bwt) + len(pos), bool)
        old[pos] = False
        grown = np.empty(len(old), np.uint8)
        grown[old] = bwt
        grown[pos] = symbol(who, j)
        bwt = grown
    # walk back from the empty suffixes to name every place
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = m + np.arange(len(bwt))
    string, offset = np.zeros(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    who, pos = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        go = sizes[who] >= j
        who, pos = who[go], step[pos[go]]
        string[pos], offset[pos] = who, sizes[who] - j
    return string[m:], offset[m:]


def repeated_windows(strings: list[bytes], least: int) -> list[np.ndarray]:
    """Of each string, the starts of the windows that start more than once in all the strings."""
    string, offset = suffix_order(strings)
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(strings), np.uint8)
    long = sizes[string] - offset >= least
    string, offset = string[long], offset[long]
    start = (np.cumsum(sizes) - sizes)[string] + offset
    same = np.zeros(len(start) + 1, bool)
    for lo in range(1, len(start), 50_000):
        x = np.arange(lo, min(lo + 50_000, len(start)))
        view = np.lib.stride_tricks.sliding_window_view(text, least)
        same[x] = (view[start[x]] == view[start[x - 1]]).all(axis=1)
    hit = same[:-1] | same[1:]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    string, offset = string[hit], offset[hit]
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    for s, part in zip(string[np.r_[True, np.diff(string) > 0]] if len(string) else [], np.split(offset, np.flatnonzero(np.diff(string) > 0) + 1)):
        out[s] = part
    return out


def merged(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > least)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + least).tolist()))


#: Ids go as text through pandas, which has no null among whole numbers.
_FOUND = "doc_id string, th long, lo int, hi int"


def _edges(strings: DataFrame, least: int, block: int) -> DataFrame:
    """Intervals (doc_id, th, lo, hi) of the windows that repeat, from (h, doc_id, th, a, o, data, copy), grouped and sorted by h; blocks hold whole groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (least - GRAM) // 2

        def sides(r: tuple) -> list[tuple]:
            # a window reaches at least half of its other bytes to the left or to the right of its gram, and equal windows share them
            h, data, o = r[0], r[4], r[6]
            return [(h, 0, data[o - half : o])] * (o >= half) + [(h, 1, data[o + GRAM : o + GRAM + half])] * (len(data) >= o + GRAM + half)

        def solve(rows: list) -> pd.DataFrame:
            seen = Counter(k for r in rows for k in sides(r))
            rows = [r for r in rows if any(seen[k] > 1 for k in sides(r))]
            out = []
            for r, starts in zip(rows, repeated_windows([r[4] for r in rows], least)):
                if not r[5]:
                    out += [(r[1], r[2], r[3] + lo, r[3] + hi) for lo, hi in merged(starts, least)]
            return pd.DataFrame(out, columns=["doc_id", "th", "lo", "hi"]).astype({"th": "int64", "lo": "int32", "hi": "int32"})

        held, size, h = [], 0, None
        for b in batches:
            for r in zip(b["h"], b["doc_id"], b["th"], b["a"], b["data"], b["copy"], b["o"]):
                if r[0] != h and size >= block:
                    yield solve(held)
                    held, size = [], 0
                h = r[0]
                held.append(r)
                size += len(r[4])
        if held:
            yield solve(held)

    return strings.repartition("h").sortWithinPartitions("h").mapInPandas(run, _FOUND)


def _counted(strings: DataFrame, least: int) -> DataFrame:
    """The same for grams with many spans: windows by two hashes, counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Rolling(), Rolling(0xA0761D6478BD642F, 23)
        for b in batches:
            for doc, th, a, data, copy in zip(b["doc_id"], b["th"], b["a"], b["data"], b["copy"]):
                x = np.frombuffer(data, np.uint8)
                s = np.arange(len(x) - least + 1)
                yield pd.DataFrame({"x": one.of(one.sums(x), s, s + least).view(np.int64), "y": two.of(two.sums(x), s, s + least).view(np.int64), "doc_id": [doc] * len(s), "th": th, "s": (a + s).astype(np.int32), "copy": copy})

    rows = strings.mapInPandas(run, "x long, y long, doc_id string, th long, s int, copy boolean")
    twice = rows.groupBy("x", "y").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    return rows.filter("not copy").join(twice, ["x", "y"], "left_semi").select("doc_id", "th", F.col("s").alias("lo"), (F.col("s") + least).alias("hi"))


def repeats(docs: DataFrame, least: int = 200, block: int = 1 << 18, hot: int = 50_000) -> DataFrame:
    """(doc_id, th, runs): for each text (doc_id, text, th) with repeated strings, intervals (lo, hi) in bytes that cover them."""
    every = stored(spans(docs, least), "spans")
    # counts are stored before they are joined: then both sides of a join are plain shuffles, of which a hot gram's can be split
    grams = stored(every.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "shared-grams")
    rows = stored(every.join(grams, "h", "left_semi"), "shared-spans")
    drop_stored(every)
    equal = rows.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "a", "w", "o")).alias("one"))
    equal = stored(equal, "equal-spans")
    settled = rows.join(equal.filter("c > 1").select("h", "g"), ["h", "g"], "left_semi").select("doc_id", "th", F.col("a").alias("lo"), (F.col("a") + F.col("w") + least).alias("hi"))
    open_ = stored(equal.filter("c = 1").groupBy("h").agg(F.count("*").alias("n")), "open-grams")
    wanted = stored(equal.join(open_, "h").select("h", "n", (F.col("c") > 1).alias("copy"), "one.*"), "open-spans")
    asked = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "n", "copy", "a", "w", "o")).alias("spans"))
    asked = asked.withColumnsRenamed({"doc_id": "d", "th": "t"})
    text = docs.join(small(asked, "spans"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).dropDuplicates(DOC)
    text = text.select("doc_id", "th", F.encode("text", "utf-8").alias("raw"), F.explode("spans").alias("s"))
    cut = text.select("s.h", "s.n", F.col("doc_id").cast("string").alias("doc_id"), "th", "s.a", "s.o", "s.copy", F.expr(f"substring(raw, s.a + 1, s.w + {least})").alias("data"))
    strings = stored(cut, "open-strings")
    edges = _edges(strings.filter(F.col("n") <= hot).drop("n"), least, block)
    if wanted.filter(F.col("n") > hot).limit(1).count():
        edges = edges.unionByName(_counted(strings.filter(F.col("n") > hot).drop("n"), least))
    edges = edges.withColumn("doc_id", F.col("doc_id").cast("long"))
    # touching intervals become one before they are gathered
    order = Window.partitionBy(*DOC).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = settled.unionByName(edges).withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("lo")).cast("int"))
    one = apart.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*DOC, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return one.groupBy(*DOC).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("th", F.xxhash64("text"))


def without(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs)."""
    edge = np.zeros(len(raw) + 1, np.int32)
    for lo, hi in runs:
        edge[lo] += 1
        edge[hi] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    n = int((np.diff(np.r_[False, gone].astype(np.int8)) > 0).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), n


def cleaned(docs: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of each document; kept are the bytes that stay."""
    small_batches(docs.sparkSession)
    docs = keyed(docs)
    runs = settled(lambda: repeats(docs, least), "runs", docs.sparkSession).withColumnsRenamed({"doc_id": "d", "th": "t"})
    joined = docs.join(small(runs, "runs"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            for text, found in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                raw = text.encode()
                kept, gone, n = without(raw, [(r["lo"], r["hi"]) for r in found]) if found else (raw, 0, 0)
                for c, v in zip(cols, (kept, len(raw), gone, n)):
                    c.append(v)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
