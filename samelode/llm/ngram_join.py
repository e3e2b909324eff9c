"""Exact n-gram Jaccard self-join with rare-first prefix, length, positional and suffix filters.

A document's set is its distinct shingles of `n` words as 64-bit hashes; two sets link when 100 * |x & y| >= t * |x | y|.

1. Shingles are counted over the whole corpus in a sketch of fixed size (two rows of hashed buckets, of which the smaller
   counts), and (count, hash) is a total order that puts rare shingles first; the filters hold for any order all documents
   share, so what two shingles share in the sketch costs time at most.
2. Documents with equal sets form classes; only the class of the smallest doc_id goes on, with its prefix: the first
   |x| - ceil(t |x| / 100) + 1 shingles. Linked sets share one of these. Each posting of a prefix also tells, for each of
   PARTS ranges of hashes, how many of the set's shingles behind it fall there. A posting leaves its document only if its
   shingle may stand in the prefix of another set of a like size (its band of sizes or a neighbour): a bitmap of fixed
   size tells, from short hashes of all shingles with their bands. Whatever else it lets through costs time only.
3. Each shared prefix shingle pairs its documents with the one where it stands first (a star, not all pairs). The
   length filter bounds the sizes, the positional filter the places, and the suffix filter compares what lies behind the
   shared shingle: two suffixes differ in at least as many shingles as their numbers differ in, added over the ranges. Pairs
   that are left pass a second bound on whole sets (parities of 512 ranges) and are verified on the sets, once for each pair.
4. Components of these links are formed. A second round takes pairs under a shared shingle whose documents are in
   different components; pairs inside a component cannot change the result. They are met by equality on shingle and band
   of sizes, so a document meets only those whose sizes let it link. A group of many near copies is never expanded into
   all its pairs, and no link between components is lost.

Null and empty texts have empty sets and link with nothing; repeated rows are one document; rows of a null doc_id link
with nothing and have no component, but each has its row; a doc_id is taken to name one text; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samelode.llm.common import LOWER, Rolling, _splitmix, combine, id_text, settled, slices, small, small_batches, stored, word_bounds
from samelode.llm.components import components

BUCKETS = 1 << 22
CHUNKS = 64
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Ranges of hashes of the suffix filter, four to a long; counts stop at 65,535, which only lowers differences.
PARTS = 8
#: The bitmap of shared shingles has 2^BITS places, made in 2^SLICE slices; FLUSH entries are packed at once.
BITS, SLICE, FLUSH = 28, 8, 1 << 22
#: Most rows that are broadcast; beyond it, joins shuffle.
SMALL = 300_000


def shingle_sets(batch: pa.RecordBatch, n: int, rolling: Rolling) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, sorted distinct shingles) of each row (doc_id, text)."""
    for ids, data, offs in slices(batch):
        data = LOWER[data]
        starts, ends, at = word_bounds(data, offs)
        words = rolling.of(rolling.sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        grams = combine(words, n)
        for i, doc in enumerate(ids):
            lo, hi = int(at[i]), int(at[i + 1])
            if hi - lo >= n:
                yield doc, np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield doc, combine(words[lo:hi], hi - lo)
            else:
                yield doc, np.zeros(0, np.uint64)


def _buckets(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the two rows of the sketch, which has BUCKETS places in all."""
    half = BUCKETS // 2 - 1
    return (grams >> np.uint64(40)).astype(np.int64) & half, ((grams >> np.uint64(8)).astype(np.int64) & half) + half + 1


def _often(counts: np.ndarray, grams: np.ndarray) -> np.ndarray:
    one, two = _buckets(grams)
    return np.minimum(counts[one], counts[two])


def counted(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of all documents' shingles in the sketch: a table of fixed size, summed by tasks before it reaches the driver."""
    width = BUCKETS // CHUNKS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, total = Rolling(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for ids, data, offs in slices(b):
                data = LOWER[data]
                starts, ends, at = word_bounds(data, offs)
                if len(starts) >= n:
                    grams = combine(rolling.of(rolling.sums(data), starts, ends), n)
                    inside = np.ones(len(grams), bool)  # runs of words that cross from one text to the next don't count
                    for k in range(1, n):
                        cut = at[1:-1] - k
                        inside[cut[(cut >= 0) & (cut < len(grams))]] = False
                    total += np.bincount(np.concatenate(_buckets(grams[inside])), minlength=BUCKETS)
        if total.any():
            blobs = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, blob in zip(b["chunk"], b["counts"]):
                got = np.frombuffer(zlib.decompress(blob), np.int64)
                sums[chunk] = sums[chunk] + got if chunk in sums else got
        if sums:
            yield pd.DataFrame({"chunk": list(sums), "counts": [zlib.compress(x.tobytes(), 1) for x in sums.values()]})

    schema = "chunk int, counts binary"
    folded = docs.mapInArrow(part, schema).repartition(CHUNKS, "chunk").mapInPandas(fold, schema)
    total = np.zeros(BUCKETS, np.int64)
    for row in folded.toLocalIterator():
        total[row["chunk"] * width : (row["chunk"] + 1) * width] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return np.minimum(total, (1 << 31) - 1).astype(np.int32)


def behind(ranked: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """(len(ranked), PARTS / 4) longs: for each place of a prefix, how many shingles of the set behind it fall into each range of hashes, 16 bits each."""
    part = (ranked >> np.uint64(61)).astype(np.int64)
    seen = np.cumsum(part[:, None] == np.arange(PARTS), axis=0)
    left = np.minimum(np.bincount((grams >> np.uint64(61)).astype(np.int64), minlength=PARTS) - seen, 65535)
    return np.ascontiguousarray(left.astype("<u2")).view("<i8").reshape(len(ranked), PARTS // 4)


def records(docs: DataFrame, n: int, t: int, order) -> DataFrame:
    """(doc_id, size, k1, k2, prefix, rest, sketch) of every document: its set's size, two keys that equal sets share, its prefix in the common order, what lies behind each place of it, and the set's parity sketch. order: a broadcast of counted()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, counts = Rolling(), order.value
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, grams in shingle_sets(b, n, rolling):
                size = len(grams)
                keep = size - -(-t * size // 100) + 1 if size else 0
                ranked = grams[np.argsort(_often(counts, grams), kind="stable")][:keep]
                mixed = (grams ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
                k1, k2 = int(np.bitwise_xor.reduce(grams)) if size else 0, int((mixed ^ (mixed >> np.uint64(31))).sum(dtype=np.uint64))
                odd = np.bincount((grams >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH) & 1
                per = np.packbits(odd.astype(np.uint8)).view(np.int64)
                for c, v in zip(cols, (doc, size, k1 - (1 << 64) if k1 >> 63 else k1, k2 - (1 << 64) if k2 >> 63 else k2, ranked.view(np.int64), behind(ranked, grams).ravel(), per)):
                    c.append(v)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), longs, longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], names=["doc_id", "size", "k1", "k2", "prefix", "rest", "sketch"])

    return docs.mapInArrow(run, "doc_id long, size long, k1 long, k2 long, prefix array<long>, rest array<long>, sketch array<long>")


def _least_overlap(a: Column, b: Column, t: int) -> Column:
    """Smallest overlap of linked sets of these sizes: ceil(t * (a + b) / (100 + t))."""
    return F.ceil(F.lit(t) * (a + b) / F.lit(100.0 + t) - F.lit(1e-9))


def _filters(a: str, b: str, t: int) -> Column:
    """Length, positional and suffix filters on two postings. Up to a common shingle at most as many are common as either document has
    shared ones there; behind it at most half of what both hold there less what they surely differ in, which is no more than
    the shorter rest holds."""
    c = lambda s, x: F.col(f"{s}.{x}")
    sa, sb, pa_, pb = c(a, "size"), c(b, "size"), c(a, "pos"), c(b, "pos")
    length = 100 * F.least(sa, sb) >= t * F.greatest(sa, sb)
    upto = F.least(c(a, "before"), c(b, "before")) + 1
    need = _least_overlap(sa, sb, t) - upto
    ra, rb = sa - pa_ - 1, sb - pb - 1
    positional = F.least(ra, rb) >= need
    count = lambda s, i: F.shiftrightunsigned(c(s, f"r{i // 4}"), 16 * (i % 4)).bitwiseAND(F.lit(65535).cast("long"))
    differ = reduce(Column.__add__, [F.abs(count(a, i) - count(b, i)) for i in range(PARTS)])
    return length & positional & (ra + rb - differ >= 2 * need)


def _parities(a: str, b: str, t: int) -> Column:
    """A bound on two whole sets: their sketches may not differ in more bits than linked sets differ in shingles."""
    c = lambda s, i: F.col(f"{s}.sketch")[i]
    bits = [F.bit_count(c(a, i).bitwiseXOR(c(b, i))) for i in range(SKETCH)]
    sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
    return reduce(Column.__add__, bits) <= sizes - 2 * _least_overlap(F.col(f"{a}.size"), F.col(f"{b}.size"), t)


def _width(t: int) -> float:
    """Width of a band of logarithms of sizes: the sizes of linked sets are in one band or in neighbours."""
    return max(float(np.log(100 / t)), 1e-6) * (1 + 1e-9)


def _looks(grams: np.ndarray, sizes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (40 bits at the top) of each shingle with its set's band and with the next one; shingles that two sets of one band or of neighbours share have one in common."""
    band = np.floor(np.log(sizes.astype(np.float64)) / _width(t)).astype(np.uint64)
    of = lambda b: _splitmix(grams + (b + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(24)
    return of(band), of(band + np.uint64(1))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, place of each in its prefix, row of each) of rows with a prefix."""
    prefix = batch.column("prefix")
    per = prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    grams = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(per)), per)
    return grams, np.arange(len(grams)) - np.repeat(np.cumsum(per) - per, per), row


def shared_bits(reps: DataFrame, t: int) -> np.ndarray:
    """A bitmap with the place of every entry (shingle and band) that several prefixes hold: the entries go as short sorted hashes, three bytes or so each, to the slice that they are in."""
    low = np.uint64(32)

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held))
        again = np.zeros(len(x), bool)
        again[2:] = x[2:] == x[:-2]  # twice is enough to tell that it is shared
        x = x[~again]
        edge = np.searchsorted(x, np.arange((1 << SLICE) + 1, dtype=np.uint64) << low)
        blobs = []
        for lo, hi in zip(edge, edge[1:]):
            steps = np.diff(x[lo:hi] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype("<u4")
            blobs.append(zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(range(1 << SLICE), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "entries"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            grams, _, row = _flat(b)
            held.extend(_looks(grams, b.column("size").to_numpy()[row], t))
            size += 2 * len(grams)
            if size > FLUSH:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    def places(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32) for x in rows["entries"]]
        x = np.sort(np.concatenate(parts))
        bits = np.zeros(1 << (BITS - SLICE), np.uint8)
        bits[x[1:][x[1:] == x[:-1]] >> np.uint32(32 - BITS + SLICE)] = 1
        return pd.DataFrame({"slice": [key[0]], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    found = reps.select("size", "prefix").mapInArrow(entries, "slice int, entries binary").groupBy("slice").applyInPandas(places, "slice int, bits binary")
    out = np.zeros((1 << SLICE, 1 << (BITS - SLICE - 3)), np.uint8)
    for r in found.collect():  # 2^BITS bits at most
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.ravel()


def postings(reps: DataFrame, t: int, bits) -> DataFrame:
    """(doc_id, size, pos, gram, r0, ...) of the prefixes' shingles that may be shared. bits: a broadcast of shared_bits()."""
    longs = PARTS // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known(entry: np.ndarray) -> np.ndarray:
            place = entry >> np.uint64(40 - BITS)
            return (bits.value[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 > 0

        for b in batches:
            grams, pos, row = _flat(b)
            sizes = b.column("size").to_numpy()[row]
            one, two = _looks(grams, sizes, t)
            keep = np.flatnonzero(known(one) | known(two))
            rest = b.column("rest").flatten().to_numpy(zero_copy_only=False).reshape(-1, longs)[keep]
            cols = [b.column("doc_id").to_numpy()[row[keep]], sizes[keep], pos[keep], grams[keep].view(np.int64), *np.ascontiguousarray(rest.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    names = ["doc_id", "size", "pos", "gram", *[f"r{i}" for i in range(longs)]]
    return reps.select("doc_id", "size", "prefix", "rest").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _verified(kept: DataFrame, docs: DataFrame, n: int, t: int) -> DataFrame:
    """The pairs (u, v) whose whole sets link. Both sets go to where their pair is, in one shuffle."""
    wanted = small(kept.select("u", "v", F.explode(F.array("u", "v")).alias("w")), SMALL)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            got = list(shingle_sets(b, n, rolling))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([g.tobytes() for _, g in got], pa.binary())], names=["id", "grams"])

    def overlap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["ux"], b["vx"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * inter >= t * (len(x) + len(y) - inter))
            yield b[["u", "v"]][ok]

    own = docs.join(wanted, F.col("doc_id") == F.col("w"), "left_semi").mapInArrow(sets, "id long, grams binary")
    sent = own.join(wanted, F.col("id") == F.col("w")).select("u", "v", "w", "grams")
    of = lambda x: F.first(F.when(F.col("w") == F.col(x), F.col("grams")), ignorenulls=True).alias(f"{x}x")
    return sent.groupBy("u", "v").agg(of("u"), of("v")).mapInPandas(overlap, "u long, v long")


def _one_of_each_class(rec: DataFrame, copied: DataFrame, equal: list[str]) -> DataFrame:
    """One record for each set, under the smallest doc_id that has it; copied: the keys of those with several records. Only their records are shuffled, if the keys can be broadcast."""

    def first(df: DataFrame) -> DataFrame:
        wide = ("prefix", "rest", "sketch")
        return stored(df.groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in wide]), "copied").select(*rec.columns)

    if copied.limit(SMALL + 1).count() > SMALL:
        return first(rec)
    copied = F.broadcast(copied)
    return rec.join(copied, equal, "left_anti").select(*rec.columns).unionByName(first(rec.join(copied, equal, "left_semi")))


def link_classes(docs: DataFrame, n: int = 4, t: int = 85) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, class) of every document, and the verified links (u, v) between classes that join components; a class is the smallest doc_id with that set."""
    small_batches(docs.sparkSession)
    docs = id_text(docs).filter("doc_id is not null")
    order = docs.sparkSession.sparkContext.broadcast(counted(docs, n))
    rec = stored(records(docs, n, t, order), "records")
    equal = ["size", "k1", "k2"]
    rep = stored(rec.groupBy(*equal).agg(F.min("doc_id").alias("class"), F.count("*").alias("rows")), "classes")
    member = stored(rec.select("doc_id", *equal).join(rep.drop("rows"), equal).select("doc_id", "size", F.when(F.col("size") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("class")).distinct(), "members")
    reps = _one_of_each_class(rec, rep.filter("rows > 1").select(*equal), equal)
    bits = docs.sparkSession.sparkContext.broadcast(shared_bits(reps, t))
    longs = PARTS // 4
    posts = stored(postings(reps, t, bits), "prefixes")
    shared = posts.select("gram").groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    place = Window.partitionBy("doc_id").orderBy("pos")
    # joins of tables that grow with the corpus are shuffles whatever the size
    posts = stored(posts.join(shared.hint("merge"), "gram", "left_semi").withColumn("before", F.row_number().over(place) - 1), "postings")
    sketches = reps.select("doc_id", "size", "sketch").hint("merge")

    # first round: under each shared shingle, all documents against the one where it stands first; that one has the
    # fewest rare shingles of its own, so it is the middle of a group of near copies if any is
    star = stored(posts.groupBy("gram").agg(F.min(F.struct("pos", "doc_id", "size", "before", *[f"r{i}" for i in range(longs)])).alias("s")).select("gram", "s.*"), "stars")
    a, b = star.alias("a"), posts.alias("b")
    hit = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.doc_id") != F.col("b.doc_id")) & _filters("a", "b", t)
    first = b.join(a.hint("merge"), hit).select(F.least("a.doc_id", "b.doc_id").alias("u"), F.greatest("a.doc_id", "b.doc_id").alias("v")).distinct()
    first = first.join(sketches.alias("p"), F.col("u") == F.col("p.doc_id")).join(sketches.alias("q"), F.col("v") == F.col("q.doc_id"))
    first = stored(first.filter(_parities("p", "q", t)).select("u", "v"), "first-pairs")
    links = stored(_verified(first, docs, n, t), "first-links")

    # second round: all other pairs between different components, met in bands of sizes as wide as linked sizes differ:
    # the smaller set looks into its own band and the next
    comp = stored(components(links), "components")
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(_width(t))).cast("int")
    named = posts.join(comp.withColumnsRenamed({"id": "doc_id"}), "doc_id", "left").select(*posts.columns, F.coalesce("component", "doc_id").alias("comp"), band.alias("band"))
    mixed = stored(named.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("gram"), "mixed-grams")
    left = stored(named.join(mixed.hint("merge"), "gram", "left_semi").join(sketches.select("doc_id", "sketch").hint("merge"), "doc_id"), "mixed")
    x, y = left.withColumn("look", F.explode(F.array("band", F.col("band") + 1))).alias("x"), left.alias("y")
    smaller = F.struct("x.size", "x.doc_id") < F.struct("y.size", "y.doc_id")
    cond = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.look") == F.col("y.band")) & smaller & (F.col("x.comp") != F.col("y.comp")) & _filters("x", "y", t) & _parities("x", "y", t)
    more = x.join(y, cond).select(F.least("x.doc_id", "y.doc_id").alias("u"), F.greatest("x.doc_id", "y.doc_id").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    return member, links.unionByName(_verified(stored(more, "second-pairs"), docs, n, t))


def _without_id(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of the rows of a null doc_id, one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            sizes = [len(g) for _, g in shingle_sets(b, n, rolling)]
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), none, none], names=["doc_id", "n_shingles", "component_id", "class_id"])

    return id_text(docs).filter("doc_id is null").mapInArrow(run, "doc_id long, n_shingles long, component_id long, class_id long")


def joined(docs: DataFrame, n: int = 4, t: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each document."""

    def named() -> DataFrame:
        member, links = link_classes(docs, n, t)
        comp = components(links).withColumnsRenamed({"id": "class", "component": "found"})
        return member.join(comp, "class", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("found", "class").alias("component_id"), F.col("class").alias("class_id"))

    return settled(named, "joined", docs.sparkSession).unionByName(_without_id(docs, n))


def one_of_each(docs: DataFrame, n: int = 4, t: int = 85) -> DataFrame:
    """docs without those that link, directly or through others, to a document of smaller doc_id; all columns stay, and rows of a null doc_id."""
    gone = joined(docs, n, t).filter("component_id <> doc_id").select(F.struct(F.col("doc_id").alias("id")).alias(_free("gone", docs))).distinct()
    key = gone.columns[0]
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(f"{key}.id"), "left_anti")


def _free(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
