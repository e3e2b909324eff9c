"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks of `chunk` code points that overlap by `overlap`; most texts are one chunk. The chunks of a
longer text are pre-tokenised each from its own start, and stitched at the first boundary in their overlap that
both neighbours found (the pattern looks only forward, so from a common boundary on both agree). Where an overlap holds no
common boundary, the pattern runs on alone from the last true boundary until it meets one that a later chunk found, so
one endless pre-token is read once and encoded whole. The stitched pieces are encoded each on its own. A text of at most `row`
code points goes through all that inside its row, in memory; the chunks and pieces of a longer one are dealt over all
tasks, as rows that are shuffled. Decoding concatenates the raw bytes of the ids.

Null and empty texts give no ids and the digest of nothing. Repeated rows give repeated rows; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samelode.llm.common import id_text, small_batches

_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The encoder of a rank file, kept per worker process."""
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of a text, in code points."""
    import regex

    return [m.end() for m in regex.finditer(pattern, text)]


#: Most code points of a text whose chunks stay in one row; a batch holds up to 1,000 such rows.
ROW = 1 << 17
#: A boundary this near a chunk's end may hang on what is cut off.
GUARD = 8


def stitch(text: str, offsets: list[int], bounds: list[np.ndarray], size: int, pattern: str) -> list[int]:
    """True boundaries that cut the whole text into pieces, one for each chunk or fewer.

    bounds: the boundaries in the whole text that each chunk of `size` code points found from its own start, in order. Every
    code point is matched at most once more, whatever the pre-tokens.
    """
    import regex

    compiled = regex.compile(pattern)
    cuts, true, k = [], bounds[0], 0  # `true`: boundaries of chunk k that are true ones
    while k + 1 < len(offsets):
        mine = true[true <= offsets[k] + size - GUARD]
        common = np.intersect1d(mine, bounds[k + 1], assume_unique=True)
        common = common[common > offsets[k + 1]]
        if len(common):
            at, k = int(common[0]), k + 1
        else:
            at, found = int(mine[-1]) if len(mine) else (cuts[-1] if cuts else 0), None
            while found is None and at < len(text):
                at = compiled.match(text, at).end()
                # chunks that hold this place well inside
                for j in range(k + 1, len(offsets)):
                    if offsets[j] >= at:
                        break
                    if at <= offsets[j] + size - GUARD or j + 1 == len(offsets):
                        i = int(np.searchsorted(bounds[j], at))
                        if i < len(bounds[j]) and bounds[j][i] == at:
                            found = j
                            break
            if found is None:
                break
            k = found
        if at >= len(text):
            break
        cuts.append(at)
        true = bounds[k][bounds[k] >= at]
    return cuts


def ids_of(text: str, enc, pattern: str, size: int, step: int) -> np.ndarray:
    """The ids of a whole text, by overlapping chunks that start `step` code points apart."""
    if len(text) <= size:
        return np.asarray(enc.encode_to_numpy(text), "<u4")
    offsets = list(range(0, len(text) - size + step, step))
    bounds = [np.asarray(boundaries(text[o : o + size], pattern), np.int64) + o for o in offsets]
    cuts = [0, *stitch(text, offsets, bounds, size, pattern), len(text)]
    return np.concatenate([np.asarray(enc.encode_to_numpy(text[a:z]), "<u4") for a, z in zip(cuts, cuts[1:])])


def _ids_row(doc_id: int | str | None, ids: np.ndarray, enc) -> tuple:
    raw = ids.astype("<u4").tobytes()
    return doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text; texts of any length, one task each. The general interface."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 8192, overlap: int = 256, row: int = ROW) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every text, long texts by stitched chunks."""
    small_batches(docs.sparkSession)
    row, step = max(row, chunk), chunk - overlap
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    base = id_text(docs).withColumn("key", F.monotonically_increasing_id())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo in range(0, len(ids), 512):
                part = texts.slice(lo, 512).to_pylist()
                rows = [_ids_row(i, ids_of(t, enc, pattern, chunk, step), enc) for i, t in zip(ids[lo : lo + 512], part)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    n = F.length("text")
    few = base.filter(n <= row).select("doc_id", "text").mapInArrow(inside, schema)
    # chunks of texts too long for a row: a row each, dealt over all tasks; ids go as text, as pandas has no null among whole numbers
    last = F.ceil((n - chunk) / F.lit(float(step))).cast("int")
    chunks = (
        base.filter(n > row)
        .select("key", F.col("doc_id").cast("string").alias("doc"), "text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
        .select("key", "doc", "k", (F.col("k") * step).cast("long").alias("off"), F.expr(f"substring(text, k * {step} + 1, {chunk})").alias("piece"))
        .repartition(F.col("key"), F.col("k"))
    )

    width = np.uint16 if chunk < 1 << 16 else np.uint32

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # lengths of pre-tokens, which take a quarter of their ends' bytes
            found = [np.diff(np.asarray(boundaries(t, pattern), np.int64), prepend=0).astype(width) for t in b["piece"]]
            yield pd.DataFrame({"key": b["key"], "doc": b["doc"], "k": b["k"], "off": b["off"], "piece": b["piece"], "bounds": [x.tobytes() for x in found]})

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        parts = rows["piece"].tolist()
        text = "".join([*(p[:step] for p in parts[:-1]), parts[-1]])
        offsets = rows["off"].tolist()
        found = [np.cumsum(np.frombuffer(x, width), dtype=np.int64) + o for x, o in zip(rows["bounds"], offsets)]
        cuts = [0, *stitch(text, offsets, found, chunk, pattern), len(text)]
        pieces = [text[a:z] for a, z in zip(cuts, cuts[1:])]
        return pd.DataFrame({"key": key[0], "doc": rows["doc"].iloc[0], "j": range(len(pieces)), "piece": pieces})

    def pieces_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "doc": b["doc"], "j": b["j"], "ids": [np.asarray(enc.encode_to_numpy(t), "<u4").tobytes() for t in b["piece"]]})

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("j")["ids"]), "<u4")
        return pd.DataFrame([_ids_row(rows["doc"].iloc[0], ids, encoding(ranks_path, pattern))], columns=["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    stitched = chunks.mapInPandas(bounds, "key long, doc string, k int, off long, piece string, bounds binary").groupBy("key").applyInPandas(join, "key long, doc string, j int, piece string")
    many = stitched.repartition(F.col("key"), F.col("j")).mapInPandas(pieces_ids, "key long, doc string, j int, ids binary").groupBy("key").applyInPandas(whole, schema.replace("doc_id long", "doc string"))
    return few.unionByName(many.withColumn("doc", F.col("doc").cast("long")).withColumnRenamed("doc", "doc_id"))
