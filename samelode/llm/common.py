"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word under `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Folders made for applications on one machine.
_OWN: dict[str, str] = {}
#: Folders stored on the way to tables that are being settled, innermost last.
_PASSING: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the memory of Python workers and of the Arrow buffers: rows of whole texts or whole sets are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; on one machine a folder of its own is made where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="samelode-"))
    return base.rstrip("/")


def small(df: DataFrame, bound: int = 200_000) -> DataFrame:
    """df, marked for broadcast if it has at most `bound` rows; beyond it, joins shuffle."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. By the values of columns, it lies in folders of which a filter reads its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    if _PASSING:
        _PASSING[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], label: str, spark: SparkSession) -> DataFrame:
    """The table that make() describes, stored; the tables that were stored on the way to it are deleted."""
    _PASSING.append([])
    try:
        df = make()
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if len(_PASSING) > 1:
            _PASSING[-2].append(path)
        return spark.read.schema(df.schema).parquet(path)
    finally:
        for old in _PASSING.pop():
            _delete(spark, old)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by stored() once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        while "=" in folder.getName():
            folder = folder.getParent()
        folder.getFileSystem(conf).delete(folder, True)


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that extra columns of any name cannot clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of runs of rows of about `limit` bytes of UTF-8 text; a longer text comes alone and whole."""
    text = batch.column("text")
    ids = batch.column("doc_id").to_pylist()
    if pa.types.is_large_string(text.type):
        offs = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    else:
        offs = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = text.buffers()[2] if len(text) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, len(ids))
        yield ids[lo:hi], data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes) of each word, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~sep[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    at = offs[:-1][offs[:-1] < len(data)]
    begin[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit polynomial hashes of any byte ranges, from one pass of prefix sums."""

    def __init__(self, mult: int = 0xD6E8FEB86659FD93, seed: int = 7):
        self.mult, self.inv = mult, pow(mult, -1, 1 << 64)
        self.byte = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.mult), ("down", self.inv)):
                p = np.empty(size, np.uint64)
                p[0], k = 1, 1
                while k < size:
                    m = min(k, size - k)
                    p[k : k + m] = p[:m] * np.uint64(pow(base, k, 1 << 64))
                    k += m
                setattr(self, name, p)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _splitmix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MULT))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries (len(hashes) - n + 1 of them)."""
    m = len(hashes) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(n):
        out = (out + hashes[i : i + m]) * np.uint64((_MULT + 2 * i * 0x5851F42D4C957F2D) & _MASK | 1)
        out ^= out >> np.uint64(29)
    return _splitmix(out)
