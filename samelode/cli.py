"""Command line: scan folders into a state and report duplicates, list, remove, statistics, plans for listed groups.

    python -m samelode scan --state DIR [-r] [--exclude GLOB] [--list FILE] [-b BYTES] PATH...
    python -m samelode report|list|stats --state DIR
    python -m samelode remove --state DIR NAME...
    python -m samelode fdupes FILE
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.functions import scalars
from samelode.operators import dupes, requests, state
from samelode.sources import corpus
from samelode.sources.store import Store
from samelode.streaming import batches

BLOCKSIZE, LEAST, MOST = 128 << 10, 4 << 10, 1 << 20


def scan(spark: SparkSession, store: Store, paths: list[str], recursive: bool = False, globs: tuple[str, ...] = (), blocksize: int = BLOCKSIZE) -> int:
    """Read new and changed files into the state as the next batch; the number of that batch. A size of blocks that the state holds goes before the given one."""
    known = store.config()
    blocksize = int(known.get("block_size", blocksize))
    if not LEAST <= blocksize <= MOST:
        raise ValueError(f"blocks must have {LEAST} to {MOST} bytes")
    seq = int(known["dedupe_sequence"]) + 1
    real = corpus.real_files(spark, paths, recursive).filter(~scalars.excluded(F.regexp_replace("filename", "^file:/+", "/"), list(globs), os.getcwd()))
    listing = real.select("filename", F.xxhash64("filename").alias("ino"), F.lit("").alias("subvol"), "size", "mtime")
    files = state.prune_unscanned(store.read("files"))
    fresh = listing.join(batches.incremental(listing, files).select("filename"), "filename", "left_semi")
    gone = state.replaced(files, fresh)
    after = state.upsert_files(files, fresh, seq)
    ids = after.filter("digest is null").select("fileid", "filename")
    read = real.join(ids, "filename")
    blocks = corpus.content_blocks(read, blocksize).join(ids, "filename").select("fileid", "loff", "digest")
    marked = state.mark_scanned(after, read.select("fileid", "digest", F.lit(0).alias("flags")))
    config = state.config_put(store.read("config"), spark.createDataFrame([("dedupe_sequence", str(seq)), ("block_size", str(blocksize))], "keyname string, keyval string"))
    store.commit({"files": marked, "blocks": state.insert_blocks(state.without_files(store.read("blocks"), gone), blocks), "config": config})
    return seq


def report(store: Store, batch: int | None = None) -> DataFrame:
    """The duplicate report of whole files and of blocks, of all batches or of one."""
    files, blocksize = store.read("files"), int(store.config().get("block_size", BLOCKSIZE))
    whole = dupes.duplicate_files(files, batch).select(F.lit("files").alias("kind"), F.col("size").alias("len"), "digest", "fileid", F.lit(0).cast("long").alias("loff"))
    from samelode.operators.partial import block_len

    parts = dupes.duplicate_blocks(store.read("blocks"), files, batch).join(files.select("fileid", "size"), "fileid")
    parts = parts.select(F.lit("blocks").alias("kind"), block_len(F.col("size"), F.col("loff"), blocksize).alias("len"), "digest", "fileid", "loff")
    return dupes.ordered_report(whole.unionByName(parts), files).orderBy("kind", "line")


def remove(store: Store, names: list[str]) -> None:
    """Take files out of the state, with their extents and blocks."""
    files = store.read("files")
    gone = files.filter(F.col("filename").isin(names)).select("fileid")
    store.commit({t: state.without_files(store.read(t), gone) for t in ("files", "extents", "blocks")})


def stats(store: Store, n: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """The head of the statistics report, and the places of its most frequent blocks."""
    files, blocks = store.read("files"), store.read("blocks")
    top = dupes.top_hashes(blocks, files, n)
    return dupes.header(store.read("config"), files, blocks, store.read("extents")), dupes.block_places(top, blocks, files, int(store.config().get("block_size", BLOCKSIZE)))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="samelode")
    p.add_argument("mode", choices=["scan", "report", "list", "remove", "stats", "fdupes"])
    p.add_argument("paths", nargs="*")
    p.add_argument("--state")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--list")
    p.add_argument("-b", "--blocksize", default=None)
    p.add_argument("-n", type=int, default=10)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.mode == "fdupes":
        groups = corpus.closed_groups(corpus.listed_paths(spark, a.paths[0]))
        requests.chunks(groups).show(1000, False)
        return
    if not a.state:
        p.error("--state is needed")
    store = Store(spark, a.state)
    if a.mode == "scan":
        paths = a.paths + ([r["line"] for r in corpus.listed_paths(spark, a.list).filter("line <> ''").collect()] if a.list else [])
        size = spark.range(1).select(scalars.parse_size(F.lit(a.blocksize))).first()[0] if a.blocksize else BLOCKSIZE
        report(store, scan(spark, store, paths, a.recursive, tuple(a.exclude), size)).show(1000, False)
    elif a.mode == "report":
        report(store).show(1000, False)
    elif a.mode == "list":
        store.read("files").select("filename", "ino", "subvol").show(1000, False)
    elif a.mode == "remove":
        remove(store, a.paths)
    else:
        for df in stats(store, a.n):
            df.show(1000, False)
