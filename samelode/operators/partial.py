"""Partial matches: runs of equal duplicate blocks inside unique extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samelode.sources.corpus import dealt, numbered


def block_len(size, loff, blocksize: int):
    """Length of a file's block: whole, short at the end, 0 past it."""
    return F.when(loff >= size, 0).when(loff + blocksize <= size, blocksize).otherwise(size % blocksize).cast("long")


def numbered_blocks(dups: DataFrame, files: DataFrame, blocksize: int) -> DataFrame:
    """(digest, fileid, loff, idx, blen): duplicate blocks with their ordinal in the file."""
    # a shuffle at every size, so that all readings of the plan are planned alike and share it
    rows = numbered(dealt(dups.join(files.select("fileid", "size").hint("merge"), "fileid")), "loff", name="idx", within=("fileid",))
    return rows.select("digest", "fileid", "loff", F.col("idx").cast("int").alias("idx"), block_len(F.col("size"), F.col("loff"), blocksize).alias("blen"))


def seeds(unique: DataFrame, blk: DataFrame, nosame: bool = False) -> DataFrame:
    """(o_file, o_loff, o_idx, w_file, w_loff, w_idx, ext_end): a unique extent's first block and every other block of its digest."""
    o = blk.join(unique.select("fileid", "loff", "len"), ["fileid", "loff"]).select("digest", F.col("fileid").alias("o_file"), F.col("loff").alias("o_loff"), F.col("idx").alias("o_idx"), "len")
    w = blk.select("digest", F.col("fileid").alias("w_file"), F.col("loff").alias("w_loff"), F.col("idx").alias("w_idx"))
    other = (F.col("o_file") != F.col("w_file")) if nosame else (F.col("o_file") != F.col("w_file")) | (F.col("o_loff") != F.col("w_loff"))
    return o.join(w, "digest").filter(other).select("o_file", "o_loff", "o_idx", "w_file", "w_loff", "w_idx", (F.col("w_loff") + F.col("len") - 1).alias("ext_end"))


def matches(found: DataFrame, blk: DataFrame, blocksize: int, literal: bool = False) -> DataFrame:
    """(match_id, len, o_file, o_start, w_file, w_start): maximal runs of equal blocks from each seed, in step through both files' duplicate blocks.

    literal starts a run just behind the run before it, as a lockstep scan that forgets to move its start would.
    """
    seed = ["o_file", "o_loff", "o_idx", "w_file", "w_loff", "w_idx", "ext_end"]
    o = blk.select(F.col("fileid").alias("o_file"), F.col("idx").alias("oi"), F.col("loff").alias("ol"), F.col("digest").alias("od"), F.col("blen").alias("ob"))
    w = blk.select(F.col("fileid").alias("w_file"), F.col("idx").alias("wi"), F.col("loff").alias("wl"), F.col("digest").alias("wd"), F.col("blen").alias("wb"))
    # blocks lie a block or more apart, so an extent bounds the steps; joins by ordinal never pair a large file's seeds with all its blocks
    steps = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"cast((ext_end - w_loff) div {blocksize} as int)"))))
    steps = steps.withColumn("wi", F.col("w_idx") + F.col("k")).withColumn("oi", F.col("o_idx") + F.col("k"))
    pairs = steps.join(w, ["w_file", "wi"]).filter("wl < ext_end").join(o, ["o_file", "oi"])
    step = Window.partitionBy(*seed).orderBy("k")
    upto = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = pairs.withColumn("m", F.col("od") == F.col("wd"))
    contig = (F.col("ol") - F.lag("ol").over(step) == blocksize) & (F.col("wl") - F.lag("wl").over(step) == blocksize)
    m = m.withColumn("stop", (F.coalesce(F.lag("m").over(step), F.lit(False)) & ~F.coalesce(contig, F.lit(True))).cast("int"))
    m = m.withColumn("stops", F.sum("stop").over(upto)).filter("stops = 0")
    m = m.withColumn("island", F.sum((~F.col("m")).cast("int")).over(upto)).filter("m")
    run = m.groupBy(*seed, "island").agg(
        F.min("k").alias("k0"),
        F.max("k").alias("k1"),
        F.min("ol").alias("ol0"),
        F.min("wl").alias("wl0"),
        F.max(F.struct("k", "ol", "ob", "wl", "wb")).alias("z"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "od"))), lambda x: x["od"]), ",")).alias("match_id"),
    )
    run = run.filter(F.col("z.wl") + F.col("z.wb") - 1 <= F.col("ext_end"))
    o_start, w_start = F.col("ol0"), F.col("wl0")
    if literal:
        before = F.coalesce(F.lag("k1").over(Window.partitionBy(*seed).orderBy("island")) + 1, F.lit(0))
        run = run.withColumn("ks", before)
        at_o = blk.select(F.col("fileid").alias("o_file"), F.col("idx").alias("so"), F.col("loff").alias("o_s"))
        at_w = blk.select(F.col("fileid").alias("w_file"), F.col("idx").alias("sw"), F.col("loff").alias("w_s"))
        run = run.withColumn("so", F.col("o_idx") + F.col("ks")).withColumn("sw", F.col("w_idx") + F.col("ks")).join(at_o, ["o_file", "so"]).join(at_w, ["w_file", "sw"])
        o_start, w_start = F.col("o_s"), F.col("w_s")
    return run.select("match_id", (F.col("z.ol") + F.col("z.ob") - o_start).alias("len"), "o_file", o_start.alias("o_start"), "w_file", w_start.alias("w_start"))


def members(found: DataFrame) -> DataFrame:
    """(len, digest, fileid, loff, poff): both sides of each match, each place once."""
    side = lambda s: F.struct(F.col(f"{s}_file").alias("fileid"), F.col(f"{s}_start").alias("loff"))
    sides = found.select("len", F.col("match_id").alias("digest"), F.explode(F.array(side("o"), side("w"))).alias("s"))
    return sides.select("len", "digest", "s.fileid", "s.loff", F.lit(0).cast("long").alias("poff")).distinct()
