"""Lookups by offset: stabbing, as-of and overlap.

An interval of up to 2^v bytes overlaps two bins of that width at most, so lookups are equality joins on file, level and bin:
a file with a third of all extents and all points is spread over its bins and not paired with itself. Extents of up to 64
bytes share the finest bins, which hold 64 of them at most. Wide ranges are binned by their own level, and two intervals
meet at the coarser of their levels, so no interval has more than two rows a level, however wide it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samelode.sources.corpus import dealt, in_ranges

_LEVEL = "cast(ceil(log2(greatest(len, 64))) as int)"


def _binned(extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extents with level v and bin b, a row for each bin; and the levels that occur (one row, 64 at most)."""
    rows = extents.filter("len > 0")
    binned = rows.withColumn("v", F.expr(_LEVEL)).withColumn("b", F.expr("explode(array_distinct(array(shiftright(loff, v), shiftright(loff + len - 1, v))))"))
    return binned, rows.agg(F.collect_set(F.expr(_LEVEL)).alias("vs"))


def extent_at(points: DataFrame, extents: DataFrame) -> DataFrame:
    """(fileid, x, loff, len): the extent that holds offset x of the file."""
    binned, levels = _binned(extents)
    p = points.crossJoin(F.broadcast(levels)).select("fileid", "x", F.explode("vs").alias("v")).withColumn("b", F.expr("shiftright(x, v)"))
    return p.join(binned, ["fileid", "v", "b"]).filter("loff <= x and x < loff + len").select("fileid", "x", "loff", "len")


def extent_asof(points: DataFrame, extents: DataFrame) -> DataFrame:
    """(fileid, x, loff): the first extent that ends at x or later; it may begin after x. Ends and points (without loff) are put in order in
    ranges, each a task's, and what lies in later ranges of a file reaches the earlier ones as one number a range, for the few files that
    have several; so one file may hold any share. Extents are worked out once and ranges are cut once."""
    ends = extents.filter("len > 0 and fileid is not null and loff is not null").select("fileid", (F.col("loff") + F.col("len") - 1).alias("x"), "loff")
    asked = points.filter("fileid is not null and x is not null").select("fileid", "x", F.lit(None).cast("long").alias("loff")).distinct()
    rows = in_ranges(dealt(ends.unionByName(asked)), F.struct("fileid", "x")).repartition("fileid", "_p")
    # ranges of a file by their last place, which is their order; so both readers of the rows need the same columns, and share one shuffle
    firsts = rows.groupBy("fileid", "_p").agg(F.min("loff").alias("_m"), F.max("x").alias("_x"))
    later = firsts.withColumn("_later", F.min("_m").over(Window.partitionBy("fileid").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)))
    later = later.filter("_later is not null").select("fileid", "_p", "_later")
    back = Window.partitionBy("fileid", "_p").orderBy(F.desc("x"), F.asc_nulls_last("loff")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_here", F.min("loff").over(back)).filter("loff is null").join(later, ["fileid", "_p"], "left")
    return found.select("fileid", "x", F.least("_here", "_later").alias("loff")).filter("loff is not null")


_BINS = "explode(array_distinct(array(shiftright({0}, {2}), shiftright({1} - 1, {2}))))"


def _overlaps(wanted: DataFrame, extents: DataFrame) -> DataFrame:
    """Rows of wanted (fileid, lo, hi) with each extent that they overlap, once: at the first bin that both touch, on the coarser of their levels."""
    ext = extents.filter("len > 0").withColumn("ve", F.expr(_LEVEL))
    asked = wanted.filter("lo < hi").withColumn("vw", F.expr("cast(ceil(log2(greatest(hi - lo, 64))) as int)"))
    ext_levels, asked_levels = ext.agg(F.collect_set("ve").alias("vs")), asked.agg(F.collect_set("vw").alias("vs"))  # 64 at most
    binned = lambda df, lo, hi, v: df.withColumn("v", v).withColumn("b", F.expr(_BINS.format(lo, hi, "v")))
    up = lambda df, levels, cond: df.crossJoin(F.broadcast(levels)).withColumn("v", F.explode(F.expr(f"filter(vs, v -> {cond})"))).drop("vs")
    end = "loff + len"
    # ranges at least as wide as the extents: at the range's level; wider extents: at the extent's
    wide = binned(asked, "lo", "hi", F.col("vw")).drop("vw").join(binned(up(ext, asked_levels, "v >= ve"), "loff", f"({end})", F.col("v")).drop("ve"), ["fileid", "v", "b"])
    fine = binned(up(asked, ext_levels, "v > vw"), "lo", "hi", F.col("v")).drop("vw").join(binned(ext, "loff", f"({end})", F.col("ve")).drop("ve"), ["fileid", "v", "b"])
    hit = wide.unionByName(fine).filter(f"loff < hi and {end} > lo")
    return hit.filter(F.expr("b = greatest(shiftright(lo, v), shiftright(loff, v))")).drop("v", "b")


def shared_bytes(wanted: DataFrame, extents: DataFrame) -> DataFrame:
    """(fileid, lo, hi, shared): bytes of [lo, hi) in shared, allocated extents; a range that is asked for twice is answered once."""
    asked = wanted.select("fileid", "lo", "hi").distinct()
    hit = _overlaps(asked, extents.filter("shared and not delalloc").select("fileid", "loff", "len"))
    found = hit.groupBy("fileid", "lo", "hi").agg(F.sum(F.least(F.col("loff") + F.col("len"), F.col("hi")) - F.greatest("loff", "lo")).alias("shared"))
    return asked.join(found, ["fileid", "lo", "hi"], "left").select("fileid", "lo", "hi", F.coalesce("shared", F.lit(0)).alias("shared"))


def outside_ignored(parts: DataFrame, extents: DataFrame) -> DataFrame:
    """Parts (fileid, loff, len) that no extent with `ignored` set overlaps: what a scan reads."""
    asked = parts.select("fileid", F.col("loff").alias("lo"), (F.col("loff") + F.col("len")).alias("hi")).distinct()
    skipped = _overlaps(asked, extents.filter("ignored").select("fileid", "loff", "len")).select("fileid", F.col("lo").alias("loff"), (F.col("hi") - F.col("lo")).alias("len")).distinct()
    return parts.join(skipped, ["fileid", "loff", "len"], "left_anti")


def shared_per_file(extents: DataFrame) -> DataFrame:
    return extents.filter("shared").groupBy("fileid").agg(F.sum("len").alias("shared"))
