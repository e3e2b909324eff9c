"""Plans of bounded dedupe requests; nothing is changed on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samelode.functions.scalars import rounded_down
from samelode.sources.corpus import numbered

#: Destinations of a request next to its target, and files of a chunk.
DESTINATIONS, CHUNK = 119, 120


def plan(members: DataFrame) -> DataFrame:
    """(len, digest, rn, role, fileid, loff): the first member by (fileid, loff) is the target of its group."""
    return numbered(members, "fileid", "loff", within=("len", "digest")).select("len", "digest", "rn", F.when(F.col("rn") == 1, "target").otherwise("dest").alias("role"), "fileid", "loff")


def requests(members: DataFrame) -> DataFrame:
    """(len, digest, request, n_dest): a group's destinations in requests that share its target, from the sizes of the groups alone;
    the destination with number rn of the plan is in request (rn - 2) div 119."""
    sizes = members.groupBy("len", "digest").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    cut = sizes.withColumn("request", F.expr(f"explode(sequence(0L, (n - 1) div {DESTINATIONS}))"))
    return cut.select("len", "digest", "request", F.least(F.lit(DESTINATIONS), F.col("n") - DESTINATIONS * F.col("request")).alias("n_dest"))


def chunks(listed: DataFrame) -> DataFrame:
    """(grp, chunk, target, n_dest) of listed groups (grp, ord, path): in reverse order, each chunk with its own target; a chunk of one does nothing."""
    back = numbered(listed.withColumn("_back", -F.col("ord")), "_back", within=("grp",))
    cut = back.withColumn("chunk", F.floor((F.col("rn") - 1) / CHUNK).cast("long"))
    return cut.groupBy("grp", "chunk").agg(F.max_by("path", "ord").alias("target"), (F.count("*") - 1).alias("n_dest")).filter("n_dest > 0")


def outcome(planned: DataFrame, blocksize: int) -> DataFrame:
    """(len, digest, fileid, loff, status, bytes) of each destination if the plan were carried out: lengths are rounded down to whole
    filesystem blocks, so a member shorter than one block is passed on as it is."""
    return planned.filter("rn > 1").select("len", "digest", "fileid", "loff", F.lit(0).alias("status"), rounded_down(F.col("len"), blocksize).cast("long").alias("bytes"))


def attempts(planned: DataFrame, files: DataFrame, blocksize: int) -> DataFrame:
    """(len, digest, fileid, loff, attempt, status, bytes) of each destination if the plan were carried out on a file system that wants whole
    blocks: a length that is none, and does not end its file, is refused at first (-22) and asked for again rounded down; a member
    shorter than one block stays refused."""
    rows = planned.filter("rn > 1").join(files.select("fileid", "size"), "fileid")
    whole = (F.col("len") % blocksize == 0) | (F.col("loff") + F.col("len") == F.col("size"))
    tries = F.when(whole, F.array(F.struct(F.lit(1).alias("attempt"), F.lit(0).alias("status"), F.col("len").alias("bytes")))).otherwise(
        F.array(
            F.struct(F.lit(1).alias("attempt"), F.lit(-22).alias("status"), F.lit(0).cast("long").alias("bytes")),
            F.struct(F.lit(2).alias("attempt"), F.when(F.col("len") > blocksize, 0).otherwise(-22).alias("status"), F.when(F.col("len") > blocksize, rounded_down(F.col("len"), blocksize)).otherwise(0).cast("long").alias("bytes")),
        )
    )
    return rows.select("len", "digest", "fileid", "loff", F.explode(tries).alias("t")).select("len", "digest", "fileid", "loff", "t.attempt", "t.status", "t.bytes")


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """(n_requests, n_failed, bytes) over the outcomes (status, bytes) of all workers."""
    return outcomes.agg(F.count("*").alias("n_requests"), F.coalesce(F.sum((F.col("status") != 0).cast("long")), F.lit(0)).alias("n_failed"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def moved(planned: DataFrame, extents: DataFrame) -> DataFrame:
    """(fileid, loff, poff): where the destinations of a plan are stored once it is carried out, which is where their targets are."""
    place = extents.select("fileid", "loff", "poff")
    target = planned.filter("rn = 1").join(place, ["fileid", "loff"]).select("len", "digest", "poff")
    return planned.filter("rn > 1").join(target, ["len", "digest"]).select("fileid", "loff", "poff")


def single(places: DataFrame, length: int, content: DataFrame) -> DataFrame:
    """(ord, fileid, loff, role, status, bytes) of one request by hand over places (ord, fileid, loff): the first is the source; a destination has status
    0 if its `length` characters of content (fileid, text) are the source's, else 1."""
    part = places.join(content.select("fileid", "text"), "fileid").select("ord", "fileid", "loff", F.substring(F.col("text"), (F.col("loff") + 1).cast("int"), F.lit(length)).alias("data"))
    source = part.agg(F.min(F.struct("ord", "data")).alias("s")).select("s.*").withColumnsRenamed({"ord": "first", "data": "source"})
    rows = part.crossJoin(F.broadcast(source))
    same = F.col("data") == F.col("source")
    is_source = F.col("ord") == F.col("first")
    return rows.select("ord", "fileid", "loff", F.when(is_source, "source").otherwise("dest").alias("role"), F.when(is_source | same, 0).otherwise(1).alias("status"), F.when(~is_source & same, F.length("data")).otherwise(0).cast("long").alias("bytes"))


def gained(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bytes): by how much the shared bytes (fileid, lo, hi, shared) of all ranges went up; ranges that lost some count as 0."""
    both = before.join(after.withColumnRenamed("shared", "now"), ["fileid", "lo", "hi"])
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("now") - F.col("shared"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"))
