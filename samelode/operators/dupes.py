"""Duplicate search at the three granularities, groups and their totals, and hash statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samelode.functions.scalars import block_number, pretty_size
from samelode.sources.corpus import dealt, numbered


def keyed_in_batch(rows: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """The keys with two members or more up to batch n, of which one is new in it; without n, over all rows at once.

    As no row is beyond n, some row is of batch n just if the largest is: one aggregation with partial sums.
    """
    some = F.col(keys[0]).isNotNull()
    if n is None:
        return rows.filter(some).groupBy(*keys).agg(F.count("*").alias("n_members")).filter("n_members > 1")
    agg = rows.filter(some & (F.col("dedupe_seq") <= n)).groupBy(*keys).agg(F.count("*").alias("n_members"), F.max("dedupe_seq").alias("last"))
    return agg.filter((F.col("n_members") > 1) & (F.col("last") == n))


def members_in_batch(rows: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """The rows up to batch n, or all, of the keys of keyed_in_batch()."""
    seen = rows if n is None else rows.filter(F.col("dedupe_seq") <= n)
    return seen.join(keyed_in_batch(rows, keys, n).select(*keys), keys, "left_semi")


def duplicate_files(files: DataFrame, n: int | None = None) -> DataFrame:
    """(digest, size, fileid, filename) of the files of duplicate groups; inlined files, and those whose flags are unknown, take no part."""
    return members_in_batch(files.filter((F.col("flags").bitwiseAND(1)) == 0), ["digest", "size"], n).select("digest", "size", "fileid", "filename")


def with_batch(parts: DataFrame, files: DataFrame, n: int | None) -> DataFrame:
    """Parts with the batch of their file; over all rows at once no batch is asked for, and each part has its file."""
    return parts if n is None else parts.join(files.select("fileid", "dedupe_seq"), "fileid")


def duplicate_extents(extents: DataFrame, files: DataFrame, n: int | None = None, after_whole_file: bool = False) -> DataFrame:
    """(digest, len, fileid, loff, poff); after_whole_file leaves out the extents of files that the whole-file stage deals with first."""
    rows = with_batch(extents, files, n)
    if after_whole_file:
        rows = rows.join(duplicate_files(files, n).select("fileid").distinct(), "fileid", "left_anti")
    return members_in_batch(rows, ["digest", "len"], n).select("digest", "len", "fileid", "loff", "poff")


def duplicate_blocks(blocks: DataFrame, files: DataFrame, n: int | None = None) -> DataFrame:
    """(digest, fileid, loff)."""
    return members_in_batch(with_batch(blocks, files, n), ["digest"], n).select("digest", "fileid", "loff")


def nondupe_extents(extents: DataFrame) -> DataFrame:
    """Extents whose digest stands once, whatever its length or batch; the least of one value is the value, so one pass does."""
    rest = ["fileid", "loff", "len", "poff"]
    once = extents.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("c"), *[F.min(c).alias(c) for c in rest]).filter("c = 1")
    return once.select(*rest, "digest")


def groups(members: DataFrame) -> DataFrame:
    """(len, digest, n_members, n_files) of (digest, len, fileid, loff) members, each place once."""
    return members.dropDuplicates(["len", "digest", "fileid", "loff"]).groupBy("len", "digest").agg(F.count("*").alias("n_members"), F.countDistinct("fileid").alias("n_files")).filter("n_members > 1")


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("num_dupes"), F.coalesce(F.sum("n_members"), F.lit(0)).alias("num_extents"))


def reclaimable(found: DataFrame) -> DataFrame:
    return found.select("len", "digest", (F.col("len") * (F.col("n_members") - 1)).alias("bytes"))


def report(members: DataFrame) -> DataFrame:
    """(size, n_files, id, filename, start) of whole-file groups."""
    size = members.groupBy("digest", "size").agg(F.count("*").alias("n_files"))
    return members.join(size, ["digest", "size"]).select("size", "n_files", F.substring("digest", 1, 8).alias("id"), "filename", F.lit(0).cast("long").alias("start"))


def ordered_report(members: DataFrame, files: DataFrame) -> DataFrame:
    """(line, kind, n_members, len, pretty, id, start, pretty_start, filename): the groups of members (kind, len, digest, fileid, loff), shorter
    ones first, equal lengths by digest, and in each group its members by file and offset; line numbers that order from 1 for each kind. Members are worked out once."""
    members = dealt(members.select("kind", "len", "digest", "fileid", "loff"))
    sizes = members.groupBy(F.col("kind").alias("_kind"), F.col("len").alias("_len"), F.col("digest").alias("_digest")).agg(F.count("*").alias("n_members"))
    rows = numbered(members, "len", "digest", "fileid", "loff", name="line", within=("kind",))
    # equal by <=>, so that no filter for nulls parts this reading of the members from the others
    rows = rows.join(sizes, F.expr("kind <=> _kind and len <=> _len and digest <=> _digest")).join(files.select("fileid", "filename"), "fileid")
    return rows.select("line", "kind", "n_members", "len", pretty_size(F.col("len")).alias("pretty"), F.substring("digest", 1, 8).alias("id"), F.col("loff").alias("start"), pretty_size(F.col("loff")).alias("pretty_start"), "filename")


def report_header(members: DataFrame) -> DataFrame:
    """(kind, n_groups, n_members): what stands above the report of each kind."""
    return members.groupBy("kind", "len", "digest").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_members"))


def frequencies(rows: DataFrame) -> DataFrame:
    """(digest, n) of digests that stand more than once, the most frequent first, ties by digest."""
    return rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "digest")


def file_counts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(digest, n_files): distinct file names of each digest."""
    return rows.join(files.select("fileid", "filename"), "fileid").groupBy("digest").agg(F.countDistinct("filename").alias("n_files"))


def top_hashes(rows: DataFrame, files: DataFrame, n: int | None = 10) -> DataFrame:
    """(digest, n, n_files) of the n most frequent digests, ties by digest; None lists all, 0 none."""
    agg = rows.join(files.select("fileid", "filename"), "fileid").groupBy("digest").agg(F.count("*").alias("n"), F.countDistinct("filename").alias("n_files")).filter("n > 1")
    return agg if n is None else agg.orderBy(F.desc("n"), "digest").limit(n)


def places(top: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """(digest, filename, loff): every place of the listed digests, whichever their number."""
    return rows.join(top.select("digest"), "digest", "left_semi").join(files.select("fileid", "filename"), "fileid").select("digest", "filename", "loff")


def block_places(top: DataFrame, rows: DataFrame, files: DataFrame, blocksize: int) -> DataFrame:
    """places() of blocks with their counts and logical block numbers: the block listing of the statistics report."""
    return places(top, rows, files).join(top, "digest").select("digest", "n", "n_files", "filename", "loff", block_number(F.col("loff"), blocksize).alias("lblock"))


def header(config: DataFrame, files: DataFrame, blocks: DataFrame, extents: DataFrame) -> DataFrame:
    """(version, block_size, num_files, num_block_hashes, num_extent_hashes): the head of the statistics report, one row."""
    key = lambda k: F.max(F.when(F.col("keyname") == k, F.col("keyval")))
    head = config.agg(F.concat_ws(".", key("version_major"), key("version_minor")).alias("version"), key("block_size").cast("long").alias("block_size"))
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((files, "num_files"), (blocks, "num_block_hashes"), (extents, "num_extent_hashes"))]
    for c in counts:
        head = head.crossJoin(c)
    return head


def blocks_by_file(dups: DataFrame) -> DataFrame:
    """(digest, fileid, n, loffs): places of each duplicate digest in each file, in order."""
    return dups.groupBy("digest", "fileid").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("loff")), lambda x: x.cast("string")), ",").alias("loffs"))


def clean_deduped(members: DataFrame) -> DataFrame:
    """Members of each group with one left of those that already share storage (equal poff other than 0); groups of one then go."""
    rows = members.select("len", "digest", "fileid", "loff", "poff")
    first = rows.filter("poff <> 0").groupBy("len", "digest", "poff").agg(F.min(F.struct("fileid", "loff")).alias("m")).select("len", "digest", "m.fileid", "m.loff", "poff")
    left = rows.filter("poff = 0").unionByName(first)
    keep = left.groupBy("len", "digest").agg(F.count("*").alias("c")).filter("c > 1").select("len", "digest")
    return left.join(keep, ["len", "digest"], "left_semi").select("len", "digest", "fileid", "loff", "poff")


def verify(members: DataFrame, content: DataFrame) -> DataFrame:
    """(digest, size, n_contents): distinct contents (by a second digest) in each group; 1 means that its members are equal."""
    return members.join(content, "fileid").groupBy("digest", "size").agg(F.countDistinct("proof").alias("n_contents"))


def differing(members: DataFrame, content: DataFrame) -> DataFrame:
    """(len, digest, fileid, loff, status) of members (len, digest, fileid, loff) of groups: 0 where the bytes of content (fileid, loff, data) are those
    of the group's first member by file and offset, 1 where they differ. Bytes are compared, not digests."""
    rows = members.select("len", "digest", "fileid", "loff").join(content.select("fileid", "loff", "data"), ["fileid", "loff"])
    first = rows.groupBy("len", "digest").agg(F.min_by("data", F.struct("fileid", "loff")).alias("target"))
    return rows.join(first, ["len", "digest"]).select("len", "digest", "fileid", "loff", F.when(F.col("data") == F.col("target"), 0).otherwise(1).alias("status"))


def after_dedupe(extents: DataFrame, files: DataFrame, n: int | None = None) -> DataFrame:
    """Extents after a whole-file stage: those of the files that it dealt with are gone."""
    return extents.join(duplicate_files(files, n).select("fileid").distinct(), "fileid", "left_anti").select("fileid", "loff", "len", "poff", "digest")


def grown(members: DataFrame, physical: DataFrame) -> DataFrame:
    """Members (len, digest, fileid, loff) whose physical extent (fileid, loff, plen) is shorter than the length of their group."""
    return members.join(physical.select("fileid", "loff", "plen"), ["fileid", "loff"]).filter(F.col("plen") < F.col("len"))


def shared_places(members: DataFrame, physical: DataFrame) -> DataFrame:
    """(len, digest, poff, n): storage that several members of a group already share, by the stored physical offset."""
    rows = members.select("len", "digest", "fileid", "loff").join(physical.select("fileid", "loff", "poff"), ["fileid", "loff"])
    return rows.filter("poff <> 0").groupBy("len", "digest", "poff").agg(F.count("*").alias("n")).filter("n > 1")
