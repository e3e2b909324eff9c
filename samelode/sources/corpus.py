"""Files, extents and blocks of a table of documents, or of real files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH = 256
BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most ranges.
RANGES = 4096


def in_ranges(df: DataFrame, key) -> DataFrame:
    """df with `_p`, the place of `key` (unique, or nearly so) among bounds from a bounded sample of the keys, as many ranges as the session
    has shuffle partitions, RANGES at most. It hangs on the keys alone, so every scan and every repeated task puts a row into
    the same range; the sample only balances them. Nulls come first."""
    n = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    picks = df.select(key.alias("_k")).filter("_k is not null").orderBy(F.xxhash64("_k")).limit(32 * n).agg(F.array_sort(F.collect_list("_k")).alias("_s"))
    # the bounds are worked out once and stand outside the rows; each row is led to its range by halves
    bounds = picks.select(F.expr("filter(_s, (x, j) -> j > 0 and j % 32 = 0)")).scalar()
    out = df.withColumn("_k", key).withColumn("_p", F.lit(0))
    for half in (1 << i for i in reversed(range(n.bit_length()))):
        out = out.withColumn("_p", F.when(F.get(bounds, F.col("_p") + (half - 1)) <= F.col("_k"), F.col("_p") + half).otherwise(F.col("_p")))
    return out.drop("_k")


def dealt(df: DataFrame) -> DataFrame:
    """df in a shuffle by all of its columns. Whatever reads it, and however few of the columns, asks for this one shuffle, so that what
    comes before it is worked out once for all readers; rows of one key are spread."""
    return df.repartition(*df.columns)


def numbered(df: DataFrame, *keys: str, name: str = "rn", within: tuple = ()) -> DataFrame:
    """df with the place of each row in the order of the keys, from 1, in the table or in each group of `within`: ranges are numbered
    in parallel and shifted by the sizes of the ranges before, so that no group, however large, is sorted by one task."""
    ranged = in_ranges(df, F.struct(*keys))
    sizes = ranged.groupBy(*within, "_p").agg(F.count("*").alias("_n"))
    before = sizes.select(*within, "_p", (F.sum("_n").over(Window.partitionBy(*within).orderBy("_p")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy(*within, "_p").orderBy(*keys))
    return ranged.withColumn("_r", place).join(before, [*within, "_p"]).withColumn(name, (F.col("_r") + F.col("_b")).cast("long")).drop("_p", "_r", "_b")


def assign_batches(files: DataFrame, key: str = "fileid", batch: int = BATCH, base: int = 0) -> DataFrame:
    """Files with dedupe_seq: numbers go up when the running count reaches the batch size, so the first batch has one file less; batch 0 never counts up."""
    if not batch:
        return files.withColumn("dedupe_seq", F.lit(base + 1))
    return numbered(files, key).withColumn("dedupe_seq", (F.lit(base + 1) + F.floor(F.col("rn") / batch)).cast("int")).drop("rn")


def files(docs: DataFrame, batch: int = BATCH) -> DataFrame:
    """One file for each document; short ones stand for inlined files."""
    rows = docs.select(
        F.col("doc_id").alias("fileid"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("doc_id").alias("ino"),
        F.col("source").alias("subvol"),
        F.col("n_chars").alias("size"),
        (F.col("doc_id") * 1_000_000_000).alias("mtime"),
        F.md5(F.encode("text", "utf-8")).alias("digest"),
        F.when(F.col("n_chars") <= 64, 1).otherwise(0).alias("flags"),
    )
    return assign_batches(rows, batch=batch)


#: Lines whose offsets are added up together; sums of whole groups come next, so the work on n lines grows with n, not with its square.
GROUP = 512


def line_offsets(docs: DataFrame) -> DataFrame:
    """(fileid, loff, line): every line with its offset in characters, worked out inside the row; a null text has no lines."""
    one = lambda col, name: F.explode(F.array(col)).alias(name)  # worked out once for each row
    sums = "aggregate({0}, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    rows = docs.filter("text is not null").select(F.col("doc_id").alias("fileid"), one(F.split("text", "\n"), "ls"))
    rows = rows.select("fileid", "ls", one(F.expr(f"transform(sequence(0, (size(ls) - 1) div {GROUP}), c -> transform(slice(ls, c * {GROUP} + 1, {GROUP}), l -> cast(length(l) + 1 as bigint)))"), "lens"))
    rows = rows.select("fileid", "ls", one(F.expr("transform(lens, g -> " + sums.format("g") + ")"), "within"))
    rows = rows.select("fileid", "ls", "within", one(F.expr(sums.format("transform(within, g -> element_at(g, -1))")), "before"))
    rows = rows.select("fileid", F.explode(F.arrays_zip(F.col("ls").alias("line"), F.expr("flatten(transform(within, (g, i) -> transform(slice(g, 1, size(g) - 1), o -> o + before[i])))").alias("loff"))).alias("l"))
    return rows.select("fileid", "l.loff", "l.line")


def extents(docs: DataFrame) -> DataFrame:
    """One extent for each non-empty line, with its digest; loff counts characters. Every tenth document shares the storage of equal lines."""
    ext = line_offsets(docs).filter("line <> ''").select("fileid", "loff", F.length("line").cast("long").alias("len"), F.md5(F.encode("line", "utf-8")).alias("digest"))
    own = F.lit(1) + F.col("fileid") * (1 << 20) + F.col("loff")
    first = ext.groupBy("digest", "len").agg(F.min(F.struct("fileid", "loff")).alias("m")).select("digest", "len", (F.lit(1) + F.col("m.fileid") * (1 << 20) + F.col("m.loff")).alias("first"))
    # each extent has its row in `first`; a left join goes where poff is not asked for
    return ext.join(first, ["digest", "len"], "left").select("fileid", "loff", "len", F.when(F.col("fileid") % 10 == 0, F.col("first")).otherwise(own).alias("poff"), "digest")


def mapped_extents(table: DataFrame) -> DataFrame:
    """Canonical extents (fileid, loff, len, poff, flags) from a table of a file system's extent maps: names and types are set, empty and null
    extents left out; flags default to 0 and poff, where it is not known, to 0."""
    have = set(table.columns)
    col = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0)) if name in have else F.lit(0).cast("long")
    rows = table.select(F.col("fileid").cast("long").alias("fileid"), F.col("loff").cast("long").alias("loff"), F.col("len").cast("long").alias("len"), col("poff").alias("poff"), col("flags").cast("int").alias("flags"))
    return rows.filter("fileid is not null and loff is not null and len > 0")


def digested_extents(extents: DataFrame, content: DataFrame, fold_holes: bool = False) -> DataFrame:
    """Extents with the digest of their part of content (fileid, text); fold_holes digests the hole before an extent with it, as a
    scan that reads on through holes does."""
    end = F.lag(F.col("loff") + F.col("len")).over(Window.partitionBy("fileid").orderBy("loff"))
    rows = extents.withColumn("_lo", F.least(F.coalesce(end, F.lit(0).cast("long")), F.col("loff")) if fold_holes else F.col("loff"))
    part = F.substring(F.col("text"), (F.col("_lo") + 1).cast("int"), (F.col("loff") + F.col("len") - F.col("_lo")).cast("int"))
    return rows.join(content.select("fileid", "text"), "fileid").select(*extents.columns, F.md5(F.encode(part, "utf-8")).alias("digest"))


def chunks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(fileid, loff, data): the fixed chunks of whole texts, cut in one pass over each; the last one is short."""
    cut = docs.select(F.col("doc_id").alias("fileid"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("i", "data"))
    return cut.select("fileid", (F.col("i").cast("long") * size).alias("loff"), F.encode("data", "utf-8").alias("data"))


def stream_digest(parts: DataFrame) -> DataFrame:
    """(fileid, digest): the digest of each file's parts (fileid, loff, data) in order, which is that of the whole file."""
    return parts.groupBy("fileid").agg(F.array_sort(F.collect_list(F.struct("loff", F.hex("data").alias("x")))).alias("p")).select("fileid", F.md5(F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), ""))).alias("digest"))


def digest_check(stored: DataFrame, content: DataFrame) -> DataFrame:
    """(fileid, digest, actual, same): stored digests (fileid, digest) next to those of content (fileid, text)."""
    actual = content.select("fileid", F.md5(F.encode("text", "utf-8")).alias("actual"))
    return stored.join(actual, "fileid").select("fileid", "digest", "actual", F.col("digest").eqNullSafe(F.col("actual")).alias("same"))


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Fixed chunks with their digests."""
    return chunks(docs, size).select("fileid", "loff", F.md5("data").alias("digest"))


def real_files(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(filename, size, mtime in ns, digest, content) of files on any store that Spark reads; empty files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return raw.filter("length > 0").select(F.col("path").alias("filename"), F.col("length").alias("size"), nanoseconds("modificationTime").alias("mtime"), F.md5("content").alias("digest"), "content")


def nanoseconds(ts):
    """Nanoseconds since 1970 of a timestamp, as whole numbers."""
    return F.unix_micros(ts) * 1000


def clock_nanoseconds(name: str):
    """The same for a timestamp without a time zone, as a clock at zero would show it; the session's zone has no say."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)") * 1000


def listed_paths(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a file of paths, a line each, in the order of the file; for real_files(), and for closed_groups() with its blank lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("ord", "line"))
    return lines.select(F.col("ord").cast("long").alias("ord"), "line")


def listed_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """real_files() of the paths that a file lists; the list itself is handed to the reader by the driver, as a command line would be."""
    return real_files(spark, [r["line"] for r in listed_paths(spark, path).filter("line <> ''").toLocalIterator()], recursive)


def content_blocks(content: DataFrame, size: int) -> DataFrame:
    """(filename, loff, digest) of the binary chunks of real_files."""
    n = F.ceil(F.col("size") / size).cast("int")
    return content.select("filename", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("filename", (F.col("i") * size).cast("long").alias("loff"), F.md5(F.substring("content", F.col("i") * size + 1, F.lit(size))).alias("digest"))


def closed_groups(lines: DataFrame) -> DataFrame:
    """(grp, ord, path) of a stream of paths (ord, line) in which a blank line ends a group; a group left open is not listed."""
    blank = (F.col("line") == "").cast("int")
    split = in_ranges(lines, F.col("ord"))
    ends = split.groupBy("_p").agg(F.sum(blank).alias("_n"))
    before = ends.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    upto = Window.partitionBy("_p").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grp = split.withColumn("_r", F.sum(blank).over(upto)).join(F.broadcast(before), "_p").withColumn("grp", (F.col("_r") + F.col("_b") + 1).cast("int"))
    closed = ends.agg(F.sum("_n").alias("closed"))
    return grp.filter("line <> ''").crossJoin(F.broadcast(closed)).filter("grp <= closed").select("grp", "ord", F.col("line").alias("path"))
