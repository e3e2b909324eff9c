"""State tables as functions of the old table and a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samelode.sources.corpus import numbered

DEFAULTS = {"hash_type": "md5", "block_size": "131072", "dedupe_sequence": "0", "version_major": "4", "version_minor": "1"}


def config(stored: DataFrame) -> DataFrame:
    """(keyname, keyval) of all known keys, defaults for those that are missing."""
    rows = F.array(*[F.struct(F.lit(k).alias("keyname"), F.lit(v).alias("default")) for k, v in DEFAULTS.items()])
    base = stored.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
    return base.join(stored, "keyname", "left").select("keyname", F.coalesce("keyval", "default").alias("keyval"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fileid) of the old files that new ones put out, by (ino, subvol) or by name: what goes from extents and blocks with them (without_files)."""
    same = old.join(new.select("ino", "subvol"), ["ino", "subvol"], "left_semi").select("fileid")
    return same.unionByName(old.join(new.select("filename"), "filename", "left_semi").select("fileid")).distinct()


def upsert_files(old: DataFrame, new: DataFrame, seq: int = 1) -> DataFrame:
    """Rows of new replace old ones of the same (ino, subvol) or the same filename; they get new ids and the batch `seq`, and no digest or flags yet."""
    top = old.agg(F.coalesce(F.max("fileid"), F.lit(0)).alias("top"))
    left = old.join(new.select("ino", "subvol"), ["ino", "subvol"], "left_anti").join(new.select("filename"), "filename", "left_anti")
    fresh = numbered(new, "filename").crossJoin(F.broadcast(top))
    fresh = fresh.select((F.col("top") + F.col("rn")).alias("fileid"), "filename", "ino", "subvol", "size", "mtime", F.lit(seq).alias("dedupe_seq"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("flags"))
    return left.select(fresh.columns).unionByName(fresh)


def mark_scanned(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """The files with digest and flags of scanned (fileid, digest, flags) where there are any; all columns stay."""
    s = scanned.select("fileid", F.col("digest").alias("_digest"), F.col("flags").alias("_flags"))
    new = {"digest": F.coalesce("_digest", "digest").alias("digest"), "flags": F.coalesce("_flags", "flags").alias("flags")}
    return files.join(s, "fileid", "left").select(*[new.get(c, F.col(c)) for c in files.columns])


def update_poff(extents: DataFrame, moved: DataFrame) -> DataFrame:
    return extents.join(moved.withColumnRenamed("poff", "new_poff"), ["fileid", "loff"], "left").select("fileid", "loff", "len", F.coalesce("new_poff", "poff").alias("poff"), "digest")


def without_files(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of files, extents or blocks without those of the listed fileids: removal of hashes and the cascade of a removal."""
    return rows.join(gone.select("fileid").distinct(), "fileid", "left_anti")


def prune_unscanned(files: DataFrame) -> DataFrame:
    return files.filter("digest is not null")


def rename(files: DataFrame, names: DataFrame) -> DataFrame:
    """The files renamed by (fileid, new_name), all at once: a name belongs to one file, so whoever holds a name that another takes is gone, and of
    several files renamed to one name that of the largest fileid is left; all columns stay."""
    new = names.groupBy("fileid").agg(F.max("new_name").alias("_new"))
    rows = files.join(new, "fileid", "left").withColumn("_name", F.coalesce("_new", "filename"))
    owner = rows.groupBy("_name").agg(F.max(F.struct(F.col("_new").isNotNull().alias("r"), "fileid"))["fileid"].alias("_owner"))
    kept = rows.join(owner, "_name").filter(F.col("fileid") == F.col("_owner"))
    return kept.select(*[F.col("_name").alias("filename") if c == "filename" else F.col(c) for c in files.columns])


def latest(rows: DataFrame) -> DataFrame:
    """Of the files of all batches those that no later batch put out, by (ino, subvol) where there are such columns, or by name."""
    for keys in (["ino", "subvol"], ["filename"]):
        if set(keys) <= set(rows.columns):
            last = rows.groupBy(*keys).agg(F.max("dedupe_seq").alias("_last"))
            on = [F.col(f"a.{k}").eqNullSafe(F.col(f"z.{k}")) for k in keys]
            rows = rows.alias("a").join(last.alias("z"), on).filter(F.expr("dedupe_seq = _last or " + " or ".join(f"a.{k} is null" for k in keys))).select("a.*")
    return rows


def changes(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(ino, subvol, filename, status) of a listing: new, renamed, changed or same. A file is renamed if its stored path is another and no longer listed."""
    old = files.select("ino", "subvol", F.col("filename").alias("old_name"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    present = listing.select(F.col("filename").alias("old_name"), F.lit(True).alias("there"))
    seen = listing.join(old, ["ino", "subvol"], "left").join(present, "old_name", "left")
    renamed = (F.col("old_name") != "") & (F.col("old_name") != F.col("filename")) & F.col("there").isNull()
    status = F.when(F.col("old_name").isNull(), "new").when(renamed, "renamed").when((F.col("mtime") != F.col("old_mtime")) | (F.col("size") != F.col("old_size")), "changed").otherwise("same")
    return seen.select("ino", "subvol", "filename", status.alias("status"))


def deleted(files: DataFrame, listing: DataFrame) -> DataFrame:
    return files.join(listing.select("filename"), "filename", "left_anti").select("fileid", "filename")


def on_locked_fs(listing: DataFrame, uuid: str | None = None) -> DataFrame:
    """Rows (ord, filename, fs_uuid) on the one filesystem that is allowed: the given one, or else that of the first row."""
    if uuid is not None:
        return listing.filter(F.col("fs_uuid") == uuid)
    first = listing.agg(F.min_by("fs_uuid", "ord").alias("first"))
    return listing.crossJoin(F.broadcast(first)).filter(F.col("fs_uuid") == F.col("first")).drop("first")


def config_put(stored: DataFrame, put: DataFrame) -> DataFrame:
    """(keyname, keyval) after writing the keys of put over stored ones."""
    return stored.select("keyname", "keyval").join(put.select("keyname"), "keyname", "left_anti").unionByName(put.select("keyname", "keyval"))


def insert_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Block hashes (fileid, loff, digest) with those of new put in the place of old ones of the same file and offset; rows without a digest are left out."""
    fresh = new.filter("digest is not null").select(old.columns).dropDuplicates(["fileid", "loff"])
    return old.join(fresh.select("fileid", "loff"), ["fileid", "loff"], "left_anti").select(old.columns).unionByName(fresh)


def progress(files: DataFrame) -> DataFrame:
    """(dedupe_seq, files_scanned, total_files, files_percent, bytes_scanned, total_bytes, bytes_percent): how far a scan is after each batch; percents with two decimals."""
    by_batch = files.groupBy("dedupe_seq").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    total = by_batch.agg(F.sum("n").alias("total_files"), F.sum("b").alias("total_bytes"))
    upto = Window.orderBy("dedupe_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a batch
    rows = by_batch.select("dedupe_seq", F.sum("n").over(upto).alias("files_scanned"), F.sum("b").over(upto).alias("bytes_scanned")).crossJoin(F.broadcast(total))
    percent = lambda a, b: F.round(F.col(a) * 100 / F.col(b), 2)
    return rows.select("dedupe_seq", "files_scanned", "total_files", percent("files_scanned", "total_files").alias("files_percent"), "bytes_scanned", "total_bytes", percent("bytes_scanned", "total_bytes").alias("bytes_percent"))


def insert_extents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extents with those of new put in the place of old ones of the same (fileid, loff, len); empty ones are left out."""
    fresh = new.filter("len > 0").select(old.columns)
    return old.join(fresh.select("fileid", "loff", "len"), ["fileid", "loff", "len"], "left_anti").select(old.columns).unionByName(fresh)
