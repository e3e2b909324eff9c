"""Batches of files as a stream: state tables grow by micro-batch and each batch reports the groups that gained a member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samelode.operators import dupes, state


def incremental(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of a listing that must be read again: new, renamed or changed."""
    return state.changes(listing, files).filter("status <> 'same'")


def every_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(batch, keys, n_members) for every batch: each group in each batch in which it gains a member, with its members up to then."""
    new = rows.filter(F.col(keys[0]).isNotNull()).groupBy(*keys, F.col("dedupe_seq").alias("batch")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return new.select("batch", *keys, F.sum("_n").over(upto).alias("n_members")).filter("n_members > 1")


def start(stream: DataFrame, state_dir: str, out_dir: str, checkpoint: str):
    """Run duplicate_files over a stream of files (fileid, filename, size, digest, flags, and ino and subvol if known). Batch i writes its files to the
    partition dedupe_seq = i + 1, over what a lost run left there, and its groups next to it; so a repeated batch changes nothing.
    A file that comes again, changed or renamed, puts out its earlier row, which stays in its partition but is read no more."""

    def batch(df: DataFrame, i: int) -> None:
        spark, n = df.sparkSession, i + 1
        df.drop("dedupe_seq").write.mode("overwrite").parquet(f"{state_dir}/dedupe_seq={n}")
        known = state.latest(spark.read.parquet(state_dir).filter(F.col("dedupe_seq") <= n))
        dupes.duplicate_files(known, n).write.mode("overwrite").parquet(f"{out_dir}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_parts(stream: DataFrame, state_dir: str, out_dir: str, checkpoint: str):
    """The same for extents (fileid, loff, len, poff, digest) of files that each come in one batch: their groups by digest and length."""

    def batch(df: DataFrame, i: int) -> None:
        spark, n = df.sparkSession, i + 1
        df.drop("dedupe_seq").write.mode("overwrite").parquet(f"{state_dir}/dedupe_seq={n}")
        known = spark.read.parquet(state_dir).filter(F.col("dedupe_seq") <= n)
        dupes.members_in_batch(known, ["digest", "len"], n).write.mode("overwrite").parquet(f"{out_dir}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
