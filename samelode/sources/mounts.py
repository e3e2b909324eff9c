"""File systems and subvolumes of paths, from tables of mounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (filename, ...) with the columns of the deepest root (root, ...) that holds the path, null where none does: a mount table gives file system
    UUIDs and types, a table of subvolumes their ids. Every path looks its own ancestors up, so no path is held against all roots."""
    parts = F.split("filename", "/")
    # "/a/b/c" lies in "/a/b/c", "/a/b", "/a" and "/"
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == 1, "/").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    names = [c for c in roots.columns if c != "root"]
    known = roots.select(F.when(F.col("root") == "/", "/").otherwise(F.regexp_replace("root", "/+$", "")).alias("_root"), F.struct(*names).alias("_found")).dropDuplicates(["_root"])
    looked = paths.select("filename", F.explode(above).alias("_root")).distinct().join(known, "_root")
    deepest = looked.groupBy("filename").agg(F.max_by("_found", F.length("_root")).alias("_found"))
    return paths.join(deepest, "filename", "left").select(*paths.columns, *[F.col(f"_found.{n}").alias(n) for n in names])
