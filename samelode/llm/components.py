"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samelode.llm.common import drop_stored, stored


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id of the links (u, v), the smallest id it can reach. Ids without links are not listed.

    Alternating large-star and small-star steps: every step joins nodes to the smallest node around them, so the links
    become stars around the components' smallest ids in a number of rounds that grows with the logarithm of the size.
    Nothing is collected; minima are aggregated before each shuffle. Null ids are ignored; no links give no rows.
    """
    edges = stored(_pairs(links.filter("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, stored(_pairs(small), "edges")
        drop_stored(old)
        now = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
