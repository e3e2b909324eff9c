"""Query op5_nearest and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.llm import vptree
from samelode.llm.common import table


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op5_nearest": nearest}
ORACLE_SQL = {
    "op5_nearest": """
    with e as (select vec_id, min(v) as v from (select vec_id, embedding::double[] as v from embeddings
        where len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0) group by vec_id),
    s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) as score
      from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""
}
