"""Query op3_quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.llm import quality
from samelode.llm.common import table


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_quality": quality_scores}
ORACLE_SQL: dict[str, str] = {}
