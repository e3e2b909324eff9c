"""Query op2_personal_data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.llm import pii
from samelode.llm.common import table


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(table(spark, sf_dir, "documents"), pii.fit(pii.labelled(spark)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = found.withColumn("every", F.concat("base", "more"))
    return every.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("every").alias("spans"))


QUERIES = {"op2_personal_data": personal_data}
ORACLE_SQL: dict[str, str] = {}
