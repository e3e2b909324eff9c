"""Query op10_suffix_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.llm import suffix_dedup
from samelode.llm.common import table


def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cleaned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": suffix_dedup_query}
ORACLE_SQL: dict[str, str] = {}
