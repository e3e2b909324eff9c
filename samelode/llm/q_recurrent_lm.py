"""Query op7_language_model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samelode.llm import recurrent_lm
from samelode.llm.common import table


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.scored(table(spark, sf_dir, "documents"))


QUERIES = {"op7_language_model": language_model}
ORACLE_SQL: dict[str, str] = {}
