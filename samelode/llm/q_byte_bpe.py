"""Query op8_byte_bpe."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from samelode.llm import byte_bpe
from samelode.llm.common import table


def vocabulary(path: str | None = None) -> tuple[str, str]:
    """Path of the rank file, and the pre-token pattern that belongs to it."""
    import public_tokenizers

    return path or os.environ.get("SAMELODE_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def byte_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


QUERIES = {"op8_byte_bpe": byte_bpe_digests}
ORACLE_SQL: dict[str, str] = {}
