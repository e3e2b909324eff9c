"""All queries of the library and their SQL."""

from __future__ import annotations

from samelode.plans import reports  # noqa: F401  (registers more queries)
from samelode.plans.queries import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
