"""Query op4_secret_scan and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.llm import secrets
from samelode.llm.common import id_text, stored, table


def _of(kind: str) -> Column:
    return F.flatten(F.transform(F.filter("found", lambda x: x["kind"] == kind), lambda x: x["spans"]))


def _joined(kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed."""
    def rows_of(i: int, kind: str) -> Column:
        text = lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
        return F.transform(_of(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), text(s).alias("t")))

    rows = F.concat(*[rows_of(i, k) for i, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["t"]), ",")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = id_text(table(spark, sf_dir, "documents"))
    rules = secrets.BASE + secrets.MORE
    ledger = stored(secrets.update(history, None, rules), "ledger")
    # a second run over the ledger finds no pair that it lacks: it compares hashes and reads no text
    ledger = ledger.unionByName(stored(secrets.update(history, ledger, rules), "ledger"))
    found = secrets.findings(history, ledger, rules, ["doc_id"])
    base, every = [r.kind for r in secrets.BASE], [r.kind for r in rules]
    return found.select(
        "doc_id",
        *[F.size(_of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


QUERIES = {"op4_secret_scan": secret_scan}


def _sql() -> str:
    kinds = secrets.BASE + secrets.MORE
    parts = []
    for i, r in enumerate(kinds):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
        select doc_id, {i} as k, '{r.kind}' as kind, start, start + whole as stop from (
          select doc_id, whole, tested, sum(gap + whole) over (partition by doc_id order by i) - whole as start from (
            select doc_id, unnest(range(1, len(m) + 1)) as i, length(unnest(m)) as whole, length(unnest(g)) as tested, length(unnest(b[1:len(m)])) as gap from (
              select doc_id, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {r.group}) as g, string_split_regex(t, '{p}') as b from d)))
        where tested >= {r.least}""")
    base = len(secrets.BASE)
    item = "kind || ':' || start::bigint || ':' || stop::bigint"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    found as ({" union all ".join(parts)}),
    agg as (select doc_id, {", ".join(f"count(*) filter (k = {i}) as n_{r.kind}" for i, r in enumerate(secrets.BASE))},
      coalesce(string_agg({item}, ',' order by start, k) filter (k < {base}), '') as base, string_agg({item}, ',' order by start, k) as spans from found group by doc_id)
    select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in secrets.BASE)},
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join agg using (doc_id)"""


ORACLE_SQL = {"op4_secret_scan": _sql()}
