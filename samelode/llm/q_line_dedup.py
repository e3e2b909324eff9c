"""Query op9_line_dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.llm import line_dedup
from samelode.llm.common import table


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": line_dedup_query}
ORACLE_SQL = {
    "op9_line_dedup": r"""
    with l as (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
    u as (select line, string_split(line, ' ') as ws, min((doc_id, pos)) as place from l where regexp_matches(line, '[^\x09-\x0D\x20]') group by line),
    w as (select * from u where len(ws) >= 5),
    v as (select line, place, len(ws) as n, j, array_to_string(ws[:j - 1] || ws[j + 1:], ' ') as key from (select line, place, ws, unnest(range(1, len(ws) + 1)) as j from w)),
    near as (select a.line from v a join v b on a.key = b.key and a.n = b.n and a.j = b.j and b.place < a.place
      union select a.line from v a join w b on a.key = b.line and b.place < a.place
      union select a.line from w a join v b on a.line = b.key and b.place < a.place),
    marked as (select l.doc_id, l.pos, l.line, u.place is not null and ((l.doc_id, l.pos) <> u.place or near.line is not null) as gone
      from l left join u on l.line = u.line left join (select distinct line from near) near on l.line = near.line)
    select doc_id, case when count(*) = 1 and max(line) = '' then 0 else count(*) end::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
      sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
    from marked group by doc_id"""
}
