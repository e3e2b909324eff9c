"""Query op1_ngram_jaccard and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samelode.llm import ngram_join
from samelode.llm.common import table


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op1_ngram_jaccard": ngram_jaccard}
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "op1_ngram_jaccard": rf"""
    with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    g as (select distinct doc_id, array_to_string(ws[s:s + 3], ' ') as gram from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as s from w where len(ws) > 0)),
    n as (select doc_id, count(*) as size from g group by doc_id),
    p as (select a.doc_id as u, b.doc_id as v, count(*) as i from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
    e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * i >= 85 * (x.size + y.size - i)),
    s as (select u, v from e union all select v, u from e),
    r as (select doc_id as u, doc_id as v from w union select r.u, s.v from r join s on r.v = s.u)
    select w.doc_id, coalesce(size, 0)::bigint as n_shingles, min(r.v)::bigint as component_id
    from w left join n on n.doc_id = w.doc_id join r on r.u = w.doc_id group by all"""
}
