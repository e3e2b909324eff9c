"""Query op6_decontamination and its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from samelode.llm import decontam
from samelode.llm.common import table


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": decontamination}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), '%s', '%s'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')" % (string.ascii_uppercase, string.ascii_lowercase)
ORACLE_SQL = {
    "op6_decontamination": f"""
    with d as (select doc_id, {_WORDS} as ws from documents),
    b as (select item_id::varchar as item, {_WORDS} as ws from benchmark),
    bw as (select distinct item, least(10, len(ws)) as k, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') as w
      from (select item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as s from b where len(ws) > 0)),
    dw as (select doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') as w
      from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as s from d, (select distinct k from bw))),
    m as (select distinct doc_id, item, k, s from dw join bw using (k, w)),
    hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from m) group by doc_id),
    dp as (select doc_id, unnest(ws) as term, unnest(range(len(ws))) as pos from d),
    cnt as (select term, count(*) as n from dp group by term),
    bq as (select rid, item, len(ws) as m, q, t.term, coalesce(n, 0) as n from (select rid, item, ws, unnest(ws) as term, unnest(range(len(ws))) as q from (select row_number() over () as rid, item, ws from (select distinct item, ws from b where len(ws) > 0))) t left join cnt on cnt.term = t.term),
    bs as (select rid, s, q, term, n, item, row_number() over (partition by rid, s order by n, q) as r from (select *, unnest(range(greatest(q - 9, 0), least(q, greatest(m - 10, 0)) + 1)) as s from bq)),
    pr as (select distinct x.item, x.q as q1, x.term as t1, y.q as q2, y.term as t2 from (select * from bs where r = 1 and n > 0) x left join (select * from bs where r = 2) y on x.rid = y.rid and x.s = y.s),
    nr as (select distinct a.doc_id, item from pr join dp a on a.term = t1 left join dp c on c.doc_id = a.doc_id and c.term = t2 and abs((c.pos - q2) - (a.pos - q1)) <= 5 where t2 is null or c.pos is not null),
    near as (select doc_id, count(*) as n_near from nr group by doc_id),
    it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from m) group by doc_id)
    select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
      sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
    from d left join hit using (doc_id) left join it using (doc_id) left join near using (doc_id)"""
}
