"""More registered queries: batches of extents and blocks, ordered reports, state tables, outcomes of plans, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samelode.functions import scalars
from samelode.operators import dupes, partial, ranges, requests, state
from samelode.plans.queries import _RUNS, _SIDES, Tables, _every_batch, _found, _sql, query
from samelode.sources import corpus, mounts
from samelode.streaming import batches


def _newest(t: Tables) -> int:
    return t.batched.agg(F.max("dedupe_seq")).first()[0]


def _in_newest(table: str, keys: str, columns: str) -> str:
    return f"select {columns} from {table} where ({keys}) in (select ({keys}) from (select {table}.*, dedupe_seq from {table} join f using (fileid)) group by {keys} having count(*) > 1 and max(dedupe_seq) = (select max(dedupe_seq) from f))"


# Batches of extents and blocks
query("batch_duplicate_extents", lambda t: batches.every_batch(dupes.with_batch(t.extents, t.batched, 1), ["digest", "len"]), _sql("f e", _every_batch("(select e.*, dedupe_seq from e join f using (fileid))", "digest, len")))
query("batch_duplicate_blocks", lambda t: batches.every_batch(dupes.with_batch(t.blocks, t.batched, 1), ["digest"]), _sql("f b", _every_batch("(select b.*, dedupe_seq from b join f using (fileid))", "digest")))
query("duplicate_extents_newest", lambda t: dupes.duplicate_extents(t.extents, t.batched, _newest(t)), _sql("f e", _in_newest("e", "digest, len", "digest, len, fileid, loff, poff")))
query("duplicate_blocks_newest", lambda t: dupes.duplicate_blocks(t.blocks, t.batched, _newest(t)), _sql("f b", _in_newest("b", "digest", "digest, fileid, loff")))


# Reports
def _members(t: Tables) -> DataFrame:
    """Members (kind, len, digest, fileid, loff) of the duplicate groups of all three kinds."""
    whole = t.dup_files.select(F.lit("files").alias("kind"), F.col("size").alias("len"), "digest", "fileid", F.lit(0).cast("long").alias("loff"))
    parts = t.dup_extents.select(F.lit("extents").alias("kind"), "len", "digest", "fileid", "loff")
    block = partial.block_len(F.col("size"), F.col("loff"), corpus.BLOCK)
    # a shuffle at every size, as in numbered_blocks()
    blocks = t.dup_blocks.join(t.files.select("fileid", "size").hint("merge"), "fileid").select(F.lit("blocks").alias("kind"), block.alias("len"), "digest", "fileid", "loff")
    return whole.unionByName(parts).unionByName(blocks)


_KINDS = """m as (select 'files' as kind, size as len, digest, fileid, 0::bigint as loff from df union all select 'extents', len, digest, fileid, loff from de
    union all select 'blocks', (case when loff + 256 <= size then 256 else size % 256 end)::bigint, db.digest, fileid, loff from db join f using (fileid))"""
_PRETTY = "case when {0} >= 1048576 then printf('%.1fMB', ({0} // 1024) / 1024.0) when {0} >= 1024 then printf('%.1fKB', {0} / 1024.0) else {0}::varchar end"
_LINES = f"""select row_number() over (partition by kind order by len, m.digest, fileid, loff) as line, kind, count(*) over (partition by kind, len, m.digest) as n_members, len,
    {_PRETTY.format("len")} as pretty, m.digest[1:8] as id, loff as start, {_PRETTY.format("loff")} as pretty_start, filename from m join f using (fileid)"""
query("ordered_report", lambda t: dupes.ordered_report(_members(t), t.files), _sql("f e b df de db", "")[:-1] + f", {_KINDS} {_LINES}")
query("report_header", lambda t: dupes.report_header(_members(t)), _sql("f e b df de db", "")[:-1] + f", {_KINDS} select kind, count(distinct (len, digest)) as n_groups, count(*) as n_members from m group by kind")
query("partial_report", lambda t: dupes.ordered_report(partial.members(_found(t)).withColumn("kind", F.lit("partial")), t.files), f"{_RUNS}, {_SIDES}, m as (select 'partial' as kind, * from t) {_LINES}")
query(
    "hashstats_header",
    lambda t: dupes.header(state.config(t.docs.limit(0).selectExpr("'' as keyname", "'' as keyval")), t.files, t.blocks, t.extents),
    _sql("f e b", "select '4.1' as version, 131072::bigint as block_size, (select count(*) from f) as num_files, (select count(*) from b) as num_block_hashes, (select count(*) from e) as num_extent_hashes"),
)
query(
    "hashstats_blocks",
    lambda t: dupes.block_places(dupes.top_hashes(t.blocks, t.files, 10), t.blocks, t.files, corpus.BLOCK),
    _sql("f b", "select b.digest, n, n_files, filename, loff, loff // 256 as lblock from b join f using (fileid) join (select digest, count(*) as n, count(distinct fileid) as n_files from b group by digest having count(*) > 1 order by n desc, digest limit 10) x on x.digest = b.digest"),
)
query("scan_progress", lambda t: state.progress(t.batched), _sql("f", "select dedupe_seq, n as files_scanned, tn as total_files, round(n * 100 / tn, 2) as files_percent, b as bytes_scanned, tb as total_bytes, round(b * 100 / tb, 2) as bytes_percent from (select dedupe_seq, (sum(count(*)) over (order by dedupe_seq))::bigint as n, (sum(sum(size)) over (order by dedupe_seq))::bigint as b from f group by dedupe_seq), (select count(*) as tn, sum(size)::bigint as tb from f)"))
# State
query("insert_blocks", lambda t: state.insert_blocks(t.blocks.filter("fileid % 2 = 0"), t.blocks.withColumn("digest", F.expr("case when loff % 768 <> 0 then reverse(digest) end"))), _sql("b", "select fileid, loff, case when loff % 768 <> 0 then reverse(digest) else digest end as digest from b where fileid % 2 = 0 or loff % 768 <> 0"))
query("upsert_cascade", lambda t: state.without_files(t.extents, state.replaced(t.files, t.listing)), _sql("f e li", "select fileid, loff, len, poff, digest from e where fileid not in (select fileid from f where (ino, subvol) in (select (ino, subvol) from ls) or filename in (select filename from ls))"))
# Plans carried out
query("dedupe_attempts", lambda t: requests.attempts(t.planned, t.files, 64), _sql("f e de pe", """, x as (select pe.*, len % 64 = 0 or loff + len = size as whole from pe join f using (fileid) where rn > 1) select len, x.digest, fileid, loff, 1::int as attempt, case when whole then 0 else -22 end::int as status, case when whole then len else 0 end::bigint as bytes from x
    union all select len, digest, fileid, loff, 2::int, case when len > 64 then 0 else -22 end::int, case when len > 64 then len - len % 64 else 0 end::bigint from x where not whole""").replace(") , x as", "), x as"))
query("dedupe_totals", lambda t: requests.outcome_totals(requests.outcome(t.planned, 64)), _sql("f e de pe", "select count(*) as n_requests, 0::bigint as n_failed, coalesce(sum(case when len > 64 then len - len % 64 else len end), 0)::bigint as bytes from pe where rn > 1"))
query("post_dedupe_extents", lambda t: state.update_poff(t.extents, requests.moved(t.planned, t.extents)), _sql("f e de pe", "select e.fileid, e.loff, e.len, coalesce(first.poff, e.poff) as poff, e.digest from e left join pe on pe.fileid = e.fileid and pe.loff = e.loff and pe.rn > 1 left join (select len, digest, poff from pe where rn = 1) first on first.len = pe.len and first.digest = pe.digest"))
query(
    "verify_members",
    lambda t: dupes.differing(t.dup_extents, corpus.line_offsets(t.docs).filter("line <> ''").select("fileid", "loff", F.expr("case when fileid % 17 = 0 then concat(line, '!') else line end").alias("data"))),
    _sql("f e de", "select len, digest, fileid, loff, case when data = first_value(data) over (partition by len, digest order by fileid, loff) then 0 else 1 end::int as status from (select de.*, case when fileid % 17 = 0 then line || '!' else line end as data from de join (select fileid, loff, line from l where len > 0) using (fileid, loff))"),
)
query(
    "manual_request",
    lambda t: requests.single(t.docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("fileid"), F.lit(0).cast("long").alias("loff")), 64, t.docs.withColumnRenamed("doc_id", "fileid")),
    "with p as (select doc_id as ord, doc_id as fileid, substring(text, 1, 64) as data, first_value(doc_id) over (order by doc_id) as o, first_value(substring(text, 1, 64)) over (order by doc_id) as s from documents) select ord, fileid, 0::bigint as loff, case when ord = o then 'source' else 'dest' end as role, case when data = s then 0 else 1 end::int as status, case when ord <> o and data = s then length(data) else 0 end::bigint as bytes from p",
)


# Sources
def _windows(t: Tables) -> DataFrame:
    """A map with holes: of each document, windows of 100 characters every 150, from 40 on, as far as they go."""
    rows = t.docs.filter("n_chars > 40").select("doc_id", "n_chars", F.explode(F.expr("sequence(0L, (n_chars - 41) div 150)")).alias("i"))
    return corpus.mapped_extents(rows.selectExpr("doc_id as fileid", "i * 150 + 40 as loff", "least(100, n_chars - i * 150 - 40) as len"))


_HOLES = "w as (select doc_id as fileid, i * 150 + 40 as loff, least(100, n_chars - i * 150 - 40) as len, text from (select *, unnest(range((n_chars - 41) // 150 + 1)) as i from documents where n_chars > 40))"
query("mapped_extents", lambda t: corpus.digested_extents(_windows(t), t.docs.withColumnRenamed("doc_id", "fileid")), f"with {_HOLES} select fileid, loff, len, 0::bigint as poff, 0::int as flags, md5(substring(text, loff + 1, len)) as digest from w")
query("extents_with_holes", lambda t: corpus.digested_extents(_windows(t), t.docs.withColumnRenamed("doc_id", "fileid"), fold_holes=True).select("fileid", "loff", "len", "digest"), f"with {_HOLES} select fileid, loff, len, md5(case when loff = 40 then substring(text, 1, 40 + len) else substring(text, loff - 49, 50 + len) end) as digest from w")
query(
    "blocks_outside_ignored",
    lambda t: ranges.outside_ignored(t.blocks.join(t.files.select("fileid", "size"), "fileid").select("fileid", "loff", partial.block_len(F.col("size"), F.col("loff"), corpus.BLOCK).alias("len")), t.extents.withColumn("ignored", F.col("len") % 7 == 0)),
    _sql("f e b", "select fileid, b.loff, (case when b.loff + 256 <= size then 256 else size % 256 end)::bigint as len from b join f using (fileid) where not exists (select 1 from e where e.fileid = b.fileid and e.len % 7 = 0 and e.loff < b.loff + (case when b.loff + 256 <= size then 256 else size % 256 end) and e.loff + e.len > b.loff)"),
)
query("stream_digest", lambda t: corpus.stream_digest(corpus.chunks(t.docs)), "select doc_id as fileid, md5(text) as digest from documents where text <> ''")
query("digest_check", lambda t: corpus.digest_check(t.files.select("fileid", F.expr("case when fileid % 5 = 0 then reverse(digest) else digest end").alias("digest")), t.docs.withColumnRenamed("doc_id", "fileid")), _sql("f", "select fileid, case when fileid % 5 = 0 then reverse(digest) else digest end as digest, digest as actual, (case when fileid % 5 = 0 then reverse(digest) else digest end) = digest as same from f"))
query("mtime_ns", lambda t: corpus.table(t.spark, t.dir, "events").select("event_id", corpus.clock_nanoseconds("ts").alias("mtime")), "select event_id, epoch_us(ts) * 1000 as mtime from events")
query(
    "uuids",
    lambda t: t.files.select("fileid", F.upper("digest").alias("h")).select("fileid", scalars.uuid_text(F.unhex("h")).alias("uuid")).select("fileid", "uuid", F.lower(F.hex(scalars.uuid_bytes(F.upper("uuid")))).alias("bytes"), scalars.is_null_uuid(scalars.uuid_bytes(F.expr("case when fileid % 3 = 0 then '00000000-0000-0000-0000-000000000000' when fileid % 3 = 1 then uuid else 'no uuid' end"))).alias("missing")),
    _sql("f", "select fileid, digest[1:8] || '-' || digest[9:12] || '-' || digest[13:16] || '-' || digest[17:20] || '-' || digest[21:32] as uuid, digest as bytes, fileid % 3 <> 1 as missing from f"),
)
_MOUNTS = [("/", "root-fs", "ext4"), ("/src1", "fs-1", "btrfs"), ("/src1/fr/", "fs-1-fr", "xfs"), ("/src2/e", "none", "xfs"), ("/src2", "fs-2", "zfs")]
query(
    "fs_of_path",
    lambda t: mounts.nearest_root(t.files.select("fileid", "filename"), t.spark.createDataFrame(_MOUNTS, "root string, fs_uuid string, fs_type string")).withColumn("shares", scalars.shares_extents(F.col("fs_type"))),
    _sql("f", "select fileid, filename, fs_uuid, fs_type, fs_type in ('btrfs', 'xfs') as shares from (select fileid, filename, fs_uuid, fs_type, row_number() over (partition by fileid order by length(root) desc) as r from f join (values " + ", ".join(str((r.rstrip("/"), u, y)) for r, u, y in _MOUNTS) + ") v(root, fs_uuid, fs_type) on starts_with(filename, root || '/')) where r = 1"),
)
