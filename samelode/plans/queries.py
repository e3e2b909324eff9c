"""The registered queries. Each is a Spark plan over a whole table and, where it can be, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samelode.functions import scalars
from samelode.operators import dupes, partial, ranges, requests, state
from samelode.sources import corpus
from samelode.streaming import batches

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The mapping of the corpus tables, in SQL.
_CTE = {
    "f": """f as (select doc_id as fileid, '/' || source || '/' || lang || '/' || doc_id as filename, doc_id as ino, source as subvol, n_chars as size, doc_id * 1000000000 as mtime,
        (1 + row_number() over (order by doc_id) // 256)::int as dedupe_seq, md5(text) as digest, case when n_chars <= 64 then 1 else 0 end::int as flags from documents)""",
    "e": """l as (select doc_id as fileid, line, length(line)::bigint as len, (sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1)::bigint as loff
          from (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents))),
        e as (select fileid, loff, len, digest, case when fileid % 10 = 0 then first_value(1 + fileid * 1048576 + loff) over (partition by digest, len order by fileid, loff) else 1 + fileid * 1048576 + loff end as poff
          from (select fileid, loff, len, md5(line) as digest from l where len > 0))""",
    "b": """b as (select doc_id as fileid, (i * 256)::bigint as loff, md5(substring(text, (i * 256 + 1)::bigint, 256)) as digest from (select doc_id, text, unnest(range((n_chars + 255) // 256)) as i from documents))""",
    "df": "df as (select * from f where flags & 1 = 0 and digest is not null and (digest, size) in (select (digest, size) from f where flags & 1 = 0 group by digest, size having count(*) > 1))",
    "de": "de as (select e.* from e where (digest, len) in (select (digest, len) from e group by digest, len having count(*) > 1))",
    "db": "db as (select b.* from b where digest in (select digest from b group by digest having count(*) > 1))",
    "pe": """pe as (select *, row_number() over (partition by len, digest order by fileid, loff) as rn from de)""",
    "li": """li as (select 'file' || doc_id as path, 'fs' || (doc_id % 3) as fs_uuid, doc_id as ord from documents),
        ls as (select case when fileid % 7 = 0 then filename || '.new' else filename end as filename, ino, subvol, case when fileid % 5 = 0 then size + 1 else size end as size, mtime from f where fileid % 11 <> 0
          union all select '/added/' || fileid, fileid + 100000000, subvol, size, mtime from f where fileid % 13 = 0)""",
    "sz": "sz as (select fileid, ['', 'b', 'K', 'm', 'G', 't', 'P', 'x'][(1 + fileid % 8)::bigint] as u, fileid from f), st as (select fileid, fileid || u as t, u from sz)",
    "nb": "nb as (select db.digest, db.fileid, db.loff, row_number() over (partition by db.fileid order by db.loff) as idx, case when loff + 256 <= size then 256 else size % 256 end as blen from db join f using (fileid))",
    "lx": """lx as (select o_orderkey as fileid, 100 * (o_orderkey % 7) as x from orders),
        le as (select l_orderkey as fileid, l_partkey, l_suppkey, (sum(l_quantity::bigint) over w - l_quantity::bigint)::bigint as loff, l_quantity::bigint as len, l_returnflag = 'R' as shared, l_linestatus = 'O' as delalloc
          from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax, l_quantity, l_returnflag, l_linestatus rows unbounded preceding))""",
}


def _sql(ctes: str, body: str) -> str:
    return "with " + ", ".join(_CTE[c] for c in ctes.split()) + " " + body


def _every_batch(table: str, keys: str, where: str = "") -> str:
    """Each group of `keys` in each batch in which it gains a member, with its members up to then, in SQL."""
    return f"select * from (select dedupe_seq as batch, {keys}, (sum(c) over (partition by {keys} order by dedupe_seq))::bigint as n_members from (select dedupe_seq, {keys}, count(*) as c from {table} {where} group by all)) where n_members > 1"


_ZERO = "decode(unhex('00'), 'utf-8')"


class Tables:
    """The mapped tables of a folder, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.docs = corpus.table(spark, sf_dir, "documents")

    files = property(lambda s: corpus.files(s.docs, 0))
    batched = property(lambda s: corpus.files(s.docs))
    extents = property(lambda s: corpus.extents(s.docs))
    blocks = property(lambda s: corpus.blocks(s.docs))
    dup_files = property(lambda s: dupes.duplicate_files(s.files))
    dup_extents = property(lambda s: dupes.duplicate_extents(s.extents, s.files))
    dup_blocks = property(lambda s: dupes.duplicate_blocks(s.blocks, s.files))
    planned = property(lambda s: requests.plan(s.dup_extents))
    numbered = property(lambda s: partial.numbered_blocks(s.dup_blocks, s.files, corpus.BLOCK))

    @property
    def listing(self) -> DataFrame:
        f = self.files
        kept = f.filter("fileid % 11 <> 0").select(F.expr("case when fileid % 7 = 0 then filename || '.new' else filename end").alias("filename"), "ino", "subvol", F.expr("case when fileid % 5 = 0 then size + 1 else size end").alias("size"), "mtime")
        return kept.unionByName(f.filter("fileid % 13 = 0").select(F.concat(F.lit("/added/"), F.col("fileid").cast("string")).alias("filename"), (F.col("ino") + 100000000).alias("ino"), "subvol", "size", "mtime"))

    @property
    def new_names(self) -> DataFrame:
        """New names for some files: names of their own, the name of the next file, and one name for two files."""
        f = self.batched.select("fileid", "filename")
        following = f.select((F.col("fileid") - 1).alias("fileid"), F.col("filename").alias("next"))
        name = "case when fileid % 50 = 0 then concat('/moved/', cast(fileid as string)) when fileid % 50 = 1 then next when fileid % 100 in (3, 4) then concat('/both/', cast(fileid div 100 as string)) end"
        return f.join(following, "fileid", "left").select("fileid", F.expr(name).alias("new_name")).filter("new_name is not null")

    @property
    def paths(self) -> DataFrame:
        return self.docs.select(F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("fs"), (F.col("doc_id") % 3).cast("string")).alias("fs_uuid"), F.col("doc_id").alias("ord"))

    @property
    def stream(self) -> DataFrame:
        """A list of paths with blank lines: every fifth line ends a group."""
        return self.docs.select(F.col("doc_id").alias("ord"), F.expr("case when doc_id % 5 = 4 then '' else 'file' || doc_id end").alias("line"))

    def zeroed(self, at: int, n: str) -> DataFrame:
        """The documents; in every ninth, `n` characters from `at` on, as far as it goes, are zeros."""
        text = f"concat(substring(text, 1, {at}), repeat({_ZERO}, cast(least({n}, n_chars - {at}) as int)), substring(text, cast({at} + {n} + 1 as int)))"
        return self.docs.withColumn("text", F.expr(f"case when doc_id % 9 = 0 and n_chars > {at} then {text} else text end"))

    @property
    def points(self) -> DataFrame:
        return corpus.table(self.spark, self.dir, "orders").select(F.col("o_orderkey").alias("fileid"), (F.lit(100) * (F.col("o_orderkey") % 7)).alias("x"))

    @property
    def line_extents(self) -> DataFrame:
        q = "cast(l_quantity as bigint)"
        order = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax, l_quantity, l_returnflag, l_linestatus"
        running = f"sum({q}) over (partition by l_orderkey order by {order} rows unbounded preceding) - {q}"
        return corpus.table(self.spark, self.dir, "lineitem").selectExpr("l_orderkey as fileid", f"{running} as loff", f"{q} as len", "l_returnflag = 'R' as shared", "l_linestatus = 'O' as delalloc")


def _nonzero(docs: DataFrame, size: int = corpus.BLOCK) -> DataFrame:
    """(fileid, loff) of the chunks of whole texts that are not all zeros."""
    return corpus.chunks(docs, size).filter(~scalars.is_zero(F.col("data"))).select("fileid", "loff")


def query(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql:
        ORACLE[name] = sql


# Listings and lookups
query("list_files", lambda t: t.files.select("filename", "ino", "subvol"), _sql("f", "select filename, ino, subvol from f"))
query("list_filerecs", lambda t: t.files.select("ino", "subvol", "size", "filename"), _sql("f", "select ino, subvol, size, filename from f"))
query(
    "config_get",
    lambda t: state.config(t.docs.agg(F.count("*").cast("string").alias("keyval")).select(F.lit("dedupe_sequence").alias("keyname"), "keyval")),
    "select * from (values ('hash_type', 'md5'), ('block_size', '131072'), ('version_major', '4'), ('version_minor', '1')) v(keyname, keyval) union all select 'dedupe_sequence', count(*)::varchar from documents",
)
query("describe_file", lambda t: t.files.join(t.listing.select("ino", "subvol"), ["ino", "subvol"]).select("ino", "subvol", "mtime", "size", "filename", "fileid"), _sql("f li", "select ino, subvol, f.mtime, f.size, f.filename, f.fileid from f join (select ino, subvol from ls) using (ino, subvol)"))
query("load_filerec", lambda t: t.dup_blocks.select("fileid").distinct().join(t.files, "fileid").select("fileid", "filename", "size"), _sql("f b db", "select fileid, filename, size from f where fileid in (select fileid from db)"))
query("fdupes_groups", lambda t: corpus.closed_groups(t.stream), "with s as (select doc_id as ord, case when doc_id % 5 = 4 then '' else 'file' || doc_id end as line from documents), g as (select *, (1 + sum((line = '')::int) over (order by ord))::int as grp from s) select grp, ord, line as path from g where line <> '' and grp <= (select count(*) from s where line = '')")
# Digests
query("file_digest", lambda t: t.files.select("fileid", "size", "digest"), _sql("f", "select fileid, size, digest from f"))
query("extent_digest", lambda t: t.extents, _sql("e", "select fileid, loff, len, poff, digest from e"))
query("block_digest", lambda t: t.blocks, _sql("b", "select * from b"))
query("block_len", lambda t: t.blocks.join(t.files, "fileid").select("fileid", "loff", partial.block_len(F.col("size"), F.col("loff"), 256).alias("blen")), _sql("f b", "select fileid, loff, (case when loff + 256 <= size then 256 else size % 256 end)::bigint as blen from b join f using (fileid)"))
query(
    "nonzero_blocks",
    lambda t: _nonzero(t.docs.withColumn("text", F.expr(f"case doc_id % 9 when 0 then repeat({_ZERO}, cast(n_chars as int)) when 1 then repeat('a', cast(n_chars as int)) when 2 then concat(repeat({_ZERO}, cast(n_chars - 1 as int)), 'x') else text end")), 64),
    "with z as (select doc_id, n_chars, case doc_id % 9 when 0 then repeat(chr(0), n_chars) when 1 then repeat('a', n_chars) when 2 then repeat(chr(0), n_chars - 1) || 'x' else text end as text from documents), c as (select doc_id as fileid, (i * 64)::bigint as loff, substring(text, (i * 64 + 1)::bigint, 64) as data from (select doc_id, text, unnest(range((n_chars + 63) // 64)) as i from z)) select fileid, loff from c where replace(data, chr(0), '') <> ''",
)
query(
    "nonzero_block_places",
    lambda t: _nonzero(t.zeroed(corpus.BLOCK, "256")),
    "with z as (select doc_id, n_chars, case when doc_id % 9 = 0 and n_chars > 256 then substring(text, 1, 256) || repeat(chr(0), least(256, n_chars - 256)) || substring(text, 513) else text end as text from documents), c as (select doc_id as fileid, (i * 256)::bigint as loff, substring(text, (i * 256 + 1)::bigint, 256) as data from (select doc_id, text, unnest(range((n_chars + 255) // 256)) as i from z)) select fileid, loff from c where replace(data, chr(0), '') <> ''",
)
# Duplicates
query("duplicate_files", lambda t: t.dup_files, _sql("f df", "select digest, size, fileid, filename from df"))
query("duplicate_extents", lambda t: t.dup_extents, _sql("f e de", "select digest, len, fileid, loff, poff from de"))
query("duplicate_blocks", lambda t: t.dup_blocks, _sql("b db", "select digest, fileid, loff from db"))
query("duplicate_files_batch2", lambda t: dupes.duplicate_files(t.batched, 2), _sql("f", "select digest, size, fileid, filename from f where dedupe_seq <= 2 and flags & 1 = 0 and (digest, size) in (select (digest, size) from f where dedupe_seq <= 2 and flags & 1 = 0 group by digest, size having count(*) > 1) and (digest, size) in (select (digest, size) from f where dedupe_seq = 2 and flags & 1 = 0)"))
query("duplicate_files_newest", lambda t: dupes.duplicate_files(t.batched, t.batched.agg(F.max("dedupe_seq")).first()[0]), _sql("f", "select digest, size, fileid, filename from f where flags & 1 = 0 and (digest, size) in (select (digest, size) from f where flags & 1 = 0 group by digest, size having count(*) > 1) and (digest, size) in (select (digest, size) from f where dedupe_seq = (select max(dedupe_seq) from f) and flags & 1 = 0)"))
query("duplicate_extents_after_files", lambda t: dupes.duplicate_extents(t.extents, t.files, None, True), _sql("f e df", "select digest, len, fileid, loff, poff from e x where fileid not in (select fileid from df) and (digest, len) in (select (digest, len) from e where fileid not in (select fileid from df) group by digest, len having count(*) > 1)"))
query("nondupe_extents", lambda t: dupes.nondupe_extents(t.extents), _sql("e", "select fileid, loff, len, poff, digest from e where digest in (select digest from e group by digest having count(*) = 1)"))
query("find_blocks", lambda t: t.blocks.join(t.files.select("fileid", "filename"), "fileid").select("digest", "filename", "loff"), _sql("f b", "select b.digest, filename, loff from b join f using (fileid)"))
query("digest_file_counts", lambda t: dupes.file_counts(t.blocks, t.files), _sql("b", "select digest, count(distinct fileid) as n_files from b group by digest"))
query("dupes_report", lambda t: dupes.report(t.dup_files), _sql("f df", "select size, count(*) over (partition by digest, size) as n_files, digest[1:8] as id, filename, 0::bigint as start from df"))
# Groups
query("dupe_groups", lambda t: dupes.groups(t.dup_extents), _sql("f e de", "select len, digest, count(*) as n_members, count(distinct fileid) as n_files from de group by len, digest"))
query("group_totals", lambda t: dupes.totals(dupes.groups(t.dup_extents)), _sql("f e de", "select count(distinct (len, digest)) as num_dupes, count(*) as num_extents from de"))
query("reclaimable_bytes", lambda t: dupes.reclaimable(dupes.groups(t.dup_extents)), _sql("f e de", "select len, digest, (len * (count(*) - 1))::bigint as bytes from de group by len, digest"))
query("clean_deduped", lambda t: dupes.clean_deduped(t.dup_extents), _sql("f e de", "select len, digest, fileid, loff, poff from (select *, count(*) over (partition by len, digest) as c from (select *, row_number() over (partition by len, digest, poff order by fileid, loff) as r from de) where poff = 0 or r = 1) where c > 1"))
query("shared_places", lambda t: dupes.shared_places(t.dup_extents, t.extents), _sql("f e de", "select len, digest, poff, count(*) as n from de where poff <> 0 group by all having count(*) > 1"))
query("grown_members", lambda t: dupes.grown(t.dup_extents.select("len", "digest", "fileid", "loff"), t.extents.select("fileid", "loff", F.expr("case when fileid % 3 = 0 then len - 1 else len end").alias("plen"))).select("len", "digest", "fileid", "loff", "plen"), _sql("f e de", "select len, digest, fileid, loff, len - 1 as plen from de where fileid % 3 = 0"))
query("verify_groups", lambda t: dupes.verify(t.dup_files, t.docs.select(F.col("doc_id").alias("fileid"), F.sha2("text", 256).alias("proof"))), _sql("f df", "select df.digest, size, count(distinct sha256(text)) as n_contents from df join documents on doc_id = fileid group by all"))
query("post_dedupe_state", lambda t: dupes.after_dedupe(t.extents, t.files), _sql("f e df", "select fileid, loff, len, poff, digest from e where fileid not in (select fileid from df)"))
# Statistics
query("top_block_hashes", lambda t: dupes.frequencies(t.blocks), _sql("b", "select digest, count(*) as n from b group by digest having count(*) > 1"))
query("top_extent_hashes", lambda t: dupes.frequencies(t.extents), _sql("e", "select digest, count(*) as n from e group by digest having count(*) > 1"))
query("top_n_hashes", lambda t: dupes.top_hashes(t.extents, t.files, 10), _sql("e", "select digest, count(*) as n, count(distinct fileid) as n_files from e group by digest having count(*) > 1 order by n desc, digest limit 10"))
query("hash_places", lambda t: dupes.places(dupes.top_hashes(t.extents, t.files, 10), t.extents, t.files), _sql("f e", "select e.digest, filename, loff from e join f using (fileid) where e.digest in (select digest from e group by digest having count(*) > 1 order by count(*) desc, digest limit 10)"))
query("hashfile_stats", lambda t: t.blocks.agg(F.count("*").alias("n_blocks")).crossJoin(t.extents.agg(F.count("*").alias("n_extents"))).crossJoin(t.files.agg(F.count("*").alias("n_files"))), _sql("f e b", "select (select count(*) from b) as n_blocks, (select count(*) from e) as n_extents, (select count(*) from f) as n_files"))
query("max_dedupe_seq", lambda t: t.batched.agg(F.max("dedupe_seq").alias("max_seq")), _sql("f", "select max(dedupe_seq) as max_seq from f"))
query("blocks_by_file", lambda t: dupes.blocks_by_file(t.dup_blocks), _sql("b db", "select digest, fileid, count(*) as n, string_agg(loff::varchar, ',' order by loff) as loffs from db group by all"))
query("shared_per_file", lambda t: ranges.shared_per_file(t.line_extents), "select l_orderkey as fileid, sum(l_quantity::bigint)::bigint as shared from lineitem where l_returnflag = 'R' group by 1")
# Ranges
query("extent_at_offset", lambda t: ranges.extent_at(t.points, t.line_extents), _sql("lx", "select fileid, x, loff, len from lx join le using (fileid) where loff <= x and x < loff + len"))
query("extent_asof", lambda t: ranges.extent_asof(t.points, t.line_extents), _sql("lx", "select fileid, x, min(loff) as loff from lx join le using (fileid) where loff + len - 1 >= x group by all"))
query("shared_bytes", lambda t: ranges.shared_bytes(t.points.select("fileid", F.col("x").alias("lo"), (F.col("x") + 90).alias("hi")), t.line_extents), _sql("lx", "select lx.fileid, x as lo, x + 90 as hi, coalesce(sum(case when le.fileid is not null then least(loff + len, x + 90) - greatest(loff, x) end), 0)::bigint as shared from lx left join le on lx.fileid = le.fileid and shared and not delalloc and loff < x + 90 and loff + len > x group by all"))
query(
    "shared_gain",
    lambda t: requests.gained(*[ranges.shared_bytes(t.points.select("fileid", F.col("x").alias("lo"), (F.col("x") + 90).alias("hi")), e) for e in (t.line_extents, t.line_extents.withColumn("shared", F.expr("shared or loff % 2 = 0")))]),
    _sql("lx", "select coalesce(sum(least(loff + len, x + 90) - greatest(loff, x)), 0)::bigint as bytes from lx join le on lx.fileid = le.fileid and not shared and loff % 2 = 0 and not delalloc and loff < x + 90 and loff + len > x"),
)
query(
    "outside_ignored",
    lambda t: ranges.outside_ignored(t.points.select("fileid", F.col("x").alias("loff"), F.lit(20).cast("long").alias("len")), t.line_extents.withColumn("ignored", scalars.ignored(F.col("len") * 256, 0xA00) & F.col("shared"))),
    _sql("lx", "select fileid, x as loff, 20::bigint as len from lx where not exists (select 1 from le where le.fileid = lx.fileid and (len * 256) & 2560 <> 0 and shared and loff < x + 20 and loff + len > x)"),
)
# Requests
query("dedupe_plan", lambda t: t.planned.withColumn("rn", F.col("rn").cast("long")), _sql("f e de pe", "select len, digest, rn, case when rn = 1 then 'target' else 'dest' end as role, fileid, loff from pe"))
query("dedupe_requests", lambda t: requests.requests(t.dup_extents), _sql("f e de pe", "select len, digest, ((rn - 2) // 119)::bigint as request, count(*) as n_dest from pe where rn > 1 group by all"))
query("dedupe_outcome", lambda t: requests.outcome(t.planned, 64), _sql("f e de pe", "select len, digest, fileid, loff, 0::int as status, case when len > 64 then len - len % 64 else len end::bigint as bytes from pe where rn > 1"))
query("fdupes_requests", lambda t: requests.chunks(t.dup_files.select(F.concat_ws(":", "digest", "size").alias("grp"), F.col("fileid").alias("ord"), F.col("filename").alias("path"))), _sql("f df", "select * from (select grp, ((rn - 1) // 120)::bigint as chunk, max_by(filename, fileid) as target, count(*) - 1 as n_dest from (select digest || ':' || size as grp, fileid, filename, row_number() over (partition by digest, size order by fileid desc) as rn from df) group by all) where n_dest > 0"))
# Filters
query("exclude_files", lambda t: t.files.filter(~scalars.excluded(F.col("filename"), ["/src1/*", "*/fr/?", "src2/e[ns]/*7"])).select("filename"), _sql("f", "select filename from f where not regexp_matches(filename, '^/src1/.*$') and not regexp_matches(filename, '^/.*/fr/.$') and not regexp_matches(filename, '^/src2/e[ns]/.*7$')"))
query("nonempty_files", lambda t: t.files.filter("size > 0").select("fileid", "size"), _sql("f", "select fileid, size from f where size > 0"))
query("locked_fs", lambda t: state.on_locked_fs(t.paths), _sql("f li", "select * from li where fs_uuid = (select fs_uuid from li order by ord limit 1)"))
query("changed_files", lambda t: state.changes(t.listing, t.files).filter("status = 'changed'"), _sql("f li", "select ls.ino, ls.subvol, ls.filename, 'changed' as status from ls join f using (ino, subvol) where not (f.filename <> ls.filename and f.filename not in (select filename from ls)) and (f.size <> ls.size or f.mtime <> ls.mtime)"))
query("renamed_files", lambda t: state.changes(t.listing, t.files).filter("status = 'renamed'"), _sql("f li", "select ls.ino, ls.subvol, ls.filename, 'renamed' as status from ls join f using (ino, subvol) where f.filename <> ls.filename and f.filename not in (select filename from ls)"))
query("deleted_files", lambda t: state.deleted(t.files, t.listing), _sql("f li", "select fileid, filename from f where filename not in (select filename from ls)"))
query("incremental_scan", lambda t: batches.incremental(t.listing, t.files), _sql("f li", "select ls.ino, ls.subvol, ls.filename, case when f.ino is null then 'new' when f.filename <> ls.filename and f.filename not in (select filename from ls) then 'renamed' else 'changed' end as status from ls left join f using (ino, subvol) where f.ino is null or f.filename <> ls.filename or f.size <> ls.size"))
query("assign_batches", lambda t: t.batched.select("fileid", "dedupe_seq"), _sql("f", "select fileid, dedupe_seq from f"))
query("batch_duplicates", lambda t: batches.every_batch(t.batched.filter("flags & 1 = 0"), ["digest", "size"]), _sql("f", _every_batch("f", "digest, size", "where flags & 1 = 0")))
# State
query("upsert_files", lambda t: state.upsert_files(t.batched, t.listing, 9), _sql("f li", "select * from f where (ino, subvol) not in (select (ino, subvol) from ls) and filename not in (select filename from ls) union all select (select max(fileid) from f) + row_number() over (order by filename), filename, ino, subvol, size, mtime, 9::int, null, null from ls"))
query("mark_scanned", lambda t: state.mark_scanned(t.batched.withColumn("digest", F.lit(None).cast("string")).withColumn("flags", F.lit(None).cast("int")), t.files.filter("fileid % 3 = 0")), _sql("f", "select * replace (case when fileid % 3 = 0 then digest end as digest, case when fileid % 3 = 0 then flags end as flags) from f"))
query("prune_unscanned", lambda t: state.prune_unscanned(t.files.withColumn("digest", F.expr("case when fileid % 3 = 0 then digest end"))).select("fileid", "digest"), _sql("f", "select fileid, digest from f where fileid % 3 = 0"))
query("update_poff", lambda t: state.update_poff(t.extents, t.extents.filter("fileid % 4 = 0").select("fileid", "loff", (F.col("poff") + 7).alias("poff"))), _sql("e", "select fileid, loff, len, case when fileid % 4 = 0 then poff + 7 else poff end as poff, digest from e"))
query("remove_hashes", lambda t: state.without_files(t.blocks, t.files.filter("fileid % 4 = 0")), _sql("b", "select * from b where fileid % 4 <> 0"))
query("remove_file_cascade", lambda t: state.without_files(t.extents, t.files.filter(F.col("filename").rlike("^/src3/"))), _sql("f e", "select fileid, loff, len, poff, digest from e where fileid not in (select fileid from f where filename like '/src3/%')"))
query("insert_extents", lambda t: state.insert_extents(t.extents.filter("fileid % 2 = 0"), t.extents.withColumn("len", F.expr("case when loff % 3 = 0 then 0 else len end"))), _sql("e", "select fileid, loff, len, poff, digest from e where fileid % 2 = 0 or loff % 3 <> 0"))
query(
    "config_put",
    lambda t: state.config(state.config_put(t.docs.limit(0).selectExpr("'' as keyname", "'' as keyval"), t.batched.agg(F.max("dedupe_seq").cast("string").alias("keyval")).select(F.lit("dedupe_sequence").alias("keyname"), "keyval"))),
    _sql("f", "select * from (values ('hash_type', 'md5'), ('block_size', '131072'), ('version_major', '4'), ('version_minor', '1')) v(keyname, keyval) union all select 'dedupe_sequence', max(dedupe_seq)::varchar from f"),
)
query(
    "rename_file",
    lambda t: state.rename(t.batched, t.new_names),
    _sql("f", "select * exclude (nn, k) replace (coalesce(nn, filename) as filename) from (select *, row_number() over (partition by coalesce(nn, filename) order by nn is not null desc, fileid desc) as k from (select f.*, case when f.fileid % 50 = 0 then '/moved/' || f.fileid when f.fileid % 50 = 1 then g.filename when f.fileid % 100 in (3, 4) then '/both/' || (f.fileid // 100) end as nn from f left join f g on g.fileid = f.fileid + 1)) where k = 1"),
)
# Partial matches
query("partial_seeds", lambda t: partial.seeds(_unique(t), t.numbered), None)
query("partial_nosame", lambda t: partial.seeds(_unique(t), t.numbered, nosame=True), None)
query("partial_matches", lambda t: partial.matches(partial.seeds(_unique(t), t.numbered), t.numbered, corpus.BLOCK))
query("partial_matches_literal", lambda t: partial.matches(partial.seeds(_unique(t), t.numbered), t.numbered, corpus.BLOCK, literal=True))
query("partial_groups", lambda t: dupes.groups(partial.members(_found(t))))
query("all_extent_groups", lambda t: dupes.groups(t.dup_extents.select("len", "digest", "fileid", "loff").unionByName(partial.members(_found(t)).drop("poff"))))
# Scalars
query("parse_size", lambda t: t.docs.select(F.col("doc_id").alias("fileid"), scalars.parse_size(F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(u) for u in ("", "b", "K", "m", "G", "t", "P", "x")]), (F.col("doc_id") % 8 + 1).cast("int")))).alias("bytes")), _sql("f sz", "select fileid, case u when '' then fileid when 'b' then fileid when 'K' then fileid * 1024 when 'm' then fileid * 1048576 when 'G' then fileid * 1073741824 when 't' then fileid * 1099511627776 when 'P' then fileid * 1125899906842624 end::bigint as bytes from st"))
query("pretty_size", lambda t: t.docs.select("doc_id", scalars.pretty_size(F.col("n_chars") * F.col("doc_id") * F.col("doc_id")).alias("pretty")), "with s as (select doc_id, n_chars * doc_id * doc_id as s from documents) select doc_id, case when s >= 1125899906842624 then printf('%.1fPB', (s // 1099511627776) / 1024.0) when s >= 1099511627776 then printf('%.1fTB', (s // 1073741824) / 1024.0) when s >= 1073741824 then printf('%.1fGB', (s // 1048576) / 1024.0) when s >= 1048576 then printf('%.1fMB', (s // 1024) / 1024.0) when s >= 1024 then printf('%.1fKB', s / 1024.0) else s::varchar end as pretty from s")
query("short_ids", lambda t: t.files.select("fileid", scalars.short_id(F.col("digest")).alias("id")), _sql("f", "select fileid, digest[1:8] as id from f"))
query("num_digits", lambda t: t.docs.select("doc_id", scalars.num_digits(F.col("doc_id") * F.col("n_chars")).cast("long").alias("digits")), "select doc_id, case when doc_id * n_chars = 0 then 0 else length((doc_id * n_chars)::varchar) end::bigint as digits from documents")
query("aligned_lengths", lambda t: t.docs.select("doc_id", scalars.rounded_down(F.col("n_chars"), 256).cast("long").alias("len")), "select doc_id, case when n_chars > 256 then n_chars - n_chars % 256 else n_chars end::bigint as len from documents")
query("first_device", lambda t: t.docs.select("doc_id", scalars.first_device(F.concat_ws(":", "source", "lang")).alias("device")), "select doc_id, string_split(source || ':' || lang, ':')[1] as device from documents")


def _unique(t: Tables) -> DataFrame:
    """Unique extents for the partial search: windows of four blocks whose digest stands once."""
    wide = corpus.blocks(t.docs, 4 * corpus.BLOCK).join(t.files.select("fileid", "size"), "fileid")
    ext = wide.select("fileid", "loff", F.least(F.lit(4 * corpus.BLOCK), F.col("size") - F.col("loff")).cast("long").alias("len"), F.lit(0).alias("poff"), "digest")
    return dupes.nondupe_extents(ext)


def _found(t: Tables) -> DataFrame:
    return partial.matches(partial.seeds(_unique(t), t.numbered), t.numbered, corpus.BLOCK)


_WIDE = "u as (select fileid, loff, len from (select *, count(*) over (partition by digest) as c from (select doc_id as fileid, (i * 1024)::bigint as loff, least(1024, n_chars - i * 1024)::bigint as len, md5(substring(text, (i * 1024 + 1)::bigint, 1024)) as digest from (select doc_id, text, n_chars, unnest(range((n_chars + 1023) // 1024)) as i from documents))) where c = 1)"
_SEEDS = f"{_sql('f b db nb', '')}, {_WIDE}, s as (select o.fileid as o_file, o.loff as o_loff, o.idx as o_idx, w.fileid as w_file, w.loff as w_loff, w.idx as w_idx, w.loff + u.len - 1 as ext_end from u join nb o on o.fileid = u.fileid and o.loff = u.loff join nb w on w.digest = o.digest where (w.fileid, w.loff) <> (o.fileid, o.loff))"
for _name, _where in (("partial_seeds", ""), ("partial_nosame", " where o_file <> w_file")):
    ORACLE[_name] = f"{_SEEDS} select o_file, o_loff, o_idx::int as o_idx, w_file, w_loff, w_idx::int as w_idx, ext_end from s{_where}"
_RUNS = f"""{_SEEDS},
    p as (select s.*, nw.idx - w_idx as k, no.loff as ol, no.digest as od, no.blen as ob, nw.loff as wl, nw.digest as wd, nw.blen as wb from s join nb nw on nw.fileid = w_file and nw.idx >= w_idx and nw.loff < ext_end join nb no on no.fileid = o_file and no.idx = o_idx + nw.idx - w_idx),
    g as (select *, od = wd as m, ol - lag(ol) over z = 256 and wl - lag(wl) over z = 256 as contig, lag(od = wd) over z as pm from p window z as (partition by o_file, o_loff, w_file, w_loff, ext_end order by k)),
    h as (select *, sum((coalesce(pm, false) and not coalesce(contig, true))::int) over z as stops from g window z as (partition by o_file, o_loff, w_file, w_loff, ext_end order by k)),
    i as (select *, sum((not m)::int) over (partition by o_file, o_loff, w_file, w_loff, ext_end order by k) as island from h where stops = 0),
    r as (select o_file, o_loff, o_idx, w_file, w_loff, w_idx, ext_end, island, max(k) as k1, min(ol) as o0, min(wl) as w0, max(ol) + max_by(ob, k) as oend, max(wl) + max_by(wb, k) - 1 as wend, md5(string_agg(od, ',' order by k)) as match_id from i where m group by all),
    q as (select *, coalesce(lag(k1) over (partition by o_file, o_loff, w_file, w_loff, ext_end order by island) + 1, 0) as ks from r where wend <= ext_end)"""
ORACLE["partial_matches"] = f"{_RUNS} select match_id, (oend - o0)::bigint as len, o_file, o0 as o_start, w_file, w0 as w_start from q"
ORACLE["partial_matches_literal"] = f"{_RUNS} select match_id, (oend - a.loff)::bigint as len, o_file, a.loff as o_start, w_file, c.loff as w_start from q join nb a on a.fileid = o_file and a.idx = o_idx + ks join nb c on c.fileid = w_file and c.idx = w_idx + ks"
_SIDES = "t as (select distinct (oend - o0)::bigint as len, match_id as digest, unnest([o_file, w_file]) as fileid, unnest([o0, w0]) as loff from q)"
ORACLE["partial_groups"] = f"{_RUNS}, {_SIDES} select len, digest, count(*) as n_members, count(distinct fileid) as n_files from t group by all having count(*) > 1"
ORACLE["all_extent_groups"] = f"{_RUNS}, {_SIDES}, {_CTE['e']}, {_CTE['de']} select len, digest, count(*) as n_members, count(distinct fileid) as n_files from (select len, digest, fileid, loff from t union select len, digest, fileid, loff from de) group by all having count(*) > 1"
