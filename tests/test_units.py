"""Small cases with known results, and random ones against slow simulations."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from samelode.functions import scalars
from samelode.operators import dupes, partial, ranges, requests, state
from samelode.sources import corpus
from samelode.streaming import batches


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_zero_blocks(spark):
    mixed = bytearray(100)
    mixed[50] = 1
    for data, want in ((bytes(100), True), (b"\1" * 100, False), (None, False), (bytes(mixed), False), (b"", False)):
        df = spark.createDataFrame([(data,)], "d binary")
        assert df.select(scalars.is_zero(F.col("d")).alias("x")).first()["x"] is want


def test_block_len(spark):
    bs = 100
    big = 10 * 1024 * 1024
    for size, loff, want in ((big, 0, bs), (big, 100, bs), (big, 10 * bs, bs), (10 * bs, 9 * bs, bs), (10 * bs + 10, 10 * bs, 10), (10 * bs + 10, 15 * bs, 0)):
        assert one(spark, partial.block_len(F.lit(size), F.lit(loff), bs)) == want


def test_renamed(spark):
    cols = "filename string, ino long, subvol string, size long, mtime long"
    old = spark.createDataFrame([("/a", 1, "s", 5, 1), ("/b", 2, "s", 5, 1), ("/c", 3, "s", 5, 1)], cols)
    now = spark.createDataFrame([("/a", 1, "s", 5, 1), ("/new", 2, "s", 5, 1), ("/link", 3, "s", 5, 1), ("/c", 9, "s", 5, 1)], cols)
    got = {r["filename"]: r["status"] for r in state.changes(now, old).collect()}
    assert got == {"/a": "same", "/new": "renamed", "/link": "same", "/c": "new"}


def test_sizes(spark):
    for text, want in (("128K", 131072), ("7", 7), ("1m", 1 << 20), ("2E", 2 << 60), ("12x", None), ("", None), ("K", None)):
        assert one(spark, scalars.parse_size(F.lit(text))) == want
    for n, want in ((0, "0"), (1023, "1023"), (1024, "1.0KB"), (1536, "1.5KB"), (1 << 20, "1.0MB"), (1 << 50, "1.0PB")):
        assert one(spark, scalars.pretty_size(F.lit(n))) == want
    assert one(spark, scalars.rounded_down(F.lit(5000), 4096)) == 4096 and one(spark, scalars.first_device(F.lit("a:b"))) == "a"


def test_closed_groups(spark):
    lines = ["a", "b", "", "", "c", "", "open"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    assert sorted((r["grp"], r["path"]) for r in corpus.closed_groups(df).collect()) == [(1, "a"), (1, "b"), (3, "c")]


def test_first_batch_is_one_short(spark):
    df = spark.range(10).withColumnRenamed("id", "fileid")
    n = defaultdict(int)
    for r in corpus.assign_batches(df, batch=4).collect():
        n[r["dedupe_seq"]] += 1
    assert dict(n) == {1: 3, 2: 4, 3: 3}
    assert {r["dedupe_seq"] for r in corpus.assign_batches(df, batch=0).collect()} == {1}


def test_clean_deduped_like_a_loop(spark):
    r, rows = random.Random(4), []
    for g in range(200):
        for i in range(r.randrange(1, 7)):
            rows.append((10, f"g{g}", i, 0, r.choice([0, 5, 6, 7])))
    got = {(x["digest"], x["fileid"]) for x in dupes.clean_deduped(spark.createDataFrame(rows, "len long, digest string, fileid long, loff long, poff long")).collect()}
    want, by = set(), defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    for g, members in by.items():
        left, seen = [], set()
        for m in members:
            if m[4] == 0 or m[4] not in seen:
                left.append(m)
            seen.add(m[4])
        if len(left) > 1:
            want |= {(g, m[2]) for m in left}
    assert got == want


def test_real_files(spark, tmp_path):
    for name, data in (("a", b"x" * 300), ("b", b"x" * 300), ("c", b"y" * 130), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    files = corpus.real_files(spark, [str(tmp_path)])
    assert files.count() == 3
    assert files.groupBy("digest", "size").count().filter("count > 1").count() == 1
    assert corpus.content_blocks(files, 100).count() == 8


def test_stream(spark, tmp_path):
    cols = "fileid long, filename string, size long, digest string, flags int"
    src = tmp_path / "in"
    for i, rows in enumerate(([(1, "/a", 9, "x", 0), (2, "/b", 9, "y", 0)], [(3, "/c", 9, "x", 0)])):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(cols).parquet(str(src))
        batches.start(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out") + f"/batch={i + 1}")
        assert sorted(r["fileid"] for r in got.collect()) == ([] if i == 0 else [1, 3])


def test_empty_tables(spark):
    files = spark.createDataFrame([], "fileid long, filename string, size long, digest string, flags int, dedupe_seq int")
    assert dupes.duplicate_files(files).count() == 0 and dupes.duplicate_files(files, 1).count() == 0


def test_numbers_do_not_hang_on_the_columns_read(spark):
    """Many rows in few partitions: sampled bounds would differ between the scans of a plan."""
    df = spark.range(0, 300_000, 1, 3).select((F.col("id") * 7 % 300_007).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    got = corpus.numbered(df, "k").select("rn", "wide", "k")
    assert got.agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.max("rn").alias("m")).first() == (300_000, 300_000, 300_000)
    ranked = got.orderBy("k").select("rn").toPandas()["rn"].tolist()
    assert ranked == list(range(1, 300_001))


def test_numbers_in_hot_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 100).cast("string"))).alias("digest"), F.lit(8).cast("long").alias("len"), F.col("id").alias("fileid"), F.lit(0).cast("long").alias("loff"))
    by = defaultdict(list)
    for r in requests.plan(rows).collect():
        by[r["digest"]].append((r["fileid"], r["rn"], r["role"]))
    for members in by.values():
        members.sort()
        assert [m[1] for m in members] == list(range(1, len(members) + 1))
        assert [m[2] for m in members] == ["target"] + ["dest"] * (len(members) - 1)
    n_dest = {(r["digest"], r["request"]): r["n_dest"] for r in requests.requests(rows).collect()}
    assert n_dest["hot", 0] == 119 and sum(v for (d, _), v in n_dest.items() if d == "hot") == 1666


def test_numbers_with_nulls_ties_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4), (1, 5)], "k long, x int")
    got = sorted((r["rn"], r["k"]) for r in corpus.numbered(df, "k").collect())
    assert got == [(1, None), (2, None), (3, 1), (4, 5), (5, 5)]
    assert corpus.numbered(df.filter("x > 9"), "k").count() == 0


def test_ranges_like_brute_force(spark):
    r = random.Random(9)
    ext, pts = [], []
    for f in range(6):
        at = 0
        for _ in range(r.randrange(0, 30)):
            at += r.choice([0, 0, 3, 50])
            n = r.choice([1, 1, 2, 7, 64, 100, 1000])
            ext.append((f, at, n, r.random() < 0.6, r.random() < 0.3))
            at += n
        pts += [(f, x) for x in {r.randrange(0, 3000) for _ in range(15)}]
    e = spark.createDataFrame(ext, "fileid long, loff long, len long, shared boolean, delalloc boolean")
    p = spark.createDataFrame(pts, "fileid long, x long")
    assert sorted(map(tuple, ranges.extent_at(p, e).collect())) == sorted((f, x, a, n) for f, x in pts for g, a, n, _, _ in ext if f == g and a <= x < a + n)
    want = sorted((f, x, min(a for g, a, n, _, _ in ext if f == g and a + n - 1 >= x)) for f, x in pts if any(f == g and a + n - 1 >= x for g, a, n, _, _ in ext))
    assert sorted(map(tuple, ranges.extent_asof(p, e).collect())) == want
    w = p.select("fileid", F.col("x").alias("lo"), (F.col("x") + (F.col("x") % 200)).alias("hi"))
    want = sorted((f, x, x + x % 200, sum(max(0, min(a + n, x + x % 200) - max(a, x)) for g, a, n, s, d in ext if f == g and s and not d)) for f, x in pts)
    assert sorted(map(tuple, ranges.shared_bytes(w.union(w), e).collect())) == want
    parts = w.select("fileid", F.col("lo").alias("loff"), (F.col("hi") - F.col("lo")).alias("len"))
    want = sorted((f, x, x % 200) for f, x in pts if not any(f == g and s and a < x + x % 200 and a + n > x and x % 200 for g, a, n, s, _ in ext))
    assert sorted(map(tuple, ranges.outside_ignored(parts, e.withColumnRenamed("shared", "ignored")).collect())) == want


def test_options():
    known = {"same": True, "partial": False, "only_whole_files": False}
    assert scalars.parse_options("nosame,partial", known) == {"same": False, "partial": True, "only_whole_files": False}
    assert scalars.parse_options("", known) == known
    try:
        scalars.parse_options("fast", known)
        raise AssertionError
    except ValueError:
        pass


def test_flags_and_digits(spark):
    for v, want in ((0, 0), (7, 1), (1000, 4)):
        assert one(spark, scalars.num_digits(F.lit(v))) == want
    for v, want in ((None, False), (0x200, True), (0x800, True), (0x400, False)):
        assert one(spark, scalars.ignored(F.lit(v).cast("int"), 0xA00)) is want


def test_every_batch_reports_all_batches(spark):
    rows = [("a", 1, n) for n in (1, 5, 5, 9)] + [("b", 1, 7), ("c", 1, 2), ("c", 2, 6), (None, 1, 1), (None, 1, 6)]
    df = spark.createDataFrame(rows, "digest string, size long, dedupe_seq int")
    got = batches.every_batch(df, ["digest", "size"]).collect()
    assert sorted((r["batch"], r["digest"], r["size"], r["n_members"]) for r in got) == [(5, "a", 1, 3), (9, "a", 1, 4)]


def test_zero_blocks_are_found_anywhere(spark):
    from samelode.plans import queries

    text = "a" * 64 + "\0" * 64 + "b" * 64 + "\0" * 10
    df = spark.createDataFrame([(1, text, len(text)), (2, "\0" * 64 + "c", 65)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, queries._nonzero(df, 64).collect())) == [(1, 0), (1, 128), (2, 64)]


def counted(spark, df, column):
    """df, and a count of the rows in which its column was worked out."""
    seen = spark.sparkContext.accumulator(0)

    def same(v):
        seen.add(1)
        return v

    return df.withColumn(column, F.udf(same, "long").asNondeterministic()(column)), seen


def test_as_of_works_its_extents_out_once(spark):
    ext, seen = counted(spark, spark.range(3000).select((F.col("id") % 700).alias("fileid"), (F.col("id") * 8).alias("loff"), F.lit(8).cast("long").alias("len")), "loff")
    pts = spark.createDataFrame([(5, 100), (6, 10**6), (7, None), (None, 1), (8, 0)], "fileid long, x long")
    got = sorted(map(tuple, ranges.extent_asof(pts, ext).collect()))
    assert got == [(5, 100, 8 * 705), (8, 0, 64)]
    assert seen.value == 3000


def test_sides_of_matches_and_lone_extents(spark):
    found, seen = counted(spark, spark.range(500).select(F.lit("m").alias("match_id"), F.lit(256).cast("long").alias("len"), F.col("id").alias("o_file"), F.lit(0).cast("long").alias("o_start"), (F.col("id") + 1).alias("w_file"), F.lit(0).cast("long").alias("w_start")), "o_file")
    assert partial.members(found).count() == 501 and seen.value == 500
    ext, seen = counted(spark, spark.range(500).select("id", (F.col("id") * 256).alias("loff"), F.lit(256).cast("long").alias("len"), F.lit(0).cast("long").alias("poff"), F.expr("case when id < 400 then md5(cast(id div 2 as string)) when id < 499 then md5(cast(id as string)) end").alias("digest")).withColumnRenamed("id", "fileid"), "fileid")
    assert sorted(r["fileid"] for r in dupes.nondupe_extents(ext).collect()) == list(range(400, 499)) and seen.value == 500


def test_blocks_are_numbered_in_one_pass(spark):
    dups, seen = counted(spark, spark.range(2000).select((F.col("id") % 7).alias("fileid"), (F.col("id") * 256).alias("loff"), F.md5(F.col("id").cast("string")).alias("digest")), "loff")
    files = spark.range(7).select(F.col("id").alias("fileid"), F.lit(512000).cast("long").alias("size"))
    got = partial.numbered_blocks(dups, files, 256).collect()
    assert sorted((r["fileid"], r["idx"], r["loff"]) for r in got) == sorted((i % 7, i // 7 + 1, i * 256) for i in range(2000))
    assert seen.value == 2000


def test_members_of_a_report_are_worked_out_once(spark):
    members, seen = counted(spark, spark.range(1500).select(F.lit("files").alias("kind"), F.expr("case when id % 5 > 0 then id % 5 end").alias("len"), F.md5((F.col("id") % 5).cast("string")).alias("digest"), F.col("id").alias("fileid"), F.lit(0).cast("long").alias("loff")), "fileid")
    files = spark.range(1500).select(F.col("id").alias("fileid"), F.col("id").cast("string").alias("filename"))
    got = dupes.ordered_report(members, files).collect()
    want = sorted(range(1500), key=lambda i: (i % 5, i))  # members of unknown length come first
    assert [(r["line"], int(r["filename"]), r["n_members"]) for r in sorted(got, key=lambda r: r["line"])] == [(k + 1, i, 300) for k, i in enumerate(want)]
    assert seen.value == 1500
