"""State, sources, patterns, streams and the command line, on small cases with known results."""

import fnmatch
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from samelode import cli
from samelode.functions import scalars
from samelode.operators import dupes, partial, ranges, requests, state
from samelode.sources import corpus, mounts
from samelode.sources.store import SCHEMAS, Store
from samelode.streaming import batches


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sizes_that_do_not_fit(spark):
    df = spark.createDataFrame([("16E",), ("7E",), ("99999999999999999999",), ("8E",), ("9223372036854775807",)], "t string")
    assert [r["x"] for r in df.select(scalars.parse_size(F.col("t")).alias("x")).collect()] == [None, 7 << 60, None, None, (1 << 63) - 1]
    big = spark.createDataFrame([((1 << 53) + 1023,), (9007199254740993 * 512,)], "n long")
    assert [r["x"] for r in big.select(scalars.pretty_size(F.col("n")).alias("x")).collect()] == ["8.0PB", "4.0EB"]


def test_patterns(spark):
    cases = [("[[]", "[", "a"), (r"\*", "*", "a"), ("[a&&b]", "&", "c"), ("a[]x]", "a]", "aa"), ("[!a-c]x", "dx", "ax"), ("[[:digit:]-]z", "-z", "az"), ("[ab", "[ab", "a"), ("a^b", "a^b", "ab"), (r"x[\]]y", "x]y", "xy"), ("*.o", "a/b.o", "b.c"), ("?", "é", "éé"), ("[^x]", "y", "x"), (r"a\\b", r"a\b", "ab")]
    for glob, yes, no in cases:
        df = spark.createDataFrame([(yes,), (no,)], "p string").select(F.col("p").rlike(scalars.glob_pattern(glob)).alias("x"))
        assert [r["x"] for r in df.collect()] == [True, False], glob


def test_patterns_like_fnmatch():
    r = random.Random(3)
    for _ in range(3000):
        glob = "".join(r.choice("ab*?[]!-/.") for _ in range(r.randrange(1, 7)))
        text = "".join(r.choice("ab-/.!]") for _ in range(r.randrange(0, 5)))
        if re.search(r"\[[!]?\]|(.)-(?!\])", glob):  # empty and reversed ranges differ between libraries
            continue
        assert bool(re.match(scalars.glob_pattern(glob), text)) == fnmatch.fnmatchcase(text, glob), (glob, text)


def test_state_files_are_left_out(spark):
    names = ["/d/h.db", "/d/h.db-wal", "/d/h.db-shm", "/d/h.dbx", "/d/hxdb", "/d/rel/x"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r["p"] for r in df.filter(~scalars.excluded(F.col("p"), ["rel/*"], "/d", "/d/h.db")).collect()] == ["/d/h.dbx", "/d/hxdb"]


def test_long_texts_are_cut_in_one_pass(spark):
    text = ("é" + "x" * 254 + "\n") * 32768  # 8 Mi characters
    df = spark.createDataFrame([(1, text, len(text)), (2, "", 0), (3, None, None), (4, "a\n\nb", 4)], "doc_id long, text string, n_chars long")
    began = time.time()
    assert corpus.blocks(df).groupBy("fileid").agg(F.count("*").alias("n"), F.max("loff").alias("m")).orderBy("fileid").collect() == [(1, 32768, 32767 * 256), (4, 1, 0)]
    got = corpus.line_offsets(df).filter("line <> ''").groupBy("fileid").agg(F.count("*").alias("n"), F.max("loff").alias("m")).orderBy("fileid").collect()
    assert got == [(1, 32768, 32767 * 256), (4, 2, 3)]
    assert time.time() - began < 60


def test_line_offsets_random(spark):
    r = random.Random(6)
    texts = ["\n".join("x" * r.randrange(0, 5) for _ in range(n)) for n in (1, 2, 511, 512, 513, 1500)]
    got = corpus.line_offsets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = []
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            want.append((i, at, line))
            at += len(line) + 1
    assert rows(got, "fileid", "loff", "line") == sorted(want)


def test_wide_ranges(spark):
    e = spark.createDataFrame([(1, 5, 10, True, False), (1, 1 << 39, 1 << 38, True, False), (1, 100, 1, False, False), (2, 0, 1 << 50, True, False)], "fileid long, loff long, len long, shared boolean, delalloc boolean")
    w = spark.createDataFrame([(1, 0, 1 << 40), (1, 7, 9), (1, 0, 5), (2, 1 << 20, (1 << 20) + 3), (3, 0, 1 << 62)], "fileid long, lo long, hi long")
    assert rows(ranges.shared_bytes(w, e), "fileid", "lo", "shared") == [(1, 0, 0), (1, 0, 10 + (1 << 38)), (1, 7, 2), (2, 1 << 20, 3), (3, 0, 0)]


def test_as_of_in_one_large_file(spark):
    r = random.Random(2)
    ext = [(1, i * 10, r.randrange(1, 9)) for i in range(4000)]
    pts = [(1, x) for x in range(0, 40_100, 37)]
    got = ranges.extent_asof(spark.createDataFrame(pts, "fileid long, x long"), spark.createDataFrame(ext, "fileid long, loff long, len long"))
    want = [(1, x, min(a for _, a, n in ext if a + n - 1 >= x)) for _, x in pts if any(a + n - 1 >= x for _, a, n in ext)]
    assert rows(got, "fileid", "x", "loff") == want


FILE = "fileid long, filename string, ino long, subvol string, size long, mtime long, dedupe_seq int, digest string, flags int"


def test_renames_leave_names_unique(spark):
    f = spark.createDataFrame([(i, f"/{c}", i, "s", 1, 1, 1, "x", 0) for i, c in enumerate("abcde", 1)], FILE)
    names = spark.createDataFrame([(1, "/c"), (2, "/c"), (4, "/e"), (5, "/f")], "fileid long, new_name string")
    out = state.rename(f, names)
    assert out.columns == f.columns and rows(out, "fileid", "filename") == [(2, "/c"), (4, "/e"), (5, "/f")]


def test_upserted_state_can_be_searched(spark):
    old = spark.createDataFrame([(1, "/a", 1, "s", 5, 1, 1, "x", 0), (2, "/b", 2, "s", 5, 1, 1, "y", 0)], FILE)
    new = spark.createDataFrame([("/b", 2, "s", 5, 9), ("/c", 3, "s", 5, 9)], "filename string, ino long, subvol string, size long, mtime long")
    assert rows(state.replaced(old, new), "fileid") == [(2,)]
    up = state.upsert_files(old, new, 2)
    marked = state.mark_scanned(up, up.filter("digest is null").select("fileid", F.lit("x").alias("digest"), F.lit(0).alias("flags")))
    assert rows(dupes.duplicate_files(marked, 2), "filename") == [("/a",), ("/b",), ("/c",)]


def test_blocks_are_put_in_the_place_of_old_ones(spark):
    cols = "fileid long, loff long, digest string"
    old, new = spark.createDataFrame([(1, 0, "a"), (1, 9, "b")], cols), spark.createDataFrame([(1, 9, "c"), (2, 0, "d"), (2, 9, None)], cols)
    assert rows(state.insert_blocks(old, new), "fileid", "loff", "digest") == [(1, 0, "a"), (1, 9, "c"), (2, 0, "d")]


def test_store_commits_all_or_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    s = Store(spark, at)
    assert s.version() == 1 and s.config()["dedupe_sequence"] == "0" and s.read("files").count() == 0
    f = spark.createDataFrame([(1, "/a", 1, "s", 1, 1, 1, "x", 0)], FILE)
    s.commit({"files": f})
    assert Store(spark, at).read("files").count() == 1 and s.version() == 2
    bad = f.withColumn("size", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        s.commit({"blocks": spark.createDataFrame([(1, 0, "b")], SCHEMAS["blocks"]), "files": bad})
    assert s.version() == 2 and s.read("blocks").count() == 0
    s.clean()
    assert len(os.listdir(tmp_path / "state")) - sum(n.startswith(".") for n in os.listdir(tmp_path / "state")) == 5
    assert s.read("files").count() == 1
    # made with another digest: made anew, empty
    assert Store(spark, at, {"hash_type": "other", "version_major": "4"}).read("files").count() == 0


def test_scans_of_real_folders(spark, tmp_path):
    d = tmp_path / "d"
    (d / "sub").mkdir(parents=True)
    for name, data in (("a", b"x" * 9000), ("b", b"x" * 9000), ("c.skip", b"x" * 9000), ("sub/d", b"y" * 4096 + b"x" * 4096), ("empty", b"")):
        (d / name).write_bytes(data)
    s = Store(spark, f"file://{tmp_path}/state")
    assert cli.scan(spark, s, [str(d)], False, (f"{d}/*.skip",), 4096) == 1
    assert s.read("files").count() == 2 and s.read("blocks").count() == 6
    lines = cli.report(s).collect()
    assert [(r["kind"], r["n_members"], r["len"], r["start"]) for r in lines if r["kind"] == "files"] == [("files", 2, 9000, 0)] * 2
    assert [(r["n_members"], r["len"], r["start"]) for r in lines if r["kind"] == "blocks"] == [(2, 808, 8192)] * 2 + [(4, 4096, 0), (4, 4096, 4096)] * 2
    assert [r["line"] for r in lines if r["kind"] == "blocks"] == list(range(1, 7))
    # a changed file, a new one in a folder below
    (d / "b").write_bytes(b"z" * 5000)
    assert cli.scan(spark, s, [str(d)], True, (f"{d}/*.skip",)) == 2
    assert s.read("files").count() == 3 and s.read("files").filter("dedupe_seq = 2").count() == 2
    assert {r["kind"] for r in cli.report(s, 2).collect()} == {"blocks"}
    head, places = cli.stats(s)
    assert head.first()["num_files"] == 3 and head.first()["block_size"] == 4096
    assert rows(places.filter("n = 3"), "loff", "lblock") == [(0, 0), (4096, 1), (4096, 1)]
    cli.remove(s, [r["filename"] for r in s.read("files").filter("filename like '%/a'").collect()])
    assert s.read("files").count() == 2 and s.read("blocks").filter("digest is not null").count() == 4


def test_path_lists(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    (tmp_path / "list").write_text(f"{tmp_path}/x\n\n{tmp_path}/y\n")
    lines = corpus.listed_paths(spark, str(tmp_path / "list"))
    assert rows(lines, "ord", "line") == [(0, f"{tmp_path}/x"), (1, ""), (2, f"{tmp_path}/y")]
    assert rows(corpus.closed_groups(lines), "grp", "path") == [(1, f"{tmp_path}/x")]
    (tmp_path / "list2").write_text(f"{tmp_path}/x")
    assert corpus.listed_files(spark, str(tmp_path / "list2")).count() == 1


def test_stream_replaces_changed_files(spark, tmp_path):
    cols = "fileid long, filename string, ino long, subvol string, size long, digest string, flags int"
    src = tmp_path / "in"
    steps = ([(1, "/a", 1, "s", 9, "x", 0), (2, "/b", 2, "s", 9, "x", 0)], [(3, "/b", 2, "s", 9, "y", 0), (4, "/d", 4, "s", 9, "x", 0)], [(5, "/e", 4, "s", 9, "y", 0)])
    want = [[1, 2], [1, 4], [3, 5]]
    for i, step in enumerate(steps):
        spark.createDataFrame(step, cols).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(cols).parquet(str(src))
        batches.start(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert sorted(r["fileid"] for r in spark.read.parquet(str(tmp_path / "out") + f"/batch={i + 1}").collect()) == want[i]


def test_stream_of_extents(spark, tmp_path):
    cols = "fileid long, loff long, len long, poff long, digest string"
    src = tmp_path / "in"
    for i, step in enumerate(([(1, 0, 9, 0, "x"), (1, 9, 9, 0, "y")], [(2, 0, 9, 0, "x"), (2, 9, 8, 0, "y")])):
        spark.createDataFrame(step, cols).coalesce(1).write.mode("append").parquet(str(src))
        batches.start_parts(spark.readStream.schema(cols).parquet(str(src)), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out") + f"/batch={i + 1}")
        assert rows(got, "fileid", "loff") == ([] if i == 0 else [(1, 0), (2, 0)])


def test_top_hashes_all_and_none(spark):
    b = spark.createDataFrame([(i % 3, i, "ab"[i % 2]) for i in range(10)], "fileid long, loff long, digest string")
    f = spark.createDataFrame([(i, f"/{i}") for i in range(3)], "fileid long, filename string")
    assert [dupes.top_hashes(b, f, n).count() for n in (None, 0, 1, 10)] == [2, 0, 1, 2]


def test_refused_lengths_are_asked_for_again(spark):
    planned = spark.createDataFrame([(100, "d", 1, 1, 0), (100, "d", 2, 2, 0), (100, "d", 3, 3, 0), (50, "e", 1, 1, 0), (50, "e", 2, 2, 0)], "len long, digest string, rn long, fileid long, loff long")
    sizes = spark.createDataFrame([(1, 500), (2, 500), (3, 100)], "fileid long, size long")
    assert rows(requests.attempts(planned, sizes, 64), "digest", "fileid", "attempt", "status", "bytes") == [("d", 2, 1, -22, 0), ("d", 2, 2, 0, 64), ("d", 3, 1, 0, 100), ("e", 2, 1, -22, 0), ("e", 2, 2, -22, 0)]


def test_roots(spark):
    p = spark.createDataFrame([("/a/b/c",), ("/ab",), ("/a",), ("/",)], "filename string")
    r = spark.createDataFrame([("/", 1), ("/a", 2), ("/a/b/", 3)], "root string, subvol long")
    assert rows(mounts.nearest_root(p, r), "filename", "subvol") == [("/", 1), ("/a", 2), ("/a/b/c", 3), ("/ab", 1)]
    assert mounts.nearest_root(p, r.filter("root = '/a'")).filter("subvol is null").count() == 2


def test_ordinals_in_one_large_file(spark):
    dups = spark.range(3000).select(F.lit("x").alias("digest"), F.lit(1).cast("long").alias("fileid"), (F.col("id") * 256).alias("loff"))
    got = partial.numbered_blocks(dups, spark.createDataFrame([(1, 3000 * 256)], "fileid long, size long"), 256)
    assert rows(got, "idx", "loff") == [(i + 1, i * 256) for i in range(3000)]
