"""Line de-duplication by a deletion-neighbourhood join, in DataFrame expressions only.

A line goes if an earlier line, by (doc_id, line number), is equal, whatever its length; blank lines stay. A line of at least
`least` words (pieces between single spaces) also goes if an earlier such line is within one word insertion, deletion or
substitution; with five words or more that is a similarity of at least 0.8 (1 - 1/n on a line of n words). Being earlier
is judged on all lines, whether or not the earlier one itself goes.

Lines first collapse to distinct lines. A line can have a neighbour within one edit only if another line has its first
or its last half, so only lines with such a shared half emit variants: the line itself and the line without each of its
words, as hashed keys. Equal variants link:
 - the same variant with the same word position and length left out: a substitution;
 - a variant of one line that equals another whole line: an insertion or deletion.
A group of equal variants is reduced to its earliest line by partial aggregation, so no pairs within it are made, and
each link to an earliest line is verified on the words themselves. Of long halves the outer eight words are compared,
which lets through no less.

Null and empty texts have no lines to drop and come back as they are; repeated rows (same doc_id and text) are one
document, each row coming back alike; rows of a null doc_id come back as they are; an empty table gives an empty table; all input columns are kept as they are but
for text and, where present, n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samelode.llm.common import settled, small, stored

#: Most rows that are broadcast; beyond it, joins shuffle.
SMALL = 200_000
#: Most words of a half that are compared.
HALF = 8
LINE = ["h1", "place"]


def lines_of(docs: DataFrame) -> DataFrame:
    """(d, t, pos, place, line, n): the lines that are not blank, of n words. d and t identify a document, t being a hash of its text; place orders lines by doc_id and number."""
    n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    place = F.col("d").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    return (
        docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.col("line").rlike(r"[^\x09-\x0D\x20]"))
        .withColumn("n", n)
        .withColumn("place", place.cast("decimal(32,0)"))
    )


def _h1() -> Column:
    return F.xxhash64("line").alias("h1")


def facts_of(lines: DataFrame, least: int) -> DataFrame:
    """(h1, h2, place, d, t, pos, p1, s1, p2, s2): each line's hashes and, from `least` words on, the keys of its first and last halves; for even n also of those it shares with a line one word shorter."""
    upto = lambda n: F.call_function("substring_index", F.col("line"), F.lit(" "), n)
    a, b = (F.least(F.lit(HALF), F.floor(x / 2).cast("int")) for x in (F.col("n"), F.col("n") - 1))
    again = lambda key: F.when(a != b, key)
    key = lambda side, h: F.when(F.col("n") >= least, F.xxhash64(F.lit(side), h, upto(h if side == 0 else -h)))
    return lines.select(_h1(), F.xxhash64(F.lit(1), "line").alias("h2"), "place", "d", "t", "pos", key(0, a).alias("p1"), key(1, a).alias("s1"), again(key(0, b)).alias("p2"), again(key(1, b)).alias("s2"))


def distinct_lines(facts: DataFrame) -> DataFrame:
    """(h1, h2, place, c, p1, s1, p2, s2): each distinct line with its earliest place and its number of places."""
    return facts.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("c"), *[F.min(k).alias(k) for k in ("p1", "s1", "p2", "s2")])


def candidates(known: DataFrame) -> DataFrame:
    """(h1, place) of the distinct lines that share a half with another."""
    keys = known.select(*LINE, F.explode(F.array("p1", "s1", "p2", "s2")).alias("half")).filter("half is not null")
    shared = keys.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    return keys.join(small(stored(shared, "shared-halves")), "half", "left_semi").select(*LINE).distinct()


def variants(cands: DataFrame) -> DataFrame:
    """(key, m, j, first): of each line (d, t, pos, line), itself (j = -1) and its variants without word j, m words long.

    A sequence's key is the xor of the hashes of (word, place); running xors over a line give all its variants at once.
    """
    from pyspark.sql import Window

    words = cands.select(*LINE, F.posexplode(F.split("line", " ")).alias("j", "w")).select(*LINE, "j", F.xxhash64("w", "j").alias("g0"), F.xxhash64("w", F.col("j") - 1).alias("g1"))
    line = Window.partitionBy(*LINE)
    before = line.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    w = words.select(
        *LINE,
        "j",
        F.coalesce(F.bit_xor("g0").over(before), F.lit(0).cast("long")).alias("left"),
        F.bit_xor("g1").over(upto).alias("own"),
        F.bit_xor("g0").over(line).alias("all0"),
        F.bit_xor("g1").over(line).alias("all1"),
        F.count("*").over(line).alias("n"),
    )
    key = F.col("left").bitwiseXOR(F.col("all1").bitwiseXOR(F.col("own")))
    rows = F.array(F.struct(key.alias("key"), (F.col("n") - 1).cast("int").alias("m"), F.col("j").alias("j")), F.struct(F.col("all0").alias("key"), F.col("n").cast("int").alias("m"), F.lit(-1).alias("j")))
    return w.select(*LINE, F.explode(F.when(F.col("j") == 0, rows).otherwise(F.slice(rows, 1, 1))).alias("v")).select("v.*", *LINE)


def links(var: DataFrame) -> DataFrame:
    """(h1, place, witness): lines with the place of the earliest line of each kind of equal variant, where that is earlier."""
    whole, cut = F.when(F.col("j") < 0, F.col("place")), F.when(F.col("j") >= 0, F.col("place"))
    equal = var.groupBy("key", "m").agg(F.count("*").alias("c"), F.min(whole).alias("whole"), F.min(cut).alias("cut")).filter("c > 1").drop("c")
    members = stored(var.join(small(stored(equal, "equal")), ["key", "m"]), "members")
    spot = stored(members.groupBy("key", "m", "j").agg(F.min("place").alias("least")), "spots")
    against = F.when(F.col("j") >= 0, F.array("least", "whole")).otherwise(F.array("cut"))
    return members.join(small(spot), ["key", "m", "j"]).select(*LINE, F.explode(against).alias("witness")).filter(F.col("witness") < F.col("place")).distinct()


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one insertion, deletion or substitution."""
    differ = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), lambda z: z))
    cut = F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), False).cast("int")

    def one_more(long: Column, short: Column) -> Column:
        return F.slice(long, cut + 1, F.size(long)) == F.slice(short, cut, F.size(long))

    return F.when(F.size(a) == F.size(b), differ(a, b) <= 1).when(F.size(a) == F.size(b) + 1, one_more(a, b)).when(F.size(b) == F.size(a) + 1, one_more(b, a)).otherwise(F.lit(False))


def near_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(h1, place): the distinct lines that have an earlier line within one edit."""
    cands = stored(candidates(known), "candidates")
    texts = stored(lines.select(_h1(), "place", "line").join(small(cands), LINE, "left_semi").dropDuplicates(LINE), "candidate-lines")
    found = stored(links(stored(variants(texts), "variants")), "links")
    one = texts.select(*LINE, F.split("line", " ").alias("a")).join(small(found), LINE)
    two = texts.select(F.col("place").alias("witness"), F.split("line", " ").alias("b"))
    return one.join(two, "witness").filter(within_one(F.col("a"), F.col("b"))).select(*LINE).distinct()


def removed(docs: DataFrame, least: int = 5) -> DataFrame:
    """(d, t, gone): the numbers of the lines that go, for each document that loses any."""
    lines = lines_of(docs)
    facts = stored(facts_of(lines, least), "facts")
    known = stored(distinct_lines(facts), "lines")
    near = stored(near_lines(lines, known), "near").withColumn("near", F.lit(True))
    # only lines with several places or an earlier neighbour can go
    bad = stored(known.join(small(near), LINE, "left").filter("c > 1 or near").select("h1", "h2", F.col("place").alias("first"), "near"), "repeated")
    dup = facts.select("h1", "h2", "place", "d", "t", "pos").join(small(bad), ["h1", "h2"]).filter(F.col("near") | (F.col("place") != F.col("first")))
    return dup.groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup(docs: DataFrame, least: int = 5) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines, n_removed and kept in front: (n_lines, n_removed, doc)."""
    gone = settled(lambda: removed(docs, least), "gone", docs.sparkSession).withColumnsRenamed({"d": "gd", "t": "gt"})
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= 5 * SMALL
    text = F.col("text")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), text)
    joined = row.join(F.broadcast(gone) if few else gone, (F.col("d") == F.col("gd")) & (F.col("t") == F.col("gt")), "left").select("doc", "text", "gone")
    # explode works the lines out once for each row
    split = joined.select("doc", "text", "gone", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines"))
    # runs of kept lines between those that go
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.struct(F.get(edges, i).alias("a"), F.get(edges, i + 1).alias("b")))
    kept = F.flatten(F.transform(runs, lambda r: F.slice(F.col("lines"), r["a"] + 2, r["b"] - r["a"] - 1)))
    n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("lines"))
    return split.select(
        "doc",
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def cleaned(docs: DataFrame, least: int = 5) -> DataFrame:
    """docs with the same columns: repeated lines out of text, n_chars (where present) after it, and documents gone that lost every word."""
    out = dedup(docs, least)
    lost = (F.col("n_removed") > 0) & (F.trim("kept") == "")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.filter(~F.coalesce(lost, F.lit(False))).select(*[(F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("doc")[c]) if c in new else F.col("doc")[c]).alias(c) for c in docs.columns])
