"""Benchmark decontamination over a distributed positional inverted index, in DataFrame expressions only.

The index holds (term, doc_id, pos) for every word of the corpus and knows nothing of any benchmark: index() stores it once,
and any number of benchmarks are then held against it without reading the corpus for terms again. It is cut by document, as each
task sorts the postings of its own texts by term, so building it shuffles nothing, and a reader skips the parts of each
file whose range of terms holds none of those asked for.

For every window of `size` words of an item the two rarest terms, by counts over the whole index, are its probes: their
posting lists, adjusted by their offsets in the item, are intersected, rarest first, which leaves alignments (doc_id,
item, shift). Alignments within `slop` words are proximity matches; exact ones are then held against the whole item.
Positions are met by equality on bins of slop + 1, so no posting is paired with a whole list.

Null and empty texts have no words: such documents are clean and such items match nothing. Repeated items and rows count
once and repeated documents each get their row; with an empty benchmark every document is clean; extra columns are
ignored. Rows that share a doc_id are searched together but each is judged on its own text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samelode.llm.common import id_text, settled, small, stored

#: Separators before lower-casing: A-Z stay inside words and are lowered word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(word: Column) -> Column:
    """A-Z to a-z and nothing else; the slow way is left to words that hold both kinds of capitals."""
    low = F.lower(word)
    return F.when(low == word, word).when(F.octet_length(word) == F.length(word), low).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def pieces(text: Column) -> Column:
    """Words of a text as written; the first and last may be empty."""
    return F.split(text, SEPARATORS, -1)


def terms(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): every word of every text; positions count the pieces."""
    return docs.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("pos", "word")).filter("word <> ''").select("doc_id", "pos", ascii_lower(F.col("word")).alias("term"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, words) of each item that has words."""
    words = F.filter(F.transform(pieces(F.coalesce("text", F.lit(""))), ascii_lower), lambda w: w != "")
    return benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0).distinct()


def index(docs: DataFrame) -> DataFrame:
    """The stored postings (term, doc_id, pos) of every word of docs (doc_id, text), each task's sorted by term."""
    return stored(terms(docs).select("term", "doc_id", "pos").sortWithinPartitions("term"), "postings")


def counts(postings: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n): occurrences in the whole corpus of the items' terms. Counts are summed before the shuffle."""
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    return postings.select("term").join(small(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def probes(items: DataFrame, freq: DataFrame, size: int) -> DataFrame:
    """(item, q1, t1, q2, t2): offsets and terms of the two rarest words of each window that can occur, without repeats; q2 and t2 are null for a window of one word."""
    rated = (
        items.select("item", "words", F.posexplode("words").alias("q", "term"))
        .join(small(freq), "term", "left")
        .groupBy("item", "words")
        .agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("rated"))
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("rated") - size, F.lit(0)))
    window = rated.select("item", "rated", F.explode(starts).alias("s")).select("item", F.slice("rated", F.col("s") + 1, F.lit(size)).alias("w"))
    ranked = window.select("item", F.array_sort(F.transform("w", lambda x: F.struct(x["n"].alias("n"), x["q"].alias("q"), x["term"].alias("term")))).alias("w")).filter(F.col("w")[0]["n"] > 0)
    first, second = F.col("w")[0], F.get("w", F.lit(1))
    return ranked.select("item", first["q"].alias("q1"), first["term"].alias("t1"), second["q"].alias("q2"), second["term"].alias("t2")).distinct()


def lists_of(postings: DataFrame, plan: DataFrame) -> DataFrame:
    """The posting lists of the probe terms."""
    wanted = plan.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term is not null").distinct()
    return postings.join(small(wanted), "term", "left_semi")


def intersect(lists: DataFrame, plan: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item, shift, exact): alignments whose probes stand within slop words of their distance in the item, and whether some probes stand at just that distance."""
    one = lists.join(small(plan), F.col("term") == F.col("t1")).select("doc_id", "item", (F.col("pos") - F.col("q1")).alias("shift"), "t2", "q2")
    width = slop + 1
    # the second probe's place less its offset is the shift, give or take the slop: equal bins or neighbouring ones
    at = F.col("p") - F.col("q")
    asked = plan.filter("t2 is not null").select(F.col("item").alias("i"), F.col("t2").alias("t"), F.col("q2").alias("q")).distinct()
    other = lists.select(F.col("term"), F.col("doc_id").alias("d"), F.col("pos").alias("p")).join(small(asked), F.col("term") == F.col("t")).drop("term")
    other = other.select("i", "t", "q", "d", at.alias("s")).withColumn("bin", F.floor(F.col("s") / width))
    bins = F.floor(F.col("shift") / width)
    first = one.filter("t2 is not null").withColumn("b", F.explode(F.array(bins - 1, bins, bins + 1) if slop else F.array(bins)))
    here = (F.col("t") == F.col("t2")) & (F.col("i") == F.col("item")) & (F.col("q") == F.col("q2")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("bin") == F.col("b")) & (F.abs(F.col("s") - F.col("shift")) <= slop)
    two = first.join(other, here).select("doc_id", "item", "shift", (F.col("s") == F.col("shift")).alias("exact"))
    found = one.filter("t2 is null").select("doc_id", "item", "shift", F.lit(True).alias("exact")).unionByName(two)
    return found.groupBy("doc_id", "item", "shift").agg(F.max("exact").alias("exact"))


def found_in(postings: DataFrame, items: DataFrame, size: int, slop: int) -> DataFrame:
    """Alignments (doc_id, item, shift, exact) of items (item, words) in an index."""
    plan = stored(probes(items, stored(counts(postings, items), "counts"), size), "probes")
    return intersect(stored(lists_of(postings, plan), "lists"), plan, slop)


def proximity(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 5) -> DataFrame:
    """(doc_id, item, shift) where the two rarest words of a window stand within `slop` words of their distance in the item."""
    return found_in(index(id_text(docs)), items_of(benchmark), size, slop).select("doc_id", "item", "shift")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 5, postings: DataFrame | None = None) -> DataFrame:
    """Each document (doc_id, text) with n_words, n_near (items with a proximity match) and found: an array of (item, hits), hits being
    the positions of the pieces inside occurring windows. postings: an index of the same documents, if there is one."""
    docs, items = id_text(docs), stored(items_of(benchmark), "items")
    aligned = settled(lambda: found_in(index(docs) if postings is None else postings, items, size, slop), "alignments", docs.sparkSession)
    # an item's words are gathered once for a document, however many alignments it has there
    by_item = aligned.groupBy("doc_id", "item").agg(F.collect_list(F.when(F.col("exact"), F.col("shift"))).alias("shifts"))
    by_doc = by_item.join(small(items), "item").groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("item", "shifts", "words")).alias("cands"))
    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "cands")
    # explode makes the words once for each row; a plain column would be worked out anew at every use
    rows = joined.select("doc_id", "text", "cands", F.explode(F.array(pieces(F.col("text")))).alias("p"))

    def at_shift(c: Column, shift: Column) -> Column:
        same = F.array_join(F.transform(c["words"], lambda w, i: F.when(ascii_lower(F.get(F.col("p"), shift + i)) == w, "1").otherwise("0")), "")
        k = F.least(F.lit(size), F.size(c["words"]))
        starts = F.filter(F.sequence(F.lit(0), F.size(c["words"]) - k), lambda s: F.substring(same, s + 1, k) == F.repeat(F.lit("1"), k))
        return F.flatten(F.transform(starts, lambda s: F.sequence(shift + s, shift + s + k - 1)))

    hits = lambda c: F.array_distinct(F.flatten(F.transform(c["shifts"], lambda shift: at_shift(c, shift))))
    found = F.filter(F.transform(F.coalesce("cands", F.array()), lambda c: F.struct(c["item"].alias("item"), hits(c).alias("hits"))), lambda f: F.size(f["hits"]) > 0)
    n = F.size("p")
    edge = (F.col("p")[0] == "").cast("int") + (F.element_at("p", -1) == "").cast("int")
    n_words = F.when((n == 1) & (F.col("p")[0] == ""), 0).otherwise(n - edge)
    return rows.select("doc_id", "text", n_words.cast("long").alias("n_words"), F.coalesce(F.size(F.array_distinct(F.transform("cands", lambda c: c["item"]))), F.lit(0)).cast("long").alias("n_near"), found.alias("found"))


def judged(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 5, postings: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near for each document."""
    m = matches(docs, benchmark, size, slop, postings)
    m = m.select("doc_id", "n_words", "n_near", F.explode(F.array(F.col("found"))).alias("found"))
    hit = F.array_distinct(F.flatten(F.transform("found", lambda f: f["hits"])))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["item"])))
    return m.select(
        "doc_id",
        "n_words",
        F.size(hit).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("found") > 0).alias("contaminated"),
        "n_near",
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without the rows that hold any window of the benchmark; all columns stay. Each row is judged on its own text, whatever its doc_id."""
    m = matches(docs, benchmark, size).filter(F.size("found") > 0)
    taken = {c.lower() for c in docs.columns}
    key = next(f"hit{'_' * i}" for i in range(len(taken) + 1) if f"hit{'_' * i}" not in taken)
    gone = m.select(F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias(key)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{key}.d")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f"{key}.t"))
    return docs.join(gone, same, "left_anti")
