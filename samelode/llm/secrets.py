"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of every path is content-addressed (SHA-256 of its bytes). The ledger is a table of findings by blob and
rule version; a run scans only the (blob, rule version) pairs that the ledger lacks and joins the findings of all blobs
back to all paths. A run is idempotent: a pair scanned twice after a lost write gives the same row, and reads take one.

Null and empty texts hold no secrets; repeated rows share one blob and each gets its row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samelode.llm.common import small, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has at least `least` characters. `near` is a cheap test that every text with a match passes."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    near: str


#: The base patterns.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)passw|secret|token|api_?key"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Rules beyond the base: private key blocks and signed web tokens.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 60, r"-----BEGIN"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\."),
)
SPAN = "struct<start:bigint,end:bigint>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches that pass the rule's test.

    The pieces between matches and the matches alternate, so running lengths give the positions.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), tested.alias("tested")).cast("array<struct<gap:bigint,whole:bigint,tested:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc: Column, m: Column) -> Column:
        lo = acc["at"] + m["gap"]
        hi = lo + m["whole"]
        hit = F.struct(lo.cast("long").alias("start"), hi.cast("long").alias("end"))
        return F.struct(hi.cast("long").alias("at"), F.when(m["tested"] >= rule.least, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(rows, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.near), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def _pair(r: Rule) -> Column:
    return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, spans) for every row (blob, text, need) and every rule in its `need`; no other rule is run on it."""
    wants = lambda r: F.array_contains("need", _pair(r))
    found = blobs.select("blob", *[F.when(wants(r), spans(F.col("text"), r)).alias(r.kind) for r in rules])
    rows = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules])
    return found.select("blob", F.explode(F.filter(rows, lambda x: x["spans"].isNotNull())).alias("r")).select("blob", "r.kind", "r.version", "r.spans")


def current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows that belong to these rules in their present versions, one for each pair."""
    wanted = F.array(*[_pair(r) for r in rules])
    return ledger.filter(F.array_contains(wanted, F.struct("kind", "version"))).dropDuplicates(["blob", "kind", "version"])


def unseen(history: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, need) of each content that lacks a scan by any of the rules; `need` lists those (kind, version). Where there is
    a ledger, it is compared with hashes alone, and only texts of blobs that lack something are moved. Copies collapse before the shuffle."""
    every = F.array(*[_pair(r) for r in rules])
    blobs = history.select(blob_id(F.col("text")).alias("blob"), "text")
    if ledger is None:
        return blobs.dropDuplicates(["blob"]).withColumn("need", every)
    done = current(ledger, rules).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    need = blobs.select("blob").distinct().join(done, "blob", "left").select("blob", F.array_except(every, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>"))).alias("need"))
    need = stored(need.filter(F.size("need") > 0), "unseen")
    return blobs.join(small(need), "blob").dropDuplicates(["blob"])


def update(history: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger rows that a run adds: scans of just the unseen (blob, rule version) pairs."""
    return scan(unseen(history, ledger, rules), rules)


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], keys: list[str]) -> DataFrame:
    """The given key columns of every version in history with an array of (kind, spans) of its blob by the current rules."""
    by_blob = (
        current(ledger, rules)
        .filter(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.collect_list(F.struct("kind", "spans")).alias("found"))
    )
    paths = history.select(*keys, blob_id(F.col("text")).alias("blob"))
    return paths.join(by_blob, "blob", "left").select(*keys, "blob", F.coalesce("found", F.array().cast(f"array<struct<kind:string,spans:array<{SPAN}>>>")).alias("found"))
