"""Secret scans over an incremental blob ledger.

Every historical version of a path is content-addressed by SHA-256. The ledger records which
(blob, rule, rule version) triples have been scanned and what was found. A scan touches only
triples that are not in the ledger, one text per blob however many paths or versions hold it, and
joins the findings back to every path. DataFrame functions only.

Defined results: a null body is the empty text; repeated (path, version) rows each get their
findings; equal bodies are one blob, and at equal starts the rules' order decides; a very long body is
scanned whole in one row; an empty table gives an empty result; extra columns of the history are kept
unless they have a name of this operator's own output, which replaces them; spans are in code points,
end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SPAN = "array<struct<s:int,e:int>>"


@dataclass(frozen=True)
class Rule:
    """pattern is searched leftmost and non-overlapping; a match counts if the group is long enough."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of hex digits and of key characters are maximal, so their least length is part of the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def find_spans(body: Column, rule: Rule) -> Column:
    """Spans of a rule's matches: the pieces between matches and the matches add up to positions."""
    hits = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    rows = F.arrays_zip(F.split(body, rule.pattern, -1).alias("gap"), hits.alias("hit"), tested.alias("tested"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull() & (F.length(x["tested"]) >= rule.least)
        one = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    spans = F.aggregate(rows, start, step, lambda acc: acc["found"])
    return F.when(F.regexp_like(body, F.lit(rule.pattern)), spans).otherwise(F.array().cast(SPAN))


def address(history: DataFrame, body: str) -> DataFrame:
    """Adds blob, the SHA-256 of the body (null: empty)."""
    return history.withColumn("blob", F.sha2(F.coalesce(F.col(body), F.lit("")).cast("binary"), 256))


def scan_unseen(addressed: DataFrame, body: str, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the (blob, rule) pairs the ledger lacks."""
    blobs = addressed.groupBy("blob").agg(F.first(F.coalesce(F.col(body), F.lit(""))).alias("_body"))
    seen = None
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("_seen"))
        blobs = blobs.join(done, "blob", "left")
        seen = F.coalesce(F.col("_seen"), F.array().cast("array<string>"))
        todo = F.array(*[F.lit(r.key) for r in rules])
        blobs = blobs.where(F.size(F.array_except(todo, seen)) > 0)

    def entry(r: Rule) -> Column:
        spans = find_spans(F.col("_body"), r)
        if seen is not None:
            spans = F.when(~F.array_contains(seen, r.key), spans)
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans.alias("spans"))

    found = blobs.select("blob", F.array(*[entry(r) for r in rules]).alias("_all"))
    return found.select("blob", F.inline("_all")).where(F.col("spans").isNotNull())


def findings_by_path(addressed: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Joins the ledger's findings of these rule versions back to all rows: spans, one array of
    (s, o, e, kind) in order of start, then of rule."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    hits = ledger.where((F.size("spans") > 0) & F.concat_ws("@", "kind", "version").isin([r.key for r in rules]))
    each = hits.select("blob", "kind", order[F.concat_ws("@", "kind", "version")].alias("o"), F.inline("spans"))
    per_blob = each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s", "o", "e", "kind"))).alias("_found"))
    empty = F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")
    joined = addressed.drop("_found").join(per_blob, "blob", "left")
    return joined.withColumn("found", F.coalesce("_found", empty)).drop("_found")


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(history: DataFrame, body: str = "content", rules=RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(history with blob and found, ledger with the new rows)."""
    addressed = address(history, body)
    new = scan_unseen(addressed, body, rules, ledger)
    whole = new if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(new)
    return findings_by_path(addressed, whole, rules), whole


def ledger_in_rounds(addressed: DataFrame, body: str, rules=RULES, rounds: int = 2) -> DataFrame:
    """The ledger of a history whose rows arrive in rounds, by hash of their path: each round scans what the
    written ledger of those before lacks, and adds it."""
    ledger = None
    arrives = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(rounds))
    for k in range(rounds):
        new, _ = saved(scan_unseen(addressed.where(arrives == k), body, rules, ledger))
        ledger = new if ledger is None else ledger.unionByName(new)
    return ledger


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, a row per document. Documents are versions that arrive in two rounds;
    the second scans only blobs that the first has not seen."""
    history = docs.select("doc_id", F.col("text").alias("content"))
    addressed = address(history, "content")
    ledger = ledger_in_rounds(addressed, "content")
    found = findings_by_path(addressed.drop("content"), ledger)
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["o"] < 3)
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
    )
