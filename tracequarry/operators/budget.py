"""The exact list within a budget: candidates come from several ordered lists, read in turns until the budget is spent.

A query's lists are the passages whose literals equal its identifiers, the best first; for each quote that is a
phrase of tokens the passages that hold the phrase, by score; and all passages in order of identity. Every candidate read counts against one
budget, also one that an earlier list has brought; it is verified byte by byte against all atoms. No list is needed beyond
the budget, so distributed top-k operators make them, and a query's rows fit one group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.text import fold_token, parse_query, passage_literals, phrase_quote
from .retrieval import HIT_COLUMNS, IDENTITY, LIMIT_REACHED, UNIQUE_EXHAUSTED, WORK_EXHAUSTED, bm25_of_terms, corpus_stats, explained, fuse_rows, index_fields, keep_first, match_structs, phrases_of, term_counts, visible

DEADLINE = "deadline"
BUDGET_COLUMNS = HIT_COLUMNS + ", examined_fallback int"


@dataclass(frozen=True)
class Lists:
    """The candidate lists of a query, by number: 0.. in the order in which they take turns."""

    identifiers: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]  # tokens
    atoms: int
    raw: bool  # a quote that is no phrase, which only the scan finds

    @property
    def count(self) -> int:
        return bool(self.identifiers) + len(self.phrases) + bool(self.atoms)

    @property
    def scan(self) -> int:
        """The number of the list of all passages."""
        return self.count - 1

    def phrase(self, k: int) -> int:
        return bool(self.identifiers) + k


def lists_of(text: str) -> Lists:
    atoms = parse_query(text).atoms
    quotes = [t for t, kind in atoms if kind == "quoted"]
    names = tuple(t for t, kind in atoms if kind == "identifier" and len(t.encode()) <= formats.LITERAL_MAX)
    return Lists(names, tuple(tuple(fold_token(t)) for t in quotes if phrase_quote(t)), len(atoms), any(not phrase_quote(t) for t in quotes))


class Pager:
    """Reads a query's lists in turns. lists are identities in order, at most as many as the budget; matches has
    the sort key of every candidate that holds an atom."""

    def __init__(self, lists: list[list], matches: dict, scan: int | None, raw: bool, budget: int = formats.CANDIDATES_MAX):
        self.lists, self.matches, self.budget = lists, matches, budget
        self.watched = scan if raw else None
        self.at, self.ended = [0] * len(lists), [False] * len(lists)
        self.read = self.scanned = self.first = 0
        self.seen: set = set()
        self.found: list = []

    @property
    def exhausted(self) -> bool:
        return all(self.ended)

    @property
    def spent(self) -> bool:
        return self.read >= self.budget and not self.exhausted

    def _page(self, k: int, size: int) -> int:
        page = self.lists[k][self.at[k] : self.at[k] + size]
        self.at[k] += len(page)
        self.ended[k] = len(page) < size
        self.read += len(page)
        self.scanned += len(page) if k == self.watched else 0
        for c in page:
            if c not in self.seen:
                self.seen.add(c)
                if c in self.matches:
                    self.found.append(c)
        return len(page)

    def read_to(self, wanted: int) -> bool:
        """Rounds until there are wanted matches, the budget is spent or the lists end; whether any was found. A round
        shares what is missing among the lists that go on, and the next one begins one list later."""
        before = len(self.found)
        while len(self.found) < wanted and self.read < self.budget and not self.exhausted:
            share = -(-(wanted - len(self.found)) // self.ended.count(False))
            order = [(self.first + k) % len(self.lists) for k in range(len(self.lists))]
            got = sum(self._page(k, min(share, self.budget - self.read)) for k in order if not self.ended[k] and self.read < self.budget)
            self.first = (self.first + 1) % len(self.lists)
            if not got:
                break
        return len(self.found) > before

    def ranked(self) -> list:
        return sorted(self.found, key=lambda c: self.matches[c])


def deepen(pager: Pager, lexical: list, limit: int, rows_of) -> tuple[list[dict], str, int, int]:
    """(fused rows with their verdicts, stop reason, exact and lexical depth): both lists are deepened in steps until
    there are limit hits or neither goes on. rows_of makes rows of the two lists' identities."""
    step, most = formats.CANDIDATES_INITIAL, formats.CANDIDATES_MAX
    wanted = step
    pager.read_to(wanted)
    exact, depth = pager.ranked(), min(len(pager.found), wanted)
    held = min(len(lexical), step)
    ended = held < step
    while True:
        fused = fuse_rows(rows_of(exact[:depth], lexical[:held]))
        verdicts = keep_first((k, r["document_id"], r["start_byte"], r["end_byte"], r["content_sha256"]) for k, r in enumerate(fused, 1))
        if sum(h is not None for h, _, _ in verdicts) >= limit:
            reason = LIMIT_REACHED
            break
        moved = False
        if not pager.exhausted and not pager.spent and wanted < most:
            wanted = min(wanted + step, most)
            moved = pager.read_to(wanted)
            exact, was, depth = pager.ranked(), depth, min(len(pager.found), wanted)
            moved |= depth > was
        if not ended and held < most:
            size = min(step, most - held)
            page = len(lexical[held : held + size])
            ended, held = page < size, held + page
            moved |= page > 0
        if not moved:
            reason = WORK_EXHAUSTED if pager.spent or (not ended and held == most) else UNIQUE_EXHAUSTED
            break
    return visible(fused, verdicts, limit), reason, depth, held


NAMES = [*IDENTITY, *(c.split()[0] for c in BUDGET_COLUMNS.split(", "))]
SPANS, MATCHED = ["end_byte", "content_sha256"], ["matched_atoms", "matched_bytes", "longest_atom", "fallback"]


def rank(plan: Lists, records, limit: int, late: bool = False) -> list[dict]:
    """The fused hits of one query, a row of NAMES each, after a row of fused_rank 0 that tells why it stopped and what it
    examined. records are rows of hits(): list is a list's number, or -1 for the lexical one, and place the place there."""
    lists, terms, info, matches = [[] for _ in range(plan.count)], [], {}, {}
    for r in sorted((r for r in records if r["list"] > -2), key=lambda r: (r["list"], r["place"])):
        own = (r["source_id"], r["document_id"], int(r["start_byte"]))
        info[own] = {**dict(zip(IDENTITY, own)), **{k: r[k] for k in SPANS}}
        if r["list"] == -1:
            terms.append((own, r["score"]))
            continue
        lists[int(r["list"])].append(own)
        if r["matched_atoms"]:
            matches[own] = (-int(r["matched_atoms"]), -int(r["matched_bytes"]), -int(r["longest_atom"]), *own, bool(r["fallback"]))

    def rows_of(exact, held):
        ranks = {own: k for k, own in enumerate(exact, 1)}
        scores = {own: (k, s) for k, (own, s) in enumerate(held, 1)}
        for own in {**ranks, **scores}:
            k, (n, s) = ranks.get(own), scores.get(own, (None, None))
            yield {**info[own], "exact_rank": k, "lexical_rank": n, "score": s, "matched_bytes": -matches[own][1] if k else 0, "fallback": matches[own][-1] if k else None}

    pager = Pager(lists, matches, plan.scan if plan.atoms else None, plan.raw)
    found, why, exact, lexical = deepen(pager, terms, limit, rows_of)
    told = {"stop_reason": DEADLINE if late and why != LIMIT_REACHED else why, "examined_exact": exact, "examined_lexical": lexical, "examined_fallback": pager.scanned}
    return [{"fused_rank": 0, "units": 0, "matched_bytes": 0, **told}, *({**r, **told} for r in found)]


def hits(candidates: DataFrame, lexical: DataFrame, queries: dict[str, str], limit: int = formats.RESULTS_DEFAULT) -> DataFrame:
    """The hits of each query as retrieval.hits has them, the exact list within its budget; and a row of
    fused_rank 0 for each query, also where nothing was found (see rank).

    candidates: query_id, list, place, identity, end_byte, content_sha256 and, for those that hold an atom, matched_atoms, matched_bytes,
    longest_atom and fallback. lexical: query_id, identity, end_byte, content_sha256, rank and score. A
    query's group is at most its lists times the budget."""
    if not 1 <= limit <= formats.RESULTS_MAX:
        raise ValueError("limit out of range")
    plans = {k: lists_of(q) for k, q in queries.items()}
    asked = candidates.sparkSession.createDataFrame([(k, -2) for k in queries], "query_id string, list int")
    rows = rows_of_lists(candidates, lexical).unionByName(asked, allowMissingColumns=True)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        query = frame["query_id"].iloc[0]
        frame = frame.astype(object).where(frame.notna(), None)
        found = rank(plans[query], frame.to_dict("records"), limit)
        out = pd.DataFrame([[query, *(r.get(n) for n in NAMES)] for r in found], columns=["query_id", *NAMES])
        return out.astype({n: "Int64" for n in ("start_byte", "hit", "duplicate_of", "exact_rank", "lexical_rank")} | {"fallback": "boolean"})

    types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ["query_id", *IDENTITY])
    return explained(rows.groupBy("query_id").applyInPandas(run, f"{types}, {BUDGET_COLUMNS}"))


def rows_of_lists(candidates: DataFrame, lexical: DataFrame) -> DataFrame:
    c = candidates.select("query_id", *IDENTITY, *SPANS, "list", "place", *MATCHED)
    x = lexical.select("query_id", *IDENTITY, *SPANS, F.lit(-1).alias("list"), F.col("rank").alias("place"), "score")
    return c.unionByName(x, allowMissingColumns=True)


def top(rows: DataFrame, order: list, most: int | None = formats.CANDIDATES_MAX) -> DataFrame:
    """The first most rows of each list of each query, with their place."""
    place = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(*order, *IDENTITY))
    placed = rows.withColumn("place", place)
    return placed if most is None else placed.where(F.col("place") <= most)


def identifier_candidates(literals: DataFrame, queries: dict[str, str], most: int | None = formats.CANDIDATES_MAX) -> DataFrame:
    """(query_id, list, place, identity, n): passages by the identifiers of a query that are among their literals, most and longest
    first. literals: literal and identity; a literal in several fields counts once. Equality on literal reaches the scan."""
    asked = [(k, t, len(t.encode())) for k, q in queries.items() for t in lists_of(q).identifiers]
    wanted = literals.sparkSession.createDataFrame(asked, "query_id string, literal string, size int")
    held = literals.where(F.col("literal").isin(sorted({t for _, t, _ in asked}))).select("literal", *IDENTITY).distinct()
    each = held.join(F.broadcast(wanted), "literal").groupBy("query_id", *IDENTITY)  # at most 16 atoms a query
    ranked = each.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("longest")).withColumn("list", F.lit(0))
    return top(ranked, [F.desc("n"), F.desc("bytes"), F.desc("longest")], most).select("query_id", "list", "place", *IDENTITY, "n")


def scan_candidates(first: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, list, place, identity) of the list of all passages, of which first has the budget's."""
    asked = [F.struct(F.lit(k).alias("query_id"), F.lit(lists_of(q).scan).alias("list")) for k, q in queries.items() if lists_of(q).atoms]
    return top(first.select(*IDENTITY, F.inline(F.array(*asked))), []).select("query_id", "list", "place", *IDENTITY)


def passage_lists(passages: DataFrame, queries: dict[str, str], digits: int | None = None) -> DataFrame:
    """The candidates of hits() from passages without an index: their literals and tokens are made here. digits rounds
    the scores that order a phrase's list."""
    held = []
    if any(lists_of(q).identifiers for q in queries.values()):
        literals = passages.select(*IDENTITY, F.inline(passage_literals(F.col("title"), F.col("source_uri"), F.col("body_text"))))
        held.append(identifier_candidates(literals, queries).drop("n"))
    terms = [(f"{k}\x1f{p.phrase(i)}", 0, " ".join(t), 1) for k, p in ((k, lists_of(q)) for k, q in queries.items()) for i, t in enumerate(p.phrases)]
    if terms:
        indexed = index_fields(passages)
        scores = bm25_of_terms(term_counts(indexed, phrases_of(terms), IDENTITY), lambda: corpus_stats(indexed), terms, indexed.select(*IDENTITY))
        score = F.col("score") if digits is None else F.round("score", digits)
        own = F.split("query_id", "\x1f")
        held.append(top(scores.select(own[0].alias("query_id"), own[1].cast("int").alias("list"), *IDENTITY, score.alias("score")), ["score"]).select("query_id", "list", "place", *IDENTITY))
    held.append(scan_candidates(passages.orderBy(*IDENTITY).limit(formats.CANDIDATES_MAX), queries))
    lists = reduce(DataFrame.unionByName, held)
    near = lists.join(passages.select(*IDENTITY, *SPANS, "title", "source_uri", "body_text"), IDENTITY)  # the lists are made once, and bring their texts
    each = match_structs(queries)
    own = F.get(F.filter(F.array(*each), lambda x: x["query_id"] == F.col("query_id")), F.lit(0)) if each else None
    found = [(own[c] if each else F.lit(None).cast("boolean" if c == "fallback" else "int")).alias(c) for c in MATCHED]
    return near.select("query_id", *IDENTITY, "list", "place", *SPANS, *found)


def reads(candidates: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, read, found, scanned, exhausted): what reading each query's exact list to its end or budget takes."""
    plans = {k: lists_of(q) for k, q in queries.items()}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        plan = plans[frame["query_id"].iloc[0]]
        lists, matches = [[] for _ in range(plan.count)], {}
        for r in frame.sort_values(["list", "place"]).itertuples():
            own = (r.source_id, r.document_id, r.start_byte)
            lists[r.list].append(own)
            if r.matched_atoms == r.matched_atoms and r.matched_atoms is not None:
                matches[own] = own
        pager = Pager(lists, matches, plan.scan, plan.raw)
        for wanted in range(formats.CANDIDATES_INITIAL, formats.CANDIDATES_MAX + 1, formats.CANDIDATES_INITIAL):
            pager.read_to(wanted)
        return pd.DataFrame([(frame["query_id"].iloc[0], pager.read, len(pager.found), pager.scanned, pager.exhausted)], columns=["query_id", "read", "found", "scanned", "exhausted"])

    rows = candidates.select("query_id", *IDENTITY, "list", "place", "matched_atoms")
    return rows.groupBy("query_id").applyInPandas(run, "query_id string, read long, found long, scanned long, exhausted boolean")
