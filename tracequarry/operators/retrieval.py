"""Retrieval over passages for many queries at once: BM25, phrases, exact matches, fusion.

A passages table has source_id, document_id, start_byte, end_byte, title, source_uri, body_text and
content_sha256. Queries are a small driver-side list, sent along as literal tables whose size is
bounded by the query parser's own limits and MAX_QUERIES.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.hashing import bloom_positions
from ..functions.text import Query, fold_token, parse_query, phrase_quote, tokens

IDENTITY = ["source_id", "document_id", "start_byte"]
MAX_QUERIES = 1000


def _check(queries: dict[str, str]) -> dict[str, Query]:
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries at once")
    return {k: parse_query(q) for k, q in queries.items()}


def index_fields(passages: DataFrame) -> DataFrame:
    """passages with the tokens of title, source_uri and body, as arrays."""
    return passages.withColumns({f"tok_{n}": tokens(F.col(c)) for n, c in (("title", "title"), ("uri", "source_uri"), ("body", "body_text"))})


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """One row: n rows and their mean token count over all columns."""
    size = sum((F.size(n) for n in FIELDS), F.lit(0))
    return indexed.agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("avg_len"))


FIELDS = ("tok_title", "tok_uri", "tok_body")


def phrase_count(phrase: list[str], fields=FIELDS) -> Column:
    """How often a token phrase occurs in the columns of an indexed table; phrases do not run across columns."""
    if not phrase:
        return F.lit(0)

    def in_field(name: str) -> Column:
        tok = F.col(name)
        ahead = [F.slice(tok, j + 1, F.greatest(F.size(tok), F.lit(1))).alias(f"t{j}") for j in range(len(phrase))]
        return F.size(F.filter(F.arrays_zip(*ahead), lambda x: reduce(lambda a, b: a & b, [x[f"t{j}"].eqNullSafe(t) for j, t in enumerate(phrase)])))

    return sum(map(in_field, fields), F.lit(0))


def term_counts(indexed: DataFrame, phrases: list[tuple[str, ...]], keys: list[str]) -> DataFrame:
    """(keys, len, term, f): how often a row has each phrase, for the rows that have it. Tokens that
    are no query term go before anything is dealt out."""
    size = sum((F.size(n) for n in FIELDS), F.lit(0)).alias("len")
    single = sorted({p[0] for p in phrases if len(p) == 1})
    longer = [p for p in phrases if len(p) > 1]
    found = []
    if single:
        found.append(F.transform(F.filter(F.concat(*FIELDS), lambda t: t.isin(single)), lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("f"))))
    if longer:
        each = F.array(*[F.struct(F.lit(" ".join(p)).alias("term"), phrase_count(list(p)).cast("long").alias("f")) for p in longer])
        found.append(F.filter(each, lambda x: x["f"] > 0))
    return indexed.select(*keys, size, F.inline(F.concat(*found))).groupBy(*keys, "len", "term").agg(F.sum("f").alias("f"))  # one scan for both


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, formats.IDF_FLOOR).otherwise(raw)


def query_terms(queries: dict[str, str]) -> list[tuple[str, int, str, int]]:
    """(query_id, position, phrase of index tokens, number of terms) of every query term."""
    return [(k, i, " ".join(fold_token(t)), len(q.terms)) for k, q in _check(queries).items() for i, t in enumerate(q.terms or [])]


def phrases_of(terms: list[tuple]) -> list[tuple[str, ...]]:
    return sorted({tuple(t.split(" ")) for _, _, t, _ in terms if t})


def bm25_scores(indexed: DataFrame, queries: dict[str, str], keys: list[str] = IDENTITY) -> DataFrame:
    """(query_id, keys..., score) of the rows that hold all terms of a query; lower scores are better.

    Frequencies of the terms of all queries come from one scan of the tokens.
    """
    phrases = phrases_of(query_terms(queries))
    counts = term_counts(indexed, phrases, keys) if phrases else None
    return bm25_from_counts(counts, lambda: corpus_stats(indexed), queries, indexed.select(*keys))


def bm25_from_counts(counts: DataFrame | None, stats, queries: dict[str, str], keyed: DataFrame) -> DataFrame:
    """bm25_scores from counts (keys, len, term, f) and stats(), a row of n and avg_len of the whole table.
    keyed has the keys' columns."""
    return bm25_of_terms(counts, stats, query_terms(queries), keyed)


def bm25_of_terms(counts: DataFrame | None, stats, terms: list[tuple], keyed: DataFrame) -> DataFrame:
    """bm25_from_counts for terms as query_terms() has them. Document frequencies join by term; a row's
    contributions are summed in order of the query's terms, so that a score has the same bits every time."""
    spark, keys = keyed.sparkSession, keyed.columns
    if counts is None or not terms:
        empty = spark.createDataFrame([], "query_id string, score double")
        return empty.select("query_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema), "score")
    wanted = spark.createDataFrame(terms, "query_id string, pos int, term string, need int")
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = wanted.join(frequency, "term").join(F.broadcast(stats()))  # statistics are one row
    norm = F.col("f") + formats.BM25_K1 * (1 - formats.BM25_B + formats.BM25_B * F.col("len") / F.col("avg_len"))
    part = idf(F.col("n"), F.col("df")) * (F.col("f") * (formats.BM25_K1 + 1) / norm)
    hits = counts.join(F.broadcast(weights), "term")  # a row for each query term: at most MAX_QUERIES times the terms of a query
    each = hits.groupBy("query_id", *keys).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"), F.max("need").alias("need"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["part"])
    return each.where(F.size("parts") == F.col("need")).select("query_id", *keys, (-total).alias("score"))


def exact_matches(passages: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query_id, identity, matched_atoms, matched_bytes, longest_atom, fallback): byte-exact,
    case-sensitive matches of the atoms in title, source_uri or content, in one scan."""
    each = match_structs(queries)
    if not each:
        empty = passages.sparkSession.createDataFrame([], "query_id string, matched_atoms int, matched_bytes int, longest_atom int, fallback boolean")
        return empty.select("query_id", *(F.lit(None).cast(passages.schema[c].dataType).alias(c) for c in IDENTITY), "matched_atoms", "matched_bytes", "longest_atom", "fallback")
    return passages.select(*IDENTITY, F.explode(F.array_compact(F.array(*each))).alias("_q")).select("_q.query_id", *IDENTITY, "_q.matched_atoms", "_q.matched_bytes", "_q.longest_atom", "_q.fallback")


def match_structs(queries: dict[str, str]) -> list[Column]:
    """What a passage holds of the atoms of each query that has some; null if none of them."""
    each = []
    for k, q in _check(queries).items():
        if not q.atoms:
            continue
        found = [(t, kind, reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(t)) for c in ("title", "source_uri", "body_text")])) for t, kind in q.atoms]
        size = lambda t: len(t.encode())
        total = sum((F.when(m, size(t)).otherwise(0) for t, _, m in found), F.lit(0))
        longest = F.greatest(*[F.when(m, size(t)).otherwise(0) for t, _, m in found], F.lit(0))
        count = sum((m.cast("int") for _, _, m in found), F.lit(0))
        fallback = reduce(lambda a, b: a | b, [m for t, kind, m in found if kind == "quoted" and not phrase_quote(t)], F.lit(False))
        each.append(F.when(count > 0, F.struct(F.lit(k).alias("query_id"), count.alias("matched_atoms"), total.alias("matched_bytes"), longest.alias("longest_atom"), fallback.alias("fallback"))))
    return each


def bloom_bits(text: str) -> list[int]:
    """The bits that a bloom of a text that holds this one has; texts of fewer than three bytes have none."""
    data = text.encode()
    return sorted({p for i in range(len(data) - 2) for p in bloom_positions(data[i : i + 3])})


def exact_top(passages: DataFrame, queries: dict[str, str], k: int = formats.CANDIDATES_MAX) -> DataFrame:
    order = [F.desc("matched_atoms"), F.desc("matched_bytes"), F.desc("longest_atom"), *IDENTITY]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return exact_matches(passages, queries).withColumn("rank", rank).where(F.col("rank") <= k)


def literal_candidates(literals: DataFrame, atoms: DataFrame) -> DataFrame:
    """(query_id, passage_id, matched, matched_bytes, longest): postings that equal an atom, a literal
    in several fields counted once. atoms is small: bounded by the parser and MAX_QUERIES."""
    hit = literals.join(F.broadcast(atoms), F.col("literal") == F.col("atom")).select("query_id", "passage_id", "literal", "size").distinct()
    return hit.groupBy("query_id", "passage_id").agg(F.count(F.lit(1)).alias("matched"), F.sum("size").alias("matched_bytes"), F.max("size").alias("longest"))


def half_up(numerator: Column | int, denominator: Column) -> Column:
    """numerator / denominator in whole numbers, halves upwards."""
    n = F.lit(numerator) if isinstance(numerator, int) else numerator
    return _div(n + _div(denominator, F.lit(2)), denominator)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def exact_units(rank: Column) -> Column:
    return half_up(3 * formats.RRF_SCALE, (rank + formats.RRF_K) * 2)


def lexical_units(rank: Column) -> Column:
    return half_up(formats.RRF_SCALE, rank + formats.RRF_K)


def fuse(exact: DataFrame, lexical: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion in integer units of both ranked lists, best first by fused_rank."""
    on = ["query_id", *IDENTITY]
    e = exact.select(*on, F.col("rank").alias("exact_rank"), "matched_bytes", "fallback")
    x = lexical.select(*on, F.col("rank").alias("lexical_rank"), "score")
    both = e.join(x, on, "full_outer")
    zero = F.lit(0).cast("long")
    units = F.coalesce(exact_units(F.col("exact_rank")), zero) + F.coalesce(lexical_units(F.col("lexical_rank")), zero)
    fused = both.withColumns({"units": units, "matched_bytes": F.coalesce("matched_bytes", F.lit(0))})
    order = Window.partitionBy("query_id").orderBy(F.desc("units"), F.desc("matched_bytes"), *IDENTITY)
    return fused.withColumn("fused_rank", F.row_number().over(order))


def overlap_half(a_start: int, a_end: int, b_start: int, b_end: int) -> bool:
    shared = min(a_end, b_end) - max(a_start, b_start)
    return 2 * max(shared, 0) >= min(a_end - a_start, b_end - b_start)


def keep_first(rows) -> list[tuple]:
    """(hit, rank of the hit that it duplicates, reason) of rows (rank, document, start, end, content) in rank
    order: a row is a hit unless a hit before it has the same content, or the same document and a span that
    overlaps by half the shorter."""
    kept: list[tuple] = []
    by_content: dict[str, int] = {}
    by_document: dict[str, list[int]] = {}
    out = []
    for rank, document, start, end, content in rows:
        places = [k for k in by_document.get(document, ()) if overlap_half(kept[k][1], kept[k][2], start, end)]
        same = by_content.get(content)
        first = min([*places, *([same] if same is not None else [])], default=None)
        if first is None:
            by_content.setdefault(content, len(kept))
            by_document.setdefault(document, []).append(len(kept))
            kept.append((rank, start, end))
            out.append((len(kept), None, None))
        else:
            out.append((None, kept[first][0], "same_content" if first == same else "overlapping_span"))
    return out


def greedy_dedupe(fused: DataFrame) -> DataFrame:
    """keep_first over each query's fused list, as columns hit, duplicate_of and reason.

    fused needs query_id, fused_rank, document_id, start_byte, end_byte and content_sha256. A query's
    rows are at most the two candidate lists, so a group is bounded by 2 * CANDIDATES_MAX.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fused_rank")
        found = keep_first(rows[["fused_rank", "document_id", "start_byte", "end_byte", "content_sha256"]].itertuples(index=False))
        out = [(q, r, *x) for q, r, x in zip(rows["query_id"], rows["fused_rank"], found)]
        return pd.DataFrame(out, columns=["query_id", "fused_rank", "hit", "duplicate_of", "reason"]).astype({"hit": "Int64", "duplicate_of": "Int64"})

    keys = fused.select("query_id", "fused_rank", "document_id", "start_byte", "end_byte", "content_sha256")
    schema = "query_id string, fused_rank int, hit long, duplicate_of long, reason string"
    return fused.join(keys.groupBy("query_id").applyInPandas(run, schema), ["query_id", "fused_rank"])


def overlapping_spans(spans: DataFrame, group: str, key: str, start: str, end: str, width: int) -> DataFrame:
    """(left, right) of the spans of one group that overlap by half of the shorter, the smaller key left. Spans
    of up to width meet in buckets of that width, each pair in the bucket where their overlap begins."""
    bucket = lambda c: F.floor(c / width)
    spread = spans.select(group, F.col(key).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))).alias("bucket"))
    a, b = (spread.select(group, "bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "s", "e")]) for side in ("left", "right"))
    low = F.greatest("left_s", "right_s")
    half = 2 * (F.least("left_e", "right_e") - low) >= F.least(F.col("left_e") - F.col("left_s"), F.col("right_e") - F.col("right_s"))
    both = a.join(b, [group, "bucket"]).where("left_id < right_id")
    return both.where(half & (F.col("bucket") == bucket(low))).select("left_id", "right_id")


LIMIT_REACHED, WORK_EXHAUSTED, UNIQUE_EXHAUSTED = "limit_reached", "work_budget_exhausted", "unique_exhausted"
HIT_COLUMNS = "fused_rank int, hit long, duplicate_of long, reason string, units long, exact_rank int, lexical_rank int, matched_bytes int, fallback boolean, score double, stop_reason string, examined_exact int, examined_lexical int"


def fuse_rows(rows) -> list[dict]:
    """Rows of one query with the units of their ranks, best first. A row that is in one list only has no rank in the other."""
    out = []
    for r in rows:
        a = 0 if r["exact_rank"] is None else _half_up(3 * formats.RRF_SCALE, 2 * (formats.RRF_K + r["exact_rank"]))
        b = 0 if r["lexical_rank"] is None else _half_up(formats.RRF_SCALE, formats.RRF_K + r["lexical_rank"])
        out.append({**r, "units": a + b})
    return sorted(out, key=lambda r: (-r["units"], -r["matched_bytes"], *(r[c] for c in IDENTITY)))


def visible(fused: list[dict], verdicts: list[tuple], limit: int) -> list[dict]:
    """The first limit hits and their duplicates, with their rank and verdict."""
    kept, out = set(), []
    for k, (r, (hit, of, why)) in enumerate(zip(fused, verdicts), 1):
        if hit is not None and hit <= limit:
            kept.add(k)
        elif of not in kept:
            continue
        out.append({**r, "fused_rank": k, "hit": hit, "duplicate_of": of, "reason": why})
    return out


def deepen(rows: list[dict], limit: int) -> tuple[list[dict], str, int, int]:
    """(fused rows with their verdicts, stop reason, exact and lexical depth) of one query: both lists are read
    in steps of CANDIDATES_INITIAL until there are limit hits or nothing is left. A row of a rank beyond
    CANDIDATES_MAX only tells that its list goes on."""
    most, step = formats.CANDIDATES_MAX, formats.CANDIDATES_INITIAL
    ends = [max((int(r[c]) for r in rows if r[c] is not None), default=0) for c in ("exact_rank", "lexical_rank")]
    target = step
    while True:
        depth = [min(e, target, most) for e in ends]
        held = []
        for r in rows:
            x, y = (int(r[c]) if r[c] is not None and r[c] <= d else None for c, d in zip(("exact_rank", "lexical_rank"), depth))
            if x is not None or y is not None:
                matched = int(r["matched_bytes"] or 0) if x is not None else 0
                held.append({**r, "exact_rank": x, "lexical_rank": y, "matched_bytes": matched, "fallback": r["fallback"] if x is not None else None, "score": r["score"] if y is not None else None})
        fused = fuse_rows(held)
        found = keep_first((k, r["document_id"], r["start_byte"], r["end_byte"], r["content_sha256"]) for k, r in enumerate(fused, 1))
        hits = sum(h is not None for h, _, _ in found)
        done = [d >= min(e, most) for d, e in zip(depth, ends)]
        if hits >= limit or all(done):
            break
        target += step
    reason = LIMIT_REACHED if hits >= limit else WORK_EXHAUSTED if any(e > most for e in ends) else UNIQUE_EXHAUSTED
    return visible(fused, found, limit), reason, *depth


def _half_up(numerator: int, denominator: int) -> int:
    return (numerator + denominator // 2) // denominator


def best(rows: DataFrame, order: list, most: int = formats.CANDIDATES_MAX) -> DataFrame:
    """The best most rows of each query with their rank, and one more that tells that there are more."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, *IDENTITY))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most + 1)


MODES = ("auto", "lexical")


def hits(exact: DataFrame, lexical: DataFrame, spans: DataFrame, limit: int = formats.RESULTS_DEFAULT) -> DataFrame:
    """Fused and deduplicated hits of each query from its matches and scores: hit 1.. in order, and with
    duplicate_of and reason the duplicates of these hits; why the search stopped and how deep; and lists, the
    explanation of each score. spans has identity, end_byte and content_sha256. A query's group is at most
    1,002 rows."""
    if not 1 <= limit <= formats.RESULTS_MAX:
        raise ValueError("limit out of range")
    on = ["query_id", *IDENTITY]
    e = best(exact, [F.desc("matched_atoms"), F.desc("matched_bytes"), F.desc("longest_atom")]).select(*on, F.col("rank").alias("exact_rank"), F.col("matched_bytes").cast("int").alias("matched_bytes"), "fallback")
    x = best(lexical, ["score"]).select(*on, F.col("rank").alias("lexical_rank"), "score")
    rows = e.join(x, on, "full_outer").join(spans.select(*IDENTITY, "end_byte", "content_sha256"), IDENTITY)
    names = [*IDENTITY, *(c.split()[0] for c in HIT_COLUMNS.split(", "))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        query = frame["query_id"].iloc[0]
        frame = frame.astype(object).where(frame.notna(), None)
        found, why, *depth = deepen(frame.to_dict("records"), limit)
        out = pd.DataFrame([[query, *(r.get(c) for c in names[:-3]), why, *depth] for r in found], columns=["query_id", *names])
        return out.astype({c: "Int64" for c in ("hit", "duplicate_of", "exact_rank", "lexical_rank")} | {"fallback": "boolean"})

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in on)
    return explained(rows.groupBy("query_id").applyInPandas(run, f"{types}, {HIT_COLUMNS}"))


def explained(found: DataFrame) -> DataFrame:
    """Hits with lists, the explanation of each score."""
    entry = lambda name, rank, units, score: F.when(rank.isNotNull(), F.struct(name.alias("retriever"), rank.alias("rank"), units.alias("contribution_units"), score.alias("backend_score")))
    none = F.lit(None).cast("double")
    first = entry(F.when(F.col("fallback"), "exact_fallback").otherwise("exact"), F.col("exact_rank"), exact_units(F.col("exact_rank")), none)
    second = entry(F.lit("lexical"), F.col("lexical_rank"), lexical_units(F.col("lexical_rank")), F.col("score"))
    return found.withColumn("lists", F.array_compact(F.array(first, second)))


def report(found: DataFrame, queries: dict[str, str], mode: str = "auto") -> DataFrame:
    """A row for each query, also those without a hit: modes, retrievers, why the search stopped, and how deep.
    The fallback retriever is one that a quote calls for that is no phrase of tokens."""
    if mode not in MODES:
        raise ValueError("unknown mode")
    rows = []
    for k, q in _check(queries).items():
        raw = any(kind == "quoted" and not phrase_quote(t) for t, kind in q.atoms)
        rows.append((k, mode, "lexical", ["exact", *(["exact_fallback"] if raw else []), "lexical"]))
    asked = found.sparkSession.createDataFrame(rows, "query_id string, requested_mode string, effective_mode string, retrievers array<string>")
    counts = [c for c in ("examined_exact", "examined_fallback", "examined_lexical") if c in found.columns]
    each = found.groupBy("query_id").agg(*[F.first(c).alias(c) for c in ("stop_reason", *counts)])
    joined = asked.join(each, "query_id", "left")  # a row for each query on either side
    return joined.withColumns({"stop_reason": F.coalesce("stop_reason", F.lit(UNIQUE_EXHAUSTED))} | {c: F.coalesce(c, F.lit(0)) for c in counts})


def search(passages: DataFrame, queries: dict[str, str], limit: int = formats.RESULTS_DEFAULT, scope: Column | None = None) -> DataFrame:
    """hits() over passages without an index: their tokens and texts are read. Statistics are of the whole
    table; scope restricts rows before any limit."""
    if not 1 <= limit <= formats.RESULTS_MAX:
        raise ValueError("limit out of range")
    lexical = bm25_scores(index_fields(passages), queries, [*IDENTITY])
    exact = exact_matches(passages if scope is None else passages.where(scope), queries)
    if scope is not None:
        lexical = lexical.join(passages.where(scope).select(*IDENTITY), IDENTITY, "left_semi")
    return hits(exact, lexical, passages, limit)


def page(hits: DataFrame, offset: int, limit: int, body: str = "body_text", cap: int = formats.PAGE_BODY_BYTES, keep: str | None = None) -> DataFrame:
    """A page of each query's hits; it ends before the hit whose text would exceed the byte cap. keep names a column for the bytes so far."""
    rows = hits.where(F.col("hit").between(offset + 1, offset + limit))
    running = F.sum(F.octet_length(body)).over(Window.partitionBy("query_id").orderBy("hit").rowsBetween(Window.unboundedPreceding, 0))
    name = keep or "_bytes"
    kept = rows.withColumn(name, running).where(F.col(name) <= cap)
    return kept if keep else kept.drop(name)
