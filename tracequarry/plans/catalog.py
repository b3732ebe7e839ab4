"""Registry of the retrieval engine's queries over the test tables, and DuckDB SQL for them.

The corpus is documents: one document each, its source as source_id, doc_id as document_id. Queries
over spans use the whole text as one passage unless they are about the chunker. A prior state for
the snapshot queries is derived from the whole table by its own columns (see PRIOR).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, hashing
from ..functions import text as T
from ..operators import audit, budget, chunker, evidence, retrieval, scopes, snapshot
from ..sources import filesystem

QUERIES: dict = {}
ORACLES: dict = {}
#: Query texts: terms, identifiers and quotes.
SEARCHES = {"q1": "the and", "q2": "license", 'q3': '"Apache License" version', "q4": 'hehe "thing" en', "q5": "der die und", "q6": 'mail7.example.com "the"', "q7": "los las", "q8": 'zzz "qqq"'}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one passage."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("body_text"))
    key = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("body_text").cast("long").alias("end_byte"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("title"), F.concat(F.lit("repo://"), key).alias("source_uri"), "body_text", F.sha2("body_text", 256).alias("content_sha256"),
    )


_D = """d AS (SELECT doc_id, source, lang, coalesce(text, '') AS body, doc_id || '.txt' AS title, 'repo://' || source || '/' || doc_id || '.txt' AS uri FROM documents)"""
_LIT = "list_filter(regexp_extract_all({0}, '[A-Za-z0-9_.:/-]+'), lambda x: length(x) BETWEEN 2 AND 128 AND regexp_matches(x, '[A-Za-z0-9]') AND regexp_matches(x, '[_.:/-]'))"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)[1:64]"
_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{Co}}_\-.:/][\p{{L}}\p{{N}}\p{{Co}}\x{{0300}}-\x{{0331}}_\-.:/]*')"
_LITS = f"""raw AS MATERIALIZED (SELECT doc_id, {_LIT.format('title')} AS lt, {_LIT.format('uri')} AS lu, {_LIT.format('body')} AS lb FROM d),
lits AS MATERIALIZED (SELECT doc_id, {_FIRST.format('lt')} AS t, {_FIRST.format('lu')} AS u, {_FIRST.format('lb')} AS b FROM raw),
pl AS (SELECT doc_id, list_concat(list_concat(list_transform(t, lambda x: {{'literal': x, 'field': 'title'}}), list_transform(u, lambda x: {{'literal': x, 'field': 'source_uri'}})), list_transform(b, lambda x: {{'literal': x, 'field': 'body'}}))[1:64] AS p FROM lits)"""


# --- text and literals ---


@query(f"WITH {_D}, x AS (SELECT doc_id, {_LIT.format('body')} AS l FROM d), y AS (SELECT doc_id, {_FIRST.format('l')} AS l FROM x) SELECT doc_id, i - 1 AS pos, l[i] AS literal FROM y, unnest(range(1, len(l) + 1)) AS u(i)")
def identifier_literals(spark, sf_dir):
    """The identifier literals of each document."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.identifier_literals(F.col("text"))).alias("p", "literal")).select("doc_id", F.col("p").cast("long").alias("pos"), "literal")


def _postings(spark, sf_dir):
    p = whole_passages(spark, sf_dir)
    return p.select(F.col("document_id").alias("passage_id"), F.explode(T.passage_literals(F.col("title"), F.col("source_uri"), F.col("body_text"))).alias("x")).select("passage_id", "x.literal", "x.field")


@query(f"WITH {_D}, {_LITS} SELECT doc_id AS passage_id, x.literal AS literal, x.field AS field FROM pl, unnest(p) AS u(x)")
def passage_literal_postings(spark, sf_dir):
    """Postings of title, URI and body, 64 a passage."""
    return _postings(spark, sf_dir)


@query(
    f"WITH {_D}, {_LITS}, post AS (SELECT doc_id AS passage_id, x.literal AS literal FROM pl, unnest(p) AS u(x)), atoms(query_id, atom) AS (VALUES ('a', '1.txt'), ('a', 'repo://src0/0.txt'), ('b', '2.0.'), ('b', '7.txt'), ('c', 'mail7.example.com')), "
    "m AS (SELECT DISTINCT query_id, passage_id, literal FROM post JOIN atoms ON literal = atom) "
    "SELECT query_id, passage_id, count(*) AS matched, sum(length(literal))::BIGINT AS matched_bytes, max(length(literal))::INTEGER AS longest FROM m GROUP BY ALL"
)
def literal_lookup(spark, sf_dir):
    """Postings that equal atoms, counted once a literal."""
    rows = [("a", "1.txt"), ("a", "repo://src0/0.txt"), ("b", "2.0."), ("b", "7.txt"), ("c", "mail7.example.com")]
    atoms = spark.createDataFrame([(q, a, len(a)) for q, a in rows], "query_id string, atom string, size int")
    found = retrieval.literal_candidates(_postings(spark, sf_dir).select("passage_id", "literal"), atoms)
    return found.select("query_id", "passage_id", "matched", "matched_bytes", "longest")


_STATS = f"tok AS (SELECT doc_id, {_TOK.format('title')} AS a, {_TOK.format('uri')} AS b, {_TOK.format('body')} AS c FROM d), len AS (SELECT *, len(a) + len(b) + len(c) AS n FROM tok)"


@query(f"WITH {_D}, {_STATS} SELECT count(*) AS n, round(avg(n), 6) AS avg_len FROM len")
def corpus_statistics(spark, sf_dir):
    """Rows and mean token count."""
    s = retrieval.corpus_stats(retrieval.index_fields(whole_passages(spark, sf_dir)))
    return s.select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {_D}, {_STATS}, t AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(a, b), c))) AS term FROM len) SELECT term, count(*) AS df FROM t GROUP BY 1")
def document_frequencies(spark, sf_dir):
    """Documents that hold each token."""
    x = retrieval.index_fields(whole_passages(spark, sf_dir))
    return x.select(F.explode(F.array_distinct(F.concat("tok_title", "tok_uri", "tok_body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _term_rows() -> str:
    return ", ".join(f"('{k}', {i}, '{T.fold_token(t)[0]}')" for k, q in SEARCHES.items() for i, t in enumerate(T.lexical_terms(q) or []))


_BM25 = f"""WITH {_D}, {_STATS}, q(query_id, pos, term) AS (VALUES {_term_rows()}),
s AS (SELECT count(*) AS n, avg(n) AS avgl FROM len),
f AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(list_concat(list_concat(a, b), c)) AS term FROM len) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, s),
c AS (SELECT query_id, doc_id, count(*) AS k, -sum(idf * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / (SELECT avgl FROM s))))) AS score FROM q JOIN f USING (term) JOIN idf USING (term) JOIN len USING (doc_id) GROUP BY ALL),
need AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1),
lex AS (SELECT query_id, source AS source_id, doc_id AS document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), source, doc_id) AS rank FROM c JOIN need USING (query_id, k) JOIN d USING (doc_id))"""


def _lexical(spark, sf_dir, k):
    """Ranks by scores rounded to nine digits, so that the last bits of a sum decide nothing."""
    scored = retrieval.bm25_scores(retrieval.index_fields(whole_passages(spark, sf_dir)), SEARCHES).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", *retrieval.IDENTITY))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


@query(_BM25 + " SELECT query_id, rank, source_id, document_id, round(score, 9) AS score FROM lex WHERE rank <= 10")
def search_lexical_topk(spark, sf_dir):
    """F2-F4, H2s: the ten best passages of each query by BM25."""
    return _lexical(spark, sf_dir, formats.RESULTS_DEFAULT).select("query_id", F.col("rank").cast("long").alias("rank"), "source_id", "document_id", "score")


@query(_BM25 + " SELECT query_id, rank - 10 AS place, document_id FROM lex WHERE rank > 10 AND rank <= 15")
def lexical_page(spark, sf_dir):
    """F11, H3s: the third page of five."""
    return _lexical(spark, sf_dir, 15).where("rank > 10").select("query_id", (F.col("rank") - 10).cast("long").alias("place"), "document_id")


def _atoms() -> list[tuple[str, str, bool]]:
    return [(k, a, kind == "quoted" and not T.phrase_quote(a)) for k, q in SEARCHES.items() for a, kind in T.parse_query(q).atoms]


_EXACT = f"""a(query_id, atom, raw) AS (VALUES {", ".join(f"('{k}', '{a}', {raw})" for k, a, raw in _atoms())}),
m AS (SELECT query_id, source, doc_id, count(*) AS matched_atoms, sum(strlen(atom)) AS matched_bytes, max(strlen(atom)) AS longest_atom, bool_or(raw) AS fallback
      FROM d JOIN a ON contains(title, atom) OR contains(uri, atom) OR contains(body, atom) GROUP BY ALL),
ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched_atoms DESC, matched_bytes DESC, longest_atom DESC, source, doc_id) AS rank FROM m)"""


@query(f"WITH {_D}, {_EXACT} SELECT query_id, rank, doc_id AS document_id, matched_atoms::BIGINT AS matched_atoms, matched_bytes::BIGINT AS matched_bytes, longest_atom::BIGINT AS longest_atom, fallback FROM ex WHERE rank <= 500")
def search_exact(spark, sf_dir):
    """Byte-exact matches of the atoms, ranked."""
    e = retrieval.exact_top(whole_passages(spark, sf_dir), SEARCHES)
    long = lambda *c: [F.col(x).cast("long").alias(x) for x in c]
    return e.select("query_id", *long("rank"), "document_id", *long("matched_atoms", "matched_bytes", "longest_atom"), "fallback")


@query(
    f"WITH {_D}, {_STATS}, w AS (SELECT doc_id, unnest(range(1, len(c))) AS i, c FROM len) SELECT doc_id AS document_id, count(*) AS n FROM w WHERE c[i] = 'in' AND c[i + 1] = 'the' GROUP BY 1"
)
def phrase_positions(spark, sf_dir):
    """adjacent tokens of a phrase in a column, in rows that hold both tokens."""
    p = whole_passages(spark, sf_dir)
    low = F.lower("body_text")
    x = retrieval.index_fields(p.where(F.contains(low, F.lit("in")) & F.contains(low, F.lit("the"))))
    both = x.where(F.array_contains("tok_body", "in") & F.array_contains("tok_body", "the"))
    return both.select("document_id", retrieval.phrase_count(["in", "the"], ["tok_body"]).cast("long").alias("n")).where("n > 0")


_FUSED = _BM25 + f""", {_EXACT},
fu AS (SELECT coalesce(e.query_id, l.query_id) AS query_id, coalesce(e.doc_id, l.document_id) AS document_id, coalesce(e.source, l.source_id) AS source_id, coalesce(matched_bytes, 0) AS mb,
       coalesce((3000000000000 + (60 + e.rank)) // (2 * (60 + e.rank)), 0) + coalesce((1000000000000 + (60 + l.rank) // 2) // (60 + l.rank), 0) AS units
       FROM (SELECT * FROM ex WHERE rank <= 500) e FULL JOIN (SELECT * FROM lex WHERE rank <= 500) l ON e.query_id = l.query_id AND e.doc_id = l.document_id),
ru AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, mb DESC, source_id, document_id) AS fused_rank FROM fu)"""


def _fused(spark, sf_dir):
    return retrieval.fuse(retrieval.exact_top(whole_passages(spark, sf_dir), SEARCHES), _lexical(spark, sf_dir, formats.CANDIDATES_MAX))


@query(_FUSED + " SELECT query_id, fused_rank, document_id, units::BIGINT AS units FROM ru")
def rank_fusion(spark, sf_dir):
    """Both lists fused in integer units."""
    return _fused(spark, sf_dir).select("query_id", F.col("fused_rank").cast("long").alias("fused_rank"), "document_id", "units")


@query(
    _FUSED + ", k AS (SELECT query_id, fused_rank, document_id, min(fused_rank) OVER (PARTITION BY query_id, sha256(body)) AS first FROM ru JOIN d ON d.doc_id = ru.document_id) "
    "SELECT query_id, fused_rank, document_id, CASE WHEN first < fused_rank THEN first END AS duplicate_of FROM k"
)
def fused_duplicates(spark, sf_dir):
    """greedy dedupe of the fused hits; whole texts can only be duplicates by content."""
    rows = _fused(spark, sf_dir).join(whole_passages(spark, sf_dir).select(*retrieval.IDENTITY, "end_byte", "content_sha256"), retrieval.IDENTITY)
    return retrieval.greedy_dedupe(rows).select("query_id", F.col("fused_rank").cast("long").alias("fused_rank"), "document_id", "duplicate_of")


@query(
    "WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 60000000 AS s, epoch_us(ts) // 60000000 + 10 + event_id % 20 AS e FROM events) "
    "SELECT a.event_id AS left_id, b.event_id AS right_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE 2 * (least(a.e, b.e) - greatest(a.s, b.s)) >= least(a.e - a.s, b.e - b.s)"
)
def half_overlaps(spark, sf_dir):
    """Pairs of spans of one user that overlap by half the shorter."""
    minute = F.expr("unix_micros(cast(ts as timestamp)) div 60000000")
    spans = load(spark, sf_dir, "events").select("event_id", "user_id", minute.alias("s")).withColumn("e", F.col("s") + 10 + F.col("event_id") % 20)
    return retrieval.overlapping_spans(spans, "user_id", "event_id", "s", "e", 30).select(F.col("left_id"), F.col("right_id"))


_DEPTHS = _BM25 + f""", {_EXACT}, dep AS (SELECT unnest(range(50, 501, 50)) AS depth),
fu AS (SELECT coalesce(e.depth, l.depth) AS depth, coalesce(e.query_id, l.query_id) AS query_id, coalesce(e.doc_id, l.document_id) AS document_id, coalesce(e.source, l.source_id) AS source_id, coalesce(matched_bytes, 0) AS mb,
       coalesce((3000000000000 + (60 + e.rank)) // (2 * (60 + e.rank)), 0) + coalesce((1000000000000 + (60 + l.rank) // 2) // (60 + l.rank), 0) AS units
       FROM (SELECT * FROM ex, dep WHERE rank <= depth) e FULL JOIN (SELECT * FROM lex, dep WHERE rank <= depth) l ON e.query_id = l.query_id AND e.doc_id = l.document_id AND e.depth = l.depth),
ru AS (SELECT fu.*, sha256(body) AS h, row_number() OVER (PARTITION BY depth, query_id ORDER BY units DESC, mb DESC, source_id, document_id) AS fused_rank FROM fu JOIN d ON d.doc_id = fu.document_id),
fi AS (SELECT *, min(fused_rank) OVER (PARTITION BY depth, query_id, h) AS first FROM ru),
hi AS (SELECT *, row_number() OVER (PARTITION BY depth, query_id ORDER BY fused_rank) AS hit FROM fi WHERE first = fused_rank),
st AS (SELECT query_id, coalesce(min(depth) FILTER (hit >= 10), 500) AS depth FROM hi GROUP BY 1)"""


def _raw_rows() -> str:
    raw = {k: any(kind == "quoted" and not T.phrase_quote(a) for a, kind in T.parse_query(q).atoms) for k, q in SEARCHES.items()}
    return ", ".join(f"('{k}', {v})" for k, v in raw.items())


def _hits(spark, sf_dir):
    p = whole_passages(spark, sf_dir)
    scored = retrieval.bm25_scores(retrieval.index_fields(p), SEARCHES).withColumn("score", F.round("score", 9))
    return retrieval.hits(retrieval.exact_matches(p, SEARCHES), scored, p)


@query(_DEPTHS + " SELECT query_id, hit, document_id, units::BIGINT AS units FROM hi JOIN st USING (query_id, depth) WHERE hit <= 10")
def search_hits(spark, sf_dir):
    """F11, F12, F15, H2s: the ten hits of each query, its lists read in steps of 50 until there are ten."""
    return _hits(spark, sf_dir).where("hit is not null").select("query_id", "hit", "document_id", "units")


@query(
    _DEPTHS + ", p AS (SELECT query_id, hi.fused_rank FROM hi JOIN st USING (query_id, depth) WHERE hit <= 10) SELECT query_id, fi.document_id, fi.first AS duplicate_of, 'same_content' AS reason FROM fi JOIN st USING (query_id, depth) "
    "JOIN p ON p.query_id = fi.query_id AND p.fused_rank = fi.first WHERE fi.fused_rank > fi.first".replace("SELECT query_id, fi.document_id", "SELECT fi.query_id, fi.document_id")
)
def search_duplicates(spark, sf_dir):
    """the duplicates of the hits, with the rank of the hit that each repeats."""
    return _hits(spark, sf_dir).where("hit is null").select("query_id", "document_id", "duplicate_of", "reason")


@query(
    _DEPTHS + ", x AS (SELECT query_id, rank AS r, 'exact' AS retriever FROM ex UNION ALL SELECT query_id, rank, 'lexical' FROM lex), "
    "n AS (SELECT query_id, coalesce(max(r) FILTER (retriever = 'exact'), 0) AS e, coalesce(max(r) FILTER (retriever = 'lexical'), 0) AS l FROM x GROUP BY 1), mh AS (SELECT query_id, max(hit) AS hits FROM hi JOIN st USING (query_id, depth) GROUP BY 1), "
    f"asked(query_id, raw) AS (VALUES {_raw_rows()}) "
    "SELECT query_id, 'auto' AS requested_mode, 'lexical' AS effective_mode, CASE WHEN raw THEN 'exact,exact_fallback,lexical' ELSE 'exact,lexical' END AS retrievers, "
    "CASE WHEN hits >= 10 THEN 'limit_reached' WHEN greatest(e, l) > 500 THEN 'work_budget_exhausted' ELSE 'unique_exhausted' END AS stop_reason, least(coalesce(e, 0), coalesce(depth, 500))::BIGINT AS examined_exact, least(coalesce(l, 0), coalesce(depth, 500))::BIGINT AS examined_lexical "
    "FROM asked LEFT JOIN n USING (query_id) LEFT JOIN mh USING (query_id) LEFT JOIN st USING (query_id)"
)
def search_reports(spark, sf_dir):
    """modes, retrievers, why each search stopped and how deep."""
    r = retrieval.report(_hits(spark, sf_dir), SEARCHES)
    return r.select("query_id", "requested_mode", "effective_mode", F.array_join("retrievers", ",").alias("retrievers"), "stop_reason", *[F.col(c).cast("long").alias(c) for c in ("examined_exact", "examined_lexical")])


@query(
    _DEPTHS + ", w AS (SELECT query_id, hit, document_id FROM hi JOIN st USING (query_id, depth) WHERE hit <= 10), z AS (SELECT w.query_id, w.hit, 'lexical' AS retriever, lex.rank, lex.score AS s FROM w JOIN st USING (query_id) JOIN lex ON lex.query_id = w.query_id AND lex.document_id = w.document_id AND lex.rank <= depth "
    "UNION ALL SELECT w.query_id, w.hit, CASE WHEN fallback THEN 'exact_fallback' ELSE 'exact' END, ex.rank, NULL FROM w JOIN st USING (query_id) JOIN ex ON ex.query_id = w.query_id AND ex.doc_id = w.document_id AND ex.rank <= depth) "
    "SELECT query_id, hit, retriever, rank, CASE WHEN retriever = 'lexical' THEN (1000000000000 + (60 + rank) // 2) // (60 + rank) ELSE (3000000000000 + (60 + rank)) // (2 * (60 + rank)) END::BIGINT AS contribution_units, round(s, 9) AS backend_score FROM z"
)
def search_explained(spark, sf_dir):
    """F16: the lists that each hit is in, with its rank, contribution and score."""
    each = _hits(spark, sf_dir).where("hit is not null").select("query_id", "hit", F.inline("lists"))
    return each.select("query_id", "hit", "retriever", F.col("rank").cast("long").alias("rank"), "contribution_units", "backend_score")


#: Queries whose exact lists take turns: identifiers, phrases and the scan, with and without raw quotes.
PAGED = {"b1": '"+=+"', "b2": 'mail7.example.com "the"', "b3": '"in the" "license"', "b4": "repo://src1/1.txt 1.txt 7.txt", "b5": '"th" src3/13.txt "e, "', "b6": '"zzqx"', "b7": '"or" "se"'}


def _lists_sql() -> str:
    """Candidate lists of PAGED: src(query_id, k, pos, doc), asked(query_id, n, raw) and hit(query_id, doc)."""
    plans = {k: budget.lists_of(q) for k, q in PAGED.items()}
    names = ", ".join(f"('{k}', '{t}')" for k, p in plans.items() for t in p.identifiers)
    phrases = ", ".join(f"('{k}', {p.phrase(i)}, {list(t)!r})" for k, p in plans.items() for i, t in enumerate(p.phrases))
    asked = ", ".join(f"('{k}', {p.count}, {p.raw})" for k, p in plans.items())
    atoms = ", ".join(f"('{k}', '{t}')" for k, q in PAGED.items() for t, _ in T.parse_query(q).atoms)
    return f"""{_D}, {_LITS}, {_STATS}, asked(query_id, n, raw) AS (VALUES {asked}), atom(query_id, atom) AS (VALUES {atoms}),
hit AS MATERIALIZED (SELECT DISTINCT query_id, doc_id AS doc FROM d JOIN atom ON contains(title, atom) OR contains(uri, atom) OR contains(body, atom)),
name(query_id, literal) AS (VALUES {names}), lit AS (SELECT DISTINCT doc_id, x.literal AS literal FROM (SELECT doc_id, unnest(p) AS x FROM pl)),
one AS (SELECT query_id, 0 AS k, doc_id, count(*) AS a, sum(strlen(literal)) AS b, max(strlen(literal)) AS c FROM name JOIN lit USING (literal) GROUP BY ALL),
phrase(query_id, k, toks) AS (VALUES {phrases}),
each AS (SELECT query_id, k, doc_id, n, sum(CASE WHEN t[i:i + len(toks) - 1] = toks THEN 1 ELSE 0 END) AS f FROM phrase, (SELECT doc_id, n, a AS t FROM len UNION ALL SELECT doc_id, n, b FROM len UNION ALL SELECT doc_id, n, c FROM len) AS z, unnest(range(1, len(t) + 1)) AS u(i) WHERE t[i] = toks[1] GROUP BY ALL HAVING f > 0),
w AS (SELECT query_id, k, ln((total - df + 0.5) / (df + 0.5)) AS raw_idf FROM (SELECT query_id, k, count(*) AS df FROM each GROUP BY ALL), (SELECT count(*) AS total FROM d)),
two AS (SELECT query_id, k, doc_id, round(-CASE WHEN raw_idf <= 0 THEN 1e-6 ELSE raw_idf END * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM len)))), 9) AS s FROM each JOIN w USING (query_id, k)),
every AS (SELECT query_id, k, row_number() OVER (PARTITION BY query_id, k ORDER BY a DESC, b DESC, c DESC, source, doc_id) AS pos, doc_id AS doc FROM one JOIN d USING (doc_id)
  UNION ALL SELECT query_id, k, row_number() OVER (PARTITION BY query_id, k ORDER BY s, source, doc_id), doc_id FROM two JOIN d USING (doc_id)
  UNION ALL SELECT query_id, n - 1, p, doc_id FROM asked, (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS p FROM d)),
src AS MATERIALIZED (SELECT * FROM every WHERE pos <= 500)"""


#: A step of a round visits one list; a round begins with step -1 and ends with step n.
@query(
    "WITH RECURSIVE " + _lists_sql() + """, slot AS (SELECT query_id, n, unnest(range(n)) AS k FROM asked),
docs AS MATERIALIZED (SELECT query_id, n, list(coalesce(l, []) ORDER BY k) AS docs FROM slot LEFT JOIN (SELECT query_id, k, list(doc ORDER BY pos) AS l FROM src GROUP BY ALL) USING (query_id, k) GROUP BY ALL),
m AS MATERIALIZED (SELECT query_id, list(doc) AS m FROM hit SEMI JOIN src USING (query_id, doc) GROUP BY 1),
base AS MATERIALIZED (SELECT query_id, n, docs, coalesce(m, []) AS m FROM docs LEFT JOIN m USING (query_id)),
st(query_id, it, wanted, turn, step, share, pt, ended, seen, found, read, got, scanned) AS (
  SELECT query_id, 0, 50, 0, -1, 0, list_transform(docs, lambda x: 0), list_transform(docs, lambda x: false), []::BIGINT[], 0, 0, 0, 0 FROM base
  UNION ALL
  SELECT query_id, it + 1,
    CASE WHEN act = 'more' THEN wanted + 50 ELSE wanted END, CASE WHEN act = 'end' THEN (turn + 1) % n ELSE turn END,
    CASE act WHEN 'begin' THEN 0 WHEN 'more' THEN -1 WHEN 'end' THEN -1 ELSE step + 1 END,
    CASE WHEN act = 'begin' THEN (wanted - found + open - 1) // open ELSE share END,
    CASE WHEN act = 'page' THEN list_transform(pt, lambda x, i: CASE WHEN i = j THEN x + len(page) ELSE x END) ELSE pt END,
    CASE WHEN act = 'page' THEN list_transform(ended, lambda x, i: CASE WHEN i = j THEN len(page) < size ELSE x END) ELSE ended END,
    CASE WHEN act = 'page' THEN list_concat(seen, fresh) ELSE seen END,
    CASE WHEN act = 'page' THEN found + len(list_filter(fresh, lambda x: list_contains(m, x))) ELSE found END,
    CASE WHEN act = 'page' THEN read + len(page) ELSE read END,
    CASE WHEN act = 'page' THEN got + len(page) WHEN act = 'begin' THEN 0 ELSE got END,
    CASE WHEN act = 'page' AND j = n THEN scanned + len(page) ELSE scanned END
  FROM (SELECT *, list_filter(page, lambda x: NOT list_contains(seen, x)) AS fresh FROM (
    SELECT *, docs[j][pt[j] + 1:pt[j] + size] AS page FROM (
      SELECT *, least(share, 500 - read) AS size, (turn + greatest(step, 0)) % n + 1 AS j, len(list_filter(ended, lambda x: NOT x)) AS open,
        CASE WHEN step = -1 AND found < wanted AND read < 500 AND list_contains(ended, false) THEN 'begin'
             WHEN step = n AND got > 0 THEN 'end'
             WHEN step IN (-1, n) THEN CASE WHEN read < 500 AND list_contains(ended, false) AND wanted < 500 THEN 'more' ELSE 'stop' END
             WHEN ended[(turn + step) % n + 1] OR read >= 500 THEN 'skip' ELSE 'page' END AS act
      FROM st JOIN base USING (query_id)))) WHERE act <> 'stop')
SELECT query_id, read::BIGINT AS read, found::BIGINT AS found, CASE WHEN raw THEN scanned ELSE 0 END::BIGINT AS scanned, NOT list_contains(ended, false) AS exhausted
FROM (SELECT * FROM st QUALIFY it = max(it) OVER (PARTITION BY query_id)) JOIN asked USING (query_id)"""
)
def search_budgeted(spark, sf_dir):
    """how far each query's candidate lists are read in turns, within one budget of 500, and what they hold."""
    return budget.reads(budget.passage_lists(whole_passages(spark, sf_dir), PAGED, 9), PAGED)


@query("SELECT doc_id FROM documents WHERE lang IS NULL OR NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def missing_targets(spark, sf_dir):
    """Rows without the row they refer to (documents without a label, or with a null key)."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").isNotNull(), F.col("doc_id")).alias("label_id"))
    return scopes.missing_targets(d, load(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id")), "label_id").select("doc_id")


@query("SELECT sum(strlen(source || '/' || doc_id || '.txt'))::BIGINT AS key_bytes, sum(strlen(source || '/' || doc_id || '.txt')) > 10000 AS over_budget FROM documents")
def key_budget(spark, sf_dir):
    """The bytes of all keys against a budget."""
    key = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return scopes.key_budget(load(spark, sf_dir, "documents").select(key.alias("k")), "k", 10_000)


@query("SELECT max(o_orderkey) AS last, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def generation_counts(spark, sf_dir):
    """The largest id and the number of committed generations (filled orders)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "committed").otherwise("building").alias("state"))
    return scopes.generation_counts(o)


@query("SELECT n_name, coalesce(c, 0) AS documents, coalesce(s, 0) AS errors FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal >= 0 GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def source_counts(spark, sf_dir):
    """Counts per source from two aggregates (customers in credit as active documents, suppliers as errors)."""
    sources = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), "n_name")
    heads = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), (F.col("c_acctbal") >= 0).alias("active"))
    return scopes.source_rows(sources, heads, load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source_id"))).select("n_name", "documents", "errors")


_STATES = "WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'metadata_unchanged' WHEN 'click' THEN 'metadata_changed' WHEN 'purchase' THEN 'missing' WHEN 'refund' THEN 'blocked' ELSE 'unknown' END AS state, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS m, event_id % 2 = 0 AS same, event_id % 5 <> 0 AS has FROM events) "


@query(
    _STATES + "SELECT event_id, CASE WHEN m THEN 'content_unchanged' WHEN NOT m THEN 'changed_since_ingest' WHEN state = 'metadata_unchanged' THEN state WHEN state = 'metadata_changed' THEN 'changed_since_ingest' WHEN state = 'missing' THEN 'missing_since_ingest' ELSE 'unverifiable' END AS source_state, "
    "CASE WHEN m THEN 'unchanged' WHEN NOT m THEN 'changed' WHEN state IN ('missing', 'blocked') THEN state ELSE 'unverifiable' END AS hash_verification, "
    "CASE WHEN m AND has THEN CASE WHEN same THEN 'unchanged' ELSE 'changed' END WHEN NOT m THEN 'changed' WHEN m IS NULL AND state IN ('missing', 'blocked') THEN state ELSE 'unverifiable' END AS cited_verification FROM e"
)
def drift_states(spark, sf_dir):
    """What drift observations say of sources (event types as observations)."""
    e = load(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", "metadata_unchanged").when(F.col("event_type") == "click", "metadata_changed").when(F.col("event_type") == "purchase", "missing").when(F.col("event_type") == "refund", "blocked").otherwise("unknown")
    matches = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    current = F.when(F.col("event_id") % 5 != 0, F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    return e.select("event_id", evidence.source_state(state, matches).alias("source_state"), evidence.hash_verification(state, matches).alias("hash_verification"), evidence.cited_verification(F.lit("a"), current, state, matches).alias("cited_verification"))


# --- hashes and identities ---


@query("SELECT doc_id, sha256(coalesce(text, '')) AS body_sha256 FROM documents")
def body_hashes(spark, sf_dir):
    """Body hashes."""
    return load(spark, sf_dir, "documents").select("doc_id", hashing.body_sha256(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("body_sha256"))


_FRAME = "unhex(lpad(hex(octet_length({0}::BLOB)), 16, '0'))"


@query(
    f"WITH {_D}, r AS (SELECT doc_id, encode(body) AS b, encode(uri) AS u, encode(title) AS t, encode('{{}}') AS m, encode('null') AS z FROM d) "
    "SELECT doc_id, sha256(unhex('" + formats.SNAPSHOT_DOMAIN.hex() + "')" + "".join(f" || unhex('0{k}') || unhex(printf('%016x', octet_length({c}))) || {c}" for k, c in enumerate("butmz", 1)) + ") AS revision_sha256 FROM r"
)
def revision_hashes(spark, sf_dir):
    """Revision hashes of documents without a timestamp."""
    p = whole_passages(spark, sf_dir)
    return p.select(F.col("document_id").alias("doc_id"), hashing.revision_sha256(F.encode("body_text", "UTF-8"), F.col("source_uri"), F.col("title"), F.lit("{}"), F.lit(None).cast("string")).alias("revision_sha256"))


@query(f"WITH {_D} SELECT doc_id, '{formats.CITATION_PREFIX}i/' || source || '/' || doc_id || '?rev=' || sha256(body) || '#bytes=0-' || strlen(body) AS citation FROM d")
def citations(spark, sf_dir):
    """Rendered citations."""
    p = whole_passages(spark, sf_dir)
    return p.select(F.col("document_id").alias("doc_id"), hashing.citation(F.lit("i"), F.col("source_id"), F.col("document_id").cast("string"), F.col("content_sha256"), F.col("start_byte"), F.col("end_byte")).alias("citation"))


@query("SELECT sha256(coalesce(text, '')) AS body_sha256, count(*) AS documents, min(doc_id) AS first_doc, max(strlen(coalesce(text, '')))::BIGINT AS body_bytes FROM documents GROUP BY 1")
def content_blobs(spark, sf_dir):
    """B1: distinct bodies by content."""
    return snapshot.content_blobs(whole_passages(spark, sf_dir), "content_sha256", "document_id", "end_byte")


@query(
    "SELECT sha256(string_agg(p || b, '' ORDER BY p || b)) AS digest FROM (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS b FROM (SELECT sha256(doc_id || chr(31) || coalesce(source, chr(0))) AS h FROM documents) GROUP BY 1)"
)
def table_digest(spark, sf_dir):
    """One digest of a table."""
    return audit.ordered_digest(load(spark, sf_dir, "documents"), "doc_id", "source")


# --- snapshots: the prior state lacks es, has other bodies for de, other keys for fr, and has keys of dropped pages ---

_OLD_KEY = "CASE WHEN lang = 'fr' THEN 'old/' ELSE '' END || source || '/' || doc_id || '.txt'"
_PRIOR = f"""{_D}, cur AS (SELECT source || '/' || doc_id || '.txt' AS key, sha256(body) AS hash, strlen(body) AS n, lang, doc_id FROM d),
ready AS (SELECT * FROM cur WHERE lang IS DISTINCT FROM 'it' AND strlen(key) % 10 <> 1),
fail AS (SELECT key FROM cur WHERE lang IS DISTINCT FROM 'it' AND strlen(key) % 10 = 1),
heads AS (SELECT {_OLD_KEY} AS key, CASE WHEN lang = 'de' THEN sha256(body || 'x') ELSE sha256(body) END AS hash, doc_id AS id, strlen(body) % 50 <> 0 AS active FROM d WHERE lang <> 'es'
          UNION ALL SELECT 'pages/' || page_id, sha256(url), -page_id - 1, true FROM pages),
obs AS (SELECT key FROM ready UNION SELECT key FROM fail),
unseen AS (SELECT * FROM heads WHERE active AND key NOT IN (SELECT key FROM obs)),
nw AS (SELECT hash, min(key) AS new_key FROM ready WHERE key NOT IN (SELECT key FROM heads) GROUP BY 1 HAVING count(*) = 1),
od AS (SELECT hash, min(key) AS old_key, min(id) AS id FROM unseen GROUP BY 1 HAVING count(*) = 1),
ren AS (SELECT new_key, old_key, id FROM nw JOIN od USING (hash)),
fate AS (SELECT r.key, r.n, CASE WHEN ren.id IS NOT NULL THEN 'renamed' WHEN h.key IS NULL THEN 'new' WHEN NOT h.active THEN 'reactivated' WHEN h.hash = r.hash THEN 'unchanged' ELSE 'changed' END AS status
         FROM ready r LEFT JOIN heads h USING (key) LEFT JOIN ren ON ren.new_key = r.key
         UNION ALL SELECT key, 0, 'tombstoned' FROM unseen WHERE key NOT IN (SELECT old_key FROM ren)
         UNION ALL SELECT f.key, 0, CASE WHEN h.key IS NOT NULL THEN 'carried' ELSE 'failed' END FROM fail f LEFT JOIN (SELECT * FROM heads WHERE active) h USING (key))"""


def _prior(spark, sf_dir):
    """(heads, ready, failures) of the snapshot queries, over the whole tables."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("body"))
    key = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    cur = d.withColumn("key", key).where(~F.col("lang").eqNullSafe("it"))
    bad = F.octet_length("key") % 10 == 1
    ready = cur.where(~bad).select(F.col("key").alias("connector_key"), F.sha2("body", 256).alias("revision_sha256"), F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").alias("body_len"))
    failures = cur.where(bad).select(F.col("key").alias("connector_key"), F.lit("io").alias("code"), F.lit("unreadable").alias("detail"))
    old = F.when(F.col("lang") == "fr", F.concat(F.lit("old/"), key)).otherwise(key)
    digest = F.sha2(F.when(F.col("lang") == "de", F.concat("body", F.lit("x"))).otherwise(F.col("body")), 256)
    heads = d.where("lang <> 'es'").select(old.alias("connector_key"), digest.alias("revision_sha256"), digest.alias("body_sha256"), F.col("doc_id").alias("document_id"), (F.octet_length("body") % 50 != 0).alias("active"))
    p = load(spark, sf_dir, "pages")
    gone = p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("connector_key"), F.sha2("url", 256).alias("revision_sha256"), F.sha2("url", 256).alias("body_sha256"), (-F.col("page_id") - 1).alias("document_id"), F.lit(True).alias("active"))
    return heads.unionByName(gone), ready, failures


@query(f"WITH {_PRIOR} SELECT new_key, old_key, id AS document_id FROM ren")
def rename_detection(spark, sf_dir):
    """Renames by bodies that are unique on both sides."""
    return snapshot.renames(*_prior(spark, sf_dir))


@query(f"WITH {_PRIOR} SELECT key AS connector_key, status FROM fate")
def snapshot_fates(spark, sf_dir):
    """What a snapshot does to each key."""
    return snapshot.classify(*_prior(spark, sf_dir)).select("connector_key", "status")


@query(
    f"WITH {_PRIOR}, c AS (SELECT count(*) FILTER (status = 'new') AS new_documents, count(*) FILTER (status IN ('new', 'changed', 'renamed', 'reactivated')) AS changed_documents, count(*) FILTER (status = 'renamed') AS renamed_documents, "
    "count(*) FILTER (status = 'unchanged') AS unchanged_documents, count(*) FILTER (status = 'tombstoned') AS tombstoned_documents, count(*) FILTER (status = 'carried') AS carried_forward_documents, "
    "count(*) FILTER (status IN ('carried', 'failed')) AS failed_documents, count(*) FILTER (status NOT IN ('tombstoned', 'failed')) AS projected_active_documents, "
    "sum(CASE WHEN status IN ('new', 'changed', 'renamed', 'reactivated') THEN 6 * n + 8192 ELSE 0 END) AS cb FROM fate), p AS (SELECT count(*) FILTER (active) AS prior_active_documents FROM heads), "
    "x AS (SELECT coalesce(sum(strlen(key) + 2 + 10 + 1024), 0) AS fb FROM fail) "
    "SELECT c.* EXCLUDE (cb), prior_active_documents, changed_documents <> 0 OR tombstoned_documents <> 0 AS would_create_generation, prior_active_documents <> 0 AND projected_active_documents = 0 AS requires_empty_confirmation, "
    "tombstoned_documents <> 0 AND (tombstoned_documents > 1000 OR 4 * tombstoned_documents > prior_active_documents) AS requires_mass_delete_confirmation, (65536 + cb + 8192 * tombstoned_documents + fb)::BIGINT AS estimated_write_bytes FROM c, p, x"
)
def snapshot_plan(spark, sf_dir):
    """A plan's counts, guards and write estimate."""
    return snapshot.plan_counts(*_prior(spark, sf_dir))


# --- audits over a change log made of events: a document is a user, a version an event type ---

_LOG = """ev AS (SELECT user_id AS document_id, event_id AS generation_id, event_type AS next, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events),
ch AS (SELECT document_id, generation_id, CASE WHEN generation_id % 97 = 0 THEN 'torn' ELSE was END AS prior, next, CASE WHEN next = 'refund' THEN 'tombstoned' ELSE 'active' END AS next_state, was FROM ev)"""


def _changes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    prior = F.when(F.col("event_id") % 97 == 0, "torn").otherwise(F.lag("event_type").over(w))
    state = F.when(F.col("event_type") == "refund", "tombstoned").otherwise("active")
    return e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("generation_id"), prior.alias("prior"), F.col("event_type").alias("next"), state.alias("next_state"))


@query(
    f"WITH {_LOG}, v AS (SELECT document_id, generation_id, CASE WHEN prior IS DISTINCT FROM was THEN 'prior_mismatch' WHEN prior IS NOT DISTINCT FROM next THEN 'no_change' WHEN next_state = 'tombstoned' AND prior IS NULL THEN 'tombstone_without_head' END AS code FROM ch) SELECT * FROM v WHERE code IS NOT NULL"
)
def replay_audit(spark, sf_dir):
    """Changes that do not follow from the ones before."""
    return audit.replay_violations(_changes(spark, sf_dir))


@query(f"WITH {_LOG} SELECT document_id, arg_max(next, generation_id) AS next, arg_max(next_state, generation_id) AS next_state, max(generation_id) AS generation_id FROM ch GROUP BY 1")
def replayed_heads(spark, sf_dir):
    """The last change of each document."""
    return audit.replayed_heads(_changes(spark, sf_dir))


@query(f"WITH {_LOG}, h AS (SELECT document_id, arg_max(next, generation_id) AS next, max(generation_id) AS generation_id FROM ch GROUP BY 1), e AS (SELECT document_id, min(next) AS next, max(generation_id) AS generation_id FROM ch GROUP BY 1) "
       "SELECT *, 'stored' AS side FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM e) UNION ALL SELECT *, 'expected' AS side FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM h)")  # fmt: skip
def parity_audit(spark, sf_dir):
    """Rows that one of two relations lacks, as multisets."""
    c = _changes(spark, sf_dir)
    e = c.groupBy("document_id").agg(F.min("next").alias("next"), F.max("generation_id").alias("generation_id"))
    return audit.parity(audit.replayed_heads(c).select("document_id", "next", "generation_id"), e)


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def empty_generations(spark, sf_dir):
    """Committed generations without a change (customers without a filled order)."""
    g = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("committed").alias("state"))
    c = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("generation_id"))
    return audit.empty_generations(g, c).select("id")


@query("SELECT count(*) AS blobs, sum(n)::BIGINT AS body_bytes, max(n)::BIGINT AS max_body FROM (SELECT DISTINCT sha256(coalesce(text, '')), strlen(coalesce(text, '')) AS n FROM documents)")
def scan_statistics(spark, sf_dir):
    """Statistics of a scan of the blobs."""
    b = whole_passages(spark, sf_dir).select("content_sha256", F.col("body_text").alias("body")).dropDuplicates(["content_sha256"])
    s = audit.scan_statistics(b)
    return s.select(*[F.col(c).cast("long").alias(c) for c in s.columns])


# --- scopes, counts, pages, rules ---


@query(
    "SELECT r_name AS project, count(DISTINCT n_nationkey) AS sources, count(DISTINCT c_custkey) AS documents, count(o_orderkey) AS passages FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"
)
def project_counts(spark, sf_dir):
    """Counts by project (regions as projects, nations as sources, customers as documents, orders as passages)."""
    projects = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project_id"), F.col("r_name").alias("project"))
    sources = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("project_id"), F.col("n_nationkey").alias("source_id"))
    heads = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("document_id"), F.lit(True).alias("active"))
    return scopes.project_counts(projects, sources, heads, load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id")))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = o_custkey AND r_name = 'ASIA')")
def scope_semi_join(spark, sf_dir):
    """Documents in a project's scope, and their passages."""
    sources = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("project_id"), F.col("n_nationkey").alias("source_id"))
    documents = scopes.in_scope(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), "c_custkey"), sources, "ASIA")
    return load(spark, sf_dir, "orders").join(documents, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey, n_name, r_name, o_n AS n_orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS o_n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_join_chain(spark, sf_dir):
    """Documents with their head, version and body, null where there is none (customers, nations, regions, orders)."""
    documents = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("body_id"), F.col("c_nationkey").alias("document_id"))
    heads = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document_id"), "n_name", F.col("n_regionkey").alias("version_id"))
    versions = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("version_id"), "r_name")
    blobs = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("body_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return scopes.existing_documents(documents, heads, versions, blobs).select(F.col("body_id").alias("c_custkey"), "n_name", "r_name", "n_orders")


@query("WITH r AS (SELECT conv_id, turn, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM conversations) SELECT conv_id, turn, t::BIGINT AS body_bytes FROM r WHERE t <= 2000")
def body_cap_page(spark, sf_dir):
    """Turns of a conversation until their bytes exceed a cap."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("hit"), "text")
    kept = retrieval.page(c, -1, 1_000_000, "text", 2000, keep="body_bytes")
    return kept.select(F.col("query_id").alias("conv_id"), F.col("hit").alias("turn"), "body_bytes")


@query(
    r"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || CASE page_id % 9 WHEN 0 THEN '/.env' WHEN 1 THEN '/a.md' WHEN 2 THEN '/node_modules/x.js' WHEN 3 THEN '/k.pem' WHEN 4 THEN '/.git/config' WHEN 5 THEN '/b.tar.rs' WHEN 6 THEN '/.md' WHEN 7 THEN '/out' ELSE '/c.SQL' END AS path FROM pages), "
    r"s AS (SELECT *, string_split(path, '/') AS parts FROM p), n AS (SELECT *, parts[-1] AS name, regexp_extract(parts[-1], '^.+\.([^.]*)$', 1) AS ext FROM s) "
    "SELECT page_id, CASE ext WHEN 'md' THEN 'markdown' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'sql' THEN 'sql' END AS kind, "
    "len(list_filter(parts, lambda x: starts_with(x, '.'))) > 0 OR list_has_any(parts[1:-2], ['target', 'node_modules', 'build', 'dist', 'out', 'vendor', '__pycache__', 'venv']) AS default_excluded, "
    "list_has_any(parts, ['.git', '.ssh', '.aws', '.gnupg', '.config', '.cache', '.idea', '.vscode']) OR starts_with(name, '.env.') OR name IN ('.env', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', 'credentials', 'credentials.json') OR ext IN ('pem', 'key', 'p12', 'pfx') AS sensitive FROM n"
)
def path_filters(spark, sf_dir):
    """Kinds and exclusions of paths."""
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/.env", "/a.md", "/node_modules/x.js", "/k.pem", "/.git/config", "/b.tar.rs", "/.md", "/out", "/c.SQL")]), (F.col("page_id") % 9 + 1).cast("int"))
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), tail)
    p = load(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", *[c.alias(n) for n, c in filesystem.path_rules(F.col("path")).items()])


@query("SELECT source AS source_id, count(*) AS documents, CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 'success' WHEN count(*) FILTER (toxic = 0) = 0 THEN 'failed' ELSE 'partial' END AS state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def source_states(spark, sf_dir):
    """A source's state from its accepted and failed rows (toxic labels as failures)."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    each = d.groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    return each.select("source_id", "documents", snapshot.source_state(F.col("bad"), F.col("good"), F.lit(None)).alias("state"))


@query("SELECT doc_id, source IS NULL OR strlen(source) NOT BETWEEN 1 AND 4 AS source_out_of_bounds, coalesce(strlen(text), 0) NOT BETWEEN 1 AND 1800 AS content_out_of_bounds, CASE WHEN coalesce(strlen(source), 0) BETWEEN 1 AND 4 THEN strlen(source) ELSE 0 END + CASE WHEN coalesce(strlen(text), 0) BETWEEN 1 AND 1800 THEN strlen(text) ELSE 0 END AS kept_bytes FROM documents WHERE source IS NULL OR strlen(source) NOT BETWEEN 1 AND 4 OR coalesce(strlen(text), 0) NOT BETWEEN 1 AND 1800")
def field_guards(spark, sf_dir):
    """Rows with a field out of bounds, which is blanked."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    bounds = {"source": (1, 4), "text": (1, formats.MAX_BYTES)}
    bad = scopes.field_guards(bounds)
    flagged = d.select("*", bad["source"].alias("source_out_of_bounds"), bad["text"].alias("content_out_of_bounds"))
    return scopes.passage_projection(flagged, bounds).where("passage_invalid").select("doc_id", "source_out_of_bounds", "content_out_of_bounds", F.octet_length(F.concat(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))).cast("long").alias("kept_bytes"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents")
def identity_order(spark, sf_dir):
    """A8, G1, G6, H1s: rows in identity order with ordinals from 0, ranked in spans of 1,000 ids."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id")
    return scopes.ordinals(d, "source", "doc_id", F.floor(F.col("doc_id") / 1000)).select("source", "doc_id", "ordinal")


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS covered, 0::BIGINT AS violations FROM documents WHERE strlen(coalesce(text, '')) > 0")
def chunk_coverage(spark, sf_dir):
    """Passages cover each document from its first to its last byte, without gaps, overlapping by at most 180 bytes."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"), F.lit("plain-text").alias("chunk_kind"))
    c = chunker.chunk(d, ["doc_id"])
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    bad = (F.col("start_byte") > F.coalesce(F.lag("end_byte").over(w), F.lit(0))) | (F.lag("end_byte").over(w) - F.col("start_byte") > formats.OVERLAP_BYTES) | (F.octet_length("body_text") != F.col("end_byte") - F.col("start_byte"))
    return c.withColumn("bad", F.coalesce(bad, F.lit(False))).groupBy("doc_id").agg((F.max("end_byte") - F.min("start_byte")).alias("covered"), F.count_if("bad").alias("violations"))


@query()
def chunk_passages(spark, sf_dir):
    """The passages of the corpus."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"), F.lit("plain-text").alias("chunk_kind"))
    return chunker.chunk(d, ["doc_id"])


@query(
    "WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents), g AS (SELECT DISTINCT doc_id, b[i] || b[i + 1] || b[i + 2] AS tri FROM t, unnest(range(1, len(b) - 1)) AS u(i)), "
    "s AS (SELECT tri, sha256(unhex(tri)) AS h FROM (SELECT DISTINCT tri FROM g)), n AS (SELECT tri, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2 FROM s), "
    f"p AS (SELECT DISTINCT doc_id, (h1 + i * h2) % 4294967296 % {formats.BLOOM_BITS} AS pos FROM g JOIN n USING (tri), range({formats.BLOOM_HASHES}) AS r(i)), v AS (SELECT doc_id, (pos // 8)::BIGINT AS k, sum(1 << (pos % 8)::INTEGER)::BIGINT AS v FROM p GROUP BY ALL), "
    f"m AS (SELECT doc_id, k, coalesce(v, 0) AS v FROM (SELECT doc_id, k FROM documents, range({formats.BLOOM_BITS // 8}) AS r(k)) LEFT JOIN v USING (doc_id, k)) "
    f"SELECT doc_id, {formats.BLOOM_BITS // 8} AS bytes, sha256(unhex(string_agg(printf('%02X', v), '' ORDER BY k))) AS bloom_sha256 FROM m GROUP BY doc_id"
)
def quote_blooms(spark, sf_dir):
    """Bits set in each document's trigram bloom."""
    b = load(spark, sf_dir, "documents").select("doc_id", hashing.quote_bloom_column("text").alias("bloom"))
    return b.select("doc_id", F.octet_length("bloom").alias("bytes"), F.sha2("bloom", 256).alias("bloom_sha256"))


@query()
def search_passages(spark, sf_dir):
    """F1-F7, F9, F11, F13-F15, and F10 without its budget: searches over the chunked corpus, deduplicated, with ten hits each."""
    d = whole_passages(spark, sf_dir).select("source_id", "document_id", "title", "source_uri", F.encode("body_text", "UTF-8").alias("body"), F.lit("plain-text").alias("chunk_kind"))
    passages = chunker.chunk(d, ["source_id", "document_id", "title", "source_uri"])
    found = retrieval.search(passages.withColumn("document_id", F.col("document_id").cast("string")), SEARCHES)
    return found.select("query_id", "fused_rank", "hit", "duplicate_of", "reason", *retrieval.IDENTITY, "units")
