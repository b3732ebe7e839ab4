"""Queries over a real index: an engine that has ingested the test tables in three generations, and DuckDB SQL for them.

The first generation is the prior state of the snapshot queries, the second takes its inactive keys away as a
delta, the third is their snapshot with its failures. The index is built once for each session and tables.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.hashing import citation
from ..functions.text import parse_query
from ..operators import audit, budget, evidence, postings, retrieval, snapshot
from ..sources import filesystem
from . import catalog
from .engine import Engine

QUERIES: dict = {}
ORACLES: dict = {}
_ENGINES: dict[tuple[str, str], str] = {}
EVERYTHING = snapshot.Confirmations(allow_empty=True, allow_mass_delete=True)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the checkpoint folder, or on one machine a temporary one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="tracequarry-")


def _files(key, body) -> list:
    return [
        key.cast("binary").alias("connector_key"), F.concat(F.lit("repo://"), key).alias("source_uri"), F.element_at(F.split(key, "/"), -1).alias("title"),
        F.lit("plain-text").alias("chunk_kind"), F.encode(body, "UTF-8").alias("body"), F.lit(None).cast("string").alias("source_updated_at"),
    ]


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(first corpus, keys taken away, last corpus, its failures), over the whole tables."""
    d = catalog.load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("body"))
    key = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    old = F.when(F.col("lang") == "fr", F.concat(F.lit("old/"), key)).otherwise(key)
    was = F.when(F.col("lang") == "de", F.concat("body", F.lit("x"))).otherwise(F.col("body"))
    p = catalog.load(spark, sf_dir, "pages")
    first = d.where("lang <> 'es'").select(*_files(old, was)).unionByName(p.select(*_files(F.concat(F.lit("pages/"), F.col("page_id").cast("string")), F.col("url"))))
    gone = d.where("lang <> 'es'").where(F.octet_length("body") % 50 == 0).select(old.cast("binary").alias("connector_key"))
    now, bad = d.where(~F.col("lang").eqNullSafe("it")), F.octet_length(key) % 10 == 1
    failures = now.where(bad).select(key.cast("binary").alias("connector_key"), F.lit("io").alias("code"), F.lit("unreadable").alias("detail"))
    return first, gone, now.where(~bad).select(*_files(key, F.col("body"))), failures


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _ENGINES:
        path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        e = Engine.create(spark, path)
        first, gone, last, failures = snapshots(spark, sf_dir)
        e.ingest(first, confirmed=EVERYTHING)
        e.ingest(first.limit(0), gone=gone, confirmed=EVERYTHING)
        e.ingest(last, failures, confirmed=EVERYTHING)
        _ENGINES[own] = path
    return Engine(spark, _ENGINES[own])


def short_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An index of the documents that are one passage each (1 to 1,200 bytes), so that SQL knows its passages."""
    own = (spark.sparkContext.applicationId, f"{sf_dir} short")
    if own not in _ENGINES:
        e = Engine.create(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
        d = catalog.load(spark, sf_dir, "documents").where(F.octet_length("text").between(1, 1200))
        key = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        e.ingest(d.select(*_files(key, F.col("text"))))
        _ENGINES[own] = e.store.path
    return Engine(spark, _ENGINES[own])


def whole_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An index of all documents, as one generation."""
    own = (spark.sparkContext.applicationId, f"{sf_dir} whole")
    if own not in _ENGINES:
        e = Engine.create(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
        key = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        e.ingest(catalog.load(spark, sf_dir, "documents").select(*_files(key, F.coalesce("text", F.lit("")))))
        _ENGINES[own] = e.store.path
    return Engine(spark, _ENGINES[own])


#: SQL that cuts plain texts (d with doc_id and body) as chunker.cut does: bin has a text with one character for each of its bytes (a first byte x, further
#: ones y; of white space outside ASCII v and w), cuts the spans of its passages, step by step, and psg the passages. Texts' own control characters 1 to 5 count as letters.
_MORE, _WHITE = r"[\x02\x05]", r"[ \t\r\x0b\x0c\x1c-\x1f\x04\x05]"
_LONG = {"x": 1, "y": 2, "v": 4, "w": 5}
_WIDE = [(r"[\x01-\x05]", "a"), (r"[\x{85}\x{a0}]", "vw"), (r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", "vww"), (r"[\x{80}-\x{7ff}]", "xy"), (r"[\x{800}-\x{ffff}]", "xyy"), (r"[\x{10000}-\x{10ffff}]", "xyyy")]


def _bytewise(text: str) -> str:
    for wide, marks in _WIDE:
        to = " || ".join(f"chr({_LONG[c]})" if c in _LONG else f"'{c}'" for c in marks)
        text = f"regexp_replace({text}, '{wide}', {to}, 'g')"
    return text


def _floor(at: str) -> str:
    return f"({at} - CASE WHEN {at} < n THEN strlen(regexp_extract(substring(b, greatest({at} - 2, 1), {at} + 1 - greatest({at} - 2, 1) + 1), '{_MORE}*$')) ELSE 0 END)"


def _ceil(at: str, high: str) -> str:
    return f"least({high}, {at} + strlen(regexp_extract(substring(b, {at} + 1, 4), '^{_MORE}*')))"


def _best(places: str) -> str:
    return f"coalesce(list_max(list_filter({places}, lambda p: p <= target)), list_min({places}))"


_T, _M, _O = formats.TARGET_BYTES, formats.MAX_BYTES, formats.OVERLAP_BYTES
_CUTS = rf"""bin AS MATERIALIZED (SELECT doc_id, {_bytewise('body')} AS b, strlen(body) AS n, CASE WHEN starts_with(body, chr(65279)) THEN 3 ELSE 0 END AS first FROM d),
cuts(doc_id, ordinal, s, e) AS (SELECT doc_id, -1, -1::BIGINT, first::BIGINT FROM bin UNION ALL (
  WITH f AS (SELECT doc_id, ordinal, b, n, CASE WHEN ordinal < 0 THEN e WHEN {_ceil(f'greatest(e - {_O}, 0)', 'e')} > s THEN {_ceil(f'greatest(e - {_O}, 0)', 'e')} ELSE e END AS s FROM cuts JOIN bin USING (doc_id) WHERE e < n),
  h AS (SELECT *, {_floor(f'least(s + {_M}, n)')} AS hard, {_floor(f'least(s + {_T}, n)')} - s AS target FROM f),
  w AS (SELECT *, substring(b, s + 1, hard - s) AS t, hard - s AS size, {_ceil('(s + target // 2)', 's + target')} - s AS low,
    string_split(CASE WHEN regexp_matches(substring(b, 1, s), '(^|\n){_WHITE}*$') THEN ' ' ELSE 'a' END || substring(b, s + 1, hard - s), chr(10)) AS lines FROM h),
  l AS (SELECT *, list_filter(list_transform(range(2, len(lines) + 1), lambda i: {{'p': strlen(array_to_string(lines[1:i - 1], chr(10))), 'new': regexp_full_match(lines[i - 1], '{_WHITE}*') AND NOT regexp_full_match(lines[i], '{_WHITE}*')}}), lambda x: x.p >= low AND x.p < size) AS starts,
    substring(t, low, target + 2 - low) || CASE WHEN target = size THEN ' ' ELSE '' END AS near, substring(t, target + 1) || ' ' AS far FROM w),
  g AS (SELECT *, list_transform(list_filter(starts, lambda x: x.new), lambda x: x.p) AS paragraphs, list_transform(starts, lambda x: x.p) AS every,
    CASE WHEN regexp_matches(near, '[.?!][ \t\n\f\r]') THEN low - 1 + strlen(regexp_extract(near, '(?s)^(.*[.?!])[ \t\n\f\r]', 1)) WHEN regexp_matches(far, '[.?!][ \t\n\f\r]') THEN target + strlen(regexp_extract(far, '(?s)^(.*?[.?!])[ \t\n\f\r]', 1)) END AS sentence FROM l)
  SELECT doc_id, ordinal + 1, s, s + CASE WHEN n - s <= {_T} THEN size ELSE coalesce({_best('paragraphs')}, sentence, {_best('every')}, size) END FROM g)),
psg AS MATERIALIZED (SELECT doc_id, s, substring(body, strlen(regexp_replace(substring(b, 1, s), '{_MORE}', '', 'g')) + 1, strlen(regexp_replace(substring(b, s + 1, e - s), '{_MORE}', '', 'g'))) AS part FROM cuts JOIN bin USING (doc_id) JOIN d USING (doc_id) WHERE ordinal >= 0)"""
_SHORT = lambda sql: sql.replace("FROM documents)", "FROM documents WHERE strlen(text) BETWEEN 1 AND 1200)")
_FINAL = catalog._PRIOR + """, fin AS (SELECT key, CASE WHEN status IN ('unchanged', 'carried') THEN 1 ELSE 3 END AS generation_id, status <> 'tombstoned' AS active, status FROM fate WHERE status <> 'failed'
          UNION ALL SELECT key, 2, false, 'inactive' FROM heads WHERE NOT active AND key NOT IN (SELECT key FROM ready)),
now AS (SELECT fin.*, CASE WHEN status IN ('unchanged', 'changed', 'renamed', 'reactivated', 'new') THEN r.hash WHEN status = 'carried' THEN h.hash END AS hash FROM fin LEFT JOIN ready r USING (key) LEFT JOIN heads h USING (key))"""


@query(f"WITH {_FINAL} SELECT key, active, generation_id::BIGINT AS generation_id, hash AS body_sha256 FROM now")
def index_heads(spark, sf_dir):
    """The heads after three generations."""
    return engine(spark, sf_dir).table("heads").select(F.col("connector_key").cast("string").alias("key"), "active", "generation_id", "body_sha256")


@query(
    f"WITH {_FINAL}, c AS (SELECT 1 AS g, 'active' AS s, true AS first, key FROM heads UNION ALL SELECT 2, 'tombstoned', false, key FROM heads WHERE NOT active "
    "UNION ALL SELECT 3, CASE WHEN status = 'tombstoned' THEN status ELSE 'active' END, status IN ('new', 'reactivated'), key FROM fate WHERE status IN ('new', 'changed', 'renamed', 'reactivated', 'tombstoned')) "
    "SELECT g::BIGINT AS generation_id, s AS next_state, count(*) AS n, count(*) FILTER (first) AS without_prior FROM c GROUP BY ALL"
)
def index_changes(spark, sf_dir):
    """The change log by generation."""
    return engine(spark, sf_dir).table("changes").groupBy("generation_id", "next_state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prior").isNull()).alias("without_prior"))


@query(f"WITH {_FINAL}, b AS (SELECT CASE WHEN lang = 'de' THEN body || 'x' ELSE body END AS body FROM d WHERE lang <> 'es' UNION SELECT url FROM pages UNION SELECT body FROM d JOIN ready ON ready.doc_id = d.doc_id) SELECT DISTINCT sha256(body) AS body_sha256, strlen(body)::BIGINT AS bytes FROM b")
def index_blobs(spark, sf_dir):
    """Every body that was ever active, once."""
    return engine(spark, sf_dir).table("blobs").select("body_sha256", "bytes")


@query(f"WITH {_FINAL} SELECT DISTINCT 'repo://' || key AS source_uri, hash AS body_sha256 FROM (SELECT key, hash FROM heads UNION SELECT key, hash FROM ready)")
def index_versions(spark, sf_dir):
    """Every version of every document, once."""
    return engine(spark, sf_dir).table("versions").select("source_uri", "body_sha256")


@query(f"WITH {_FINAL} SELECT 3::BIGINT AS generation_id, key, 'io' AS code FROM fail")
def index_errors(spark, sf_dir):
    """The error log."""
    return engine(spark, sf_dir).table("errors").select("generation_id", F.col("connector_key").cast("string").alias("key"), "code")


@query("SELECT id::BIGINT AS id, 'committed' AS state FROM range(1, 4) AS r(id)")
def index_generations(spark, sf_dir):
    """The generations."""
    return engine(spark, sf_dir).table("generations").select("id", "state")


@query(f"WITH {_FINAL} SELECT 'default' AS project, 1::BIGINT AS sources, count(*) FILTER (active) AS documents, count(*) FILTER (active AND hash <> sha256('')) AS searchable, count(DISTINCT hash) FILTER (active) AS bodies FROM now")
def index_counts(spark, sf_dir):
    """The project's counts, over the join of heads, versions and passages."""
    e = engine(spark, sf_dir)
    m = e.pin()
    counts = e.counts(m).select("project", "sources", "documents")
    live = e.table("heads", m).where("active").agg(F.count_distinct("body_sha256").alias("bodies"))
    return counts.join(F.broadcast(live)).join(F.broadcast(e.passages(m).agg(F.count_distinct("document_id").alias("searchable")))).select("project", "sources", "documents", "searchable", "bodies")  # one row each


@query(f"WITH {_FINAL} SELECT 'repo://' || key AS source_uri, 3::BIGINT AS epoch, CASE WHEN status = 'renamed' THEN 2 ELSE 1 END::BIGINT AS uris FROM now WHERE active AND status IN ('renamed', 'unchanged')")
def index_history(spark, sf_dir):
    """A renamed document keeps its identity and both URIs; an unchanged one has one."""
    e = engine(spark, sf_dir)
    m = e.pin()
    uris = e.table("versions", m).groupBy("document_id").agg(F.count_distinct("source_uri").alias("uris"))
    heads = e.table("heads", m).where("active").join(uris, "document_id")
    first = e.table("changes", m).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("generation_id").alias("g"))
    kept = heads.join(first, "document_id").where("g = 1 and (generation_id = 1 or uris = 2)")
    steady = kept.join(e.table("errors", m).select("connector_key"), "connector_key", "left_anti")
    return steady.select("source_uri", F.lit(m["meta"]["epoch"]).cast("long").alias("epoch"), "uris")


@query(f"WITH {_FINAL}, v AS (SELECT key, regexp_extract(key, '[^/]+$') AS title, 'repo://' || key AS uri FROM now WHERE active AND hash <> sha256('')), l AS (SELECT uri, 'title' AS field, unnest({catalog._LIT.format('title')}) AS literal FROM v UNION ALL SELECT uri, 'source_uri', unnest({catalog._LIT.format('uri')}) FROM v) SELECT DISTINCT uri AS source_uri, field, literal FROM l")
def index_literals(spark, sf_dir):
    """The literal index of the active passages' titles and URIs."""
    e = engine(spark, sf_dir)
    m = e.pin()
    held = e.table("literals", m).where("field <> 'body'").join(e.table("heads", m).where("active").select("document_id", "revision_sha256", "source_uri"), ["document_id", "revision_sha256"])
    return held.select("source_uri", "field", "literal").distinct()


@query(
    f"WITH {_FINAL}, w AS MATERIALIZED (SELECT key, hash FROM now WHERE active AND NOT starts_with(key, 'pages/') AND NOT starts_with(key, 'old/')), y AS MATERIALIZED (SELECT key AS k, doc_id FROM cur), "
    "v AS MATERIALIZED (SELECT 'repo://' || key AS uri, regexp_extract(key, '[^/]+$') AS title, CASE WHEN hash = sha256(body) THEN body ELSE body || 'x' END AS body FROM w JOIN y ON k = key JOIN d USING (doc_id)), "
    f"o AS MATERIALIZED (SELECT uri, {catalog._TOK.format('title')} AS a, {catalog._TOK.format('uri')} AS b, {catalog._TOK.format('body')} AS c FROM v WHERE strlen(body) BETWEEN 1 AND 1200), "
    "t AS (SELECT uri, unnest(list_concat(list_concat(a, b), c)) AS term FROM o) SELECT uri AS source_uri, term, count(*) AS f FROM t GROUP BY ALL"
)
def index_postings(spark, sf_dir):
    """The postings of active documents that are one passage (up to 1,200 bytes)."""
    e = engine(spark, sf_dir)
    m = e.pin()
    live = e.table("heads", m).where("active").select("document_id", "revision_sha256", "source_uri", "body_sha256").where("source_uri not like 'repo://pages/%' and source_uri not like 'repo://old/%'")
    short = live.join(e.table("blobs", m).where(F.col("bytes").between(1, 1200)).select("body_sha256"), "body_sha256", "left_semi")
    return postings.postings_among(e.table("postings", m), short.select("document_id", "revision_sha256", "source_uri")).select("source_uri", "term", "f")


AUDITS = ["replay", "heads", "orphan_heads", "generations", "blobs", "chunks", "layouts", "versions", "revisions", "layout_blobs", "generation_ids", "index_entries", "index_postings", "index_literals", "index_sizes", "index_slices", "statistics"]


@query(f"SELECT unnest({AUDITS!r}) AS audit, 0::BIGINT AS violations")
def index_doctor(spark, sf_dir):
    """Every audit of the index, the index tables derived again, and its violations."""
    e = engine(spark, sf_dir)
    names = spark.createDataFrame([(n,) for n in AUDITS], "audit string")
    found = e.doctor().groupBy("audit").agg(F.count(F.lit(1)).alias("violations"))
    return names.join(found, "audit", "full_outer").select("audit", F.coalesce("violations", F.lit(0)).alias("violations"))


@query(_SHORT(catalog._BM25) + " SELECT query_id, uri AS source_uri, round(c.score, 9) AS score FROM c JOIN need USING (query_id, k) JOIN d USING (doc_id)")
def index_scores(spark, sf_dir):
    """Scores from the stored postings and the sums that commits have kept."""
    e = short_engine(spark, sf_dir)
    m = e.pin()
    heads = e.table("heads", m).where("active")
    found = e._scores(e._heads(m), retrieval.query_terms(catalog.SEARCHES), m, False)
    return found.join(heads.select("document_id", "source_uri"), "document_id").select("query_id", "source_uri", F.round("score", 9).alias("score"))


@query(
    f"WITH RECURSIVE {catalog._D}, {_CUTS}, {catalog._EXACT.split(',' + chr(10) + 'm AS')[0]} "
    "SELECT query_id, uri AS source_uri, s AS start_byte, count(*)::INTEGER AS matched_atoms, sum(strlen(atom))::INTEGER AS matched_bytes, bool_or(raw) AS fallback "
    "FROM psg JOIN d USING (doc_id) JOIN a ON contains(title, atom) OR contains(uri, atom) OR contains(part, atom) GROUP BY query_id, uri, s"
)
def index_matches(spark, sf_dir):
    """Every passage of all documents that holds an atom, found by the sliced blooms, titles and URIs."""
    e = whole_engine(spark, sf_dir)
    m = e.pin()
    atoms = sorted({t for q in catalog.SEARCHES.values() for t, _ in parse_query(q).atoms})
    near = e._kept([e._near(e._heads(m), atoms, m)])
    found = e._kept([retrieval.exact_matches(e._texts(near.where(own), m, own), catalog.SEARCHES) for own in e._text_rounds(m)])
    return found.join(e._heads(m).select("document_id", "source_uri"), "document_id").select("query_id", "source_uri", "start_byte", "matched_atoms", "matched_bytes", "fallback")


#: Identifiers of titles, URIs and texts.
NAMED = {"x1": "mail7.example.com 1.txt repo://src1/1.txt", "x2": " ".join(f"{k}.txt" for k in range(3, 19)), "x3": " ".join(f"{k}.txt" for k in range(10, 200, 13))}


@query(
    _SHORT(f"WITH {catalog._D}, {catalog._LITS}, a(query_id, atom) AS (SELECT k, unnest(string_split(q, ' ')) FROM (VALUES {', '.join(f"('{k}', '{q}')" for k, q in NAMED.items())}) AS v(k, q)), l AS (SELECT DISTINCT doc_id, x.literal AS literal FROM (SELECT doc_id, unnest(p) AS x FROM pl)) ")
    + "SELECT query_id, uri AS source_uri, count(*)::BIGINT AS n FROM a JOIN l ON literal = atom JOIN d USING (doc_id) GROUP BY ALL"
)
def index_identifiers(spark, sf_dir):
    """Passages whose stored literals equal identifiers of queries, without a scan of entries or texts."""
    e = short_engine(spark, sf_dir)
    m = e.pin()
    live = e.table("literals", m).join(e._heads(m), ["document_id", "revision_sha256"])
    found = budget.identifier_candidates(live, NAMED, None).join(e._heads(m).select("document_id", "source_uri"), "document_id")
    return found.select("query_id", "source_uri", F.col("n").cast("long").alias("n"))


def damaged(e: Engine, m: dict) -> dict:
    """A manifest whose bodies, generations, heads and statistics are not what the others say; it is not committed."""
    def changed(name, rows):
        return {name: e.store.put(rows.select(e.table(name, m).columns), f"damaged-{name}") | {"schema": m["tables"][name]["schema"]}}

    blobs = e.table("blobs", m).withColumn("body", F.when(F.octet_length("body") % 7 == 3, F.concat("body", F.lit(b"!"))).otherwise(F.col("body")))
    again = e.table("generations", m).unionByName(e.table("generations", m).where("id = 1").withColumn("id", F.lit(9).cast("long")))
    moved = e.table("heads", m).withColumn("generation_id", F.when(F.octet_length("connector_key") % 3 == 0, F.col("generation_id") + 1).otherwise(F.col("generation_id")))
    tables = m["tables"] | changed("blobs", blobs) | changed("generations", again) | changed("heads", moved)
    return {"meta": m["meta"] | {"tokens": m["meta"]["tokens"] + 1}, "tables": tables}


@query(
    f"WITH {_FINAL}, b AS (SELECT CASE WHEN lang = 'de' THEN body || 'x' ELSE body END AS body FROM d WHERE lang <> 'es' UNION SELECT url FROM pages UNION SELECT body FROM d JOIN ready ON ready.doc_id = d.doc_id), "
    "h AS (SELECT DISTINCT sha256(body) AS hash FROM b WHERE strlen(body) % 7 = 3), v AS (SELECT DISTINCT key, hash FROM (SELECT key, hash FROM heads UNION SELECT key, hash FROM ready)) "
    "SELECT 'blobs' AS audit, count(*) AS violations FROM h UNION ALL SELECT 'revisions', count(*) FROM v SEMI JOIN h USING (hash) UNION ALL SELECT 'heads', 2 * count(*) FROM now WHERE strlen(key) % 3 = 0 "
    "UNION ALL VALUES ('generations', 1), ('generation_ids', 1), ('statistics', 1), ('replay', 0), ('versions', 0), ('index_postings', 0), ('index_slices', 0)"
)
def index_damage(spark, sf_dir):
    """What the audits tell of an index with planted damage: changed bodies, a generation too many,
    heads of a wrong generation and a wrong sum."""
    e = engine(spark, sf_dir)
    names = ["blobs", "revisions", "heads", "generations", "generation_ids", "statistics", "replay", "versions", "index_postings", "index_slices"]
    found = e.doctor(damaged(e, e.pin())).where(F.col("audit").isin(names)).groupBy("audit").agg(F.count(F.lit(1)).alias("violations"))
    return spark.createDataFrame([(n,) for n in names], "audit string").join(found, "audit", "left").select("audit", F.coalesce("violations", F.lit(0)).alias("violations"))


@query(f"SELECT unnest({sorted(catalog.SEARCHES)!r}) AS query_id, true AS same_hits")
def index_search(spark, sf_dir):
    """Searches through the stored index, whose gate and guards are in the way, give the hits of a scan of all passages."""
    e = engine(spark, sf_dir)
    m = e.pin()
    plain = lambda df: df.select("query_id", "fused_rank", "hit", "duplicate_of", "reason", "document_id", "start_byte", "units", "exact_rank", "lexical_rank", F.round("score", 9).alias("score"), "stop_reason")
    one, two = (e._kept([plain(found)]) for found in (e.find(catalog.SEARCHES, manifest=m, exhaustive=True), retrieval.search(e.staged_passages(m), catalog.SEARCHES)))
    differ = audit.parity(one, two).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame([(q,) for q in catalog.SEARCHES], "query_id string")
    return asked.join(differ, "query_id", "left").select("query_id", F.col("n").isNull().alias("same_hits"))


@query(f"WITH {_FINAL} SELECT count(DISTINCT hash)::BIGINT AS blobs, count(DISTINCT (uri, hash))::BIGINT AS versions, count(DISTINCT hash) FILTER (hash <> sha256(''))::BIGINT AS layouts, 1::BIGINT AS max_layouts FROM (SELECT key AS uri, hash FROM heads UNION SELECT key, hash FROM ready)")
def index_statistics(spark, sf_dir):
    """What a scan of the store reads."""
    e = engine(spark, sf_dir)
    m = e.pin()
    return audit.store_statistics(*(e.table(n, m) for n in ("blobs", "chunks", "versions")), e.passages(m)).select("blobs", "versions", "layouts", "max_layouts")


@query(f"WITH {_FINAL} SELECT count(*) FILTER (status = 'renamed') AS renamed_documents, count(*) FILTER (status = 'tombstoned') AS tombstoned_documents, count(*) FILTER (status = 'carried') AS carried_forward_documents, CASE WHEN count(*) FILTER (status IN ('carried', 'failed')) = 0 THEN 'success' ELSE 'partial' END AS state FROM fate")
def index_plan(spark, sf_dir):
    """The plan of the last snapshot, made against a pinned older manifest."""
    e = engine(spark, sf_dir)
    _, _, last, failures = snapshots(spark, sf_dir)
    before = e.store.manifest(3)  # created, first generation, second generation
    counts = snapshot.plan_counts(e.table("heads", before), e.prepare(last), failures)
    state = snapshot.source_state(F.col("failed_documents"), F.col("projected_active_documents"), F.lit(3))
    return counts.select("renamed_documents", "tombstoned_documents", "carried_forward_documents", state.alias("state"))



# --- directories: a file for each region and nation, and names and contents that discovery leaves out or refuses ---


def _tree(spark, sf_dir: str) -> str:
    """Writes the tree into a new folder that driver and executors share, as files need, and returns its path."""
    root = os.path.join(urlparse(shared_folder(spark)).path, f"tree-{uuid.uuid4().hex}")
    regions = {r["r_regionkey"]: r["r_name"] for r in catalog.load(spark, sf_dir, "region").collect()}  # two tables of 5 and 25 rows
    files = {f"{name}.txt": f"{name}\n" for name in regions.values()}
    files |= {f"R{r['n_regionkey']}/n{r['n_nationkey']}.md": f"# {r['n_name']}\n\nregion {regions[r['n_regionkey']]}\n" for r in catalog.load(spark, sf_dir, "nation").collect()}
    files |= {".hidden.md": "x", "node_modules/x.js": "x", "id_rsa.key": "x", "a.bin": "x", ".gitignore": "skip*.md\n", "skip1.md": "x", "nul.txt": "a\0", "R0/.env": "x", "R0/build/y.md": "x"}
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    with open(os.path.join(root, "bad.txt"), "wb") as f:
        f.write(b"\xff")
    os.symlink(os.path.join(root, "R0"), os.path.join(root, "R9"))
    return root


_TREE = "t AS (SELECT r_name || '.txt' AS key, r_name || chr(10) AS body, NULL::INTEGER AS k FROM region UNION ALL SELECT 'R' || n_regionkey || '/n' || n_nationkey || '.md', '# ' || n_name || chr(10) || chr(10) || 'region ' || r_name || chr(10), n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query(
    f"WITH {_TREE} SELECT key, 'repo://' || replace(key, ' ', '%20') AS source_uri, regexp_extract(key, '[^/]+$') AS title, CASE WHEN ends_with(key, '.md') THEN 'markdown' ELSE 'plain-text' END AS chunk_kind, sha256(body) AS body_sha256, NULL AS code FROM t "
    "UNION ALL VALUES ('bad.txt', NULL, NULL, NULL, NULL, 'invalid_utf8'), ('nul.txt', NULL, NULL, NULL, NULL, 'nul_content')"
)
def directory_snapshot(spark, sf_dir):
    """What a walk of a tree finds, leaves out and refuses."""
    root = _tree(spark, sf_dir)
    files, failures = filesystem.split(filesystem.observe(spark, root, estimated=filesystem.estimate(root)))
    names = [F.col(c) for c in ("source_uri", "title", "chunk_kind")]
    read = files.select(F.col("connector_key").cast("string").alias("key"), *names, F.sha2("body", 256).alias("body_sha256"), F.lit(None).cast("string").alias("code"))
    none = F.lit(None).cast("string")
    return read.unionByName(failures.select(F.col("connector_key").cast("string").alias("key"), *[none.alias(c) for c in ("source_uri", "title", "chunk_kind", "body_sha256")], "code"))


@query(
    f"WITH {_TREE} SELECT 'repo://' || replace(key, ' ', '%20') AS source_uri, CASE k % 5 WHEN 1 THEN 'metadata_changed' WHEN 2 THEN 'missing' WHEN 3 THEN 'metadata_changed' WHEN 4 THEN 'blocked' ELSE 'metadata_unchanged' END AS state, "
    "CASE k % 5 WHEN 1 THEN false WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE true END AS content_matches, CASE k % 5 WHEN 1 THEN 'changed_since_ingest' WHEN 2 THEN 'missing_since_ingest' WHEN 4 THEN 'unverifiable' ELSE 'content_unchanged' END AS source_state FROM t"
)
def directory_drift(spark, sf_dir):
    """Indexed documents against a tree whose files have changed, gone, been touched or become links."""
    root, e = _tree(spark, sf_dir), Engine.create(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    e.ingest(filesystem.observe(spark, root))
    for n in catalog.load(spark, sf_dir, "nation").collect():  # 25 files
        path = os.path.join(root, f"R{n['n_regionkey']}", f"n{n['n_nationkey']}.md")
        kind = n["n_nationkey"] % 5
        if kind == 1:
            with open(path, "a") as f:
                f.write("more\n")
        elif kind == 3:
            os.utime(path, (1, 1))
        elif kind in (2, 4):
            os.remove(path)
            if kind == 4:
                os.symlink(os.path.join(root, "bad.txt"), path)
    seen = e.drift(root, verify=True, deadline_ms=None).join(e.table("heads").select("document_id", "source_uri"), "document_id")
    return seen.select("source_uri", "state", "content_matches", evidence.source_state(F.col("state"), F.col("content_matches")).alias("source_state"))


@query("SELECT r_name || '.txt' AS title, 0::BIGINT AS s, strlen(r_name)::BIGINT + 1 AS e, sha256(r_name || chr(10)) AS content_sha256 FROM region")
def directory_get(spark, sf_dir):
    """Citations of a tree's files resolved to the bytes that were indexed, the files being gone."""
    root, e = _tree(spark, sf_dir), Engine.create(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    e.ingest(filesystem.observe(spark, root))
    shutil.rmtree(root)
    m = e.pin()
    cited = citation(F.lit(m["meta"]["index_id"]), F.col("source_id"), F.col("document_id"), F.col("revision_sha256"), F.col("start_byte"), F.col("end_byte"))
    asked = e.passages(m).where("chunk_kind = 'plain-text'").select(cited.alias("c")).collect()  # a citation for each region
    found = [e.get(r["c"]) for r in asked]
    return spark.createDataFrame([(g["title"], g["start"], g["end"], hashlib.sha256(g["content"].encode()).hexdigest()) for g in found], "title string, s long, e long, content_sha256 string")
