"""DuckDB SQL for the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(string_split_regex(coalesce(%s, ''), '{GAP}'), lambda w: w <> '')"


def _words(x: str) -> str:
    return _WORDS % x


OP4 = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, list_transform({_words("lines[i]")}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
      FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
k AS (SELECT *, len(tokens) AS size, tokens[1] AS a, coalesce(tokens[2], '') AS b, coalesce(tokens[3], '') AS c FROM l WHERE len(tokens) >= 1),
act AS (SELECT size, a, b, c FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
cand AS (SELECT k.* FROM k SEMI JOIN act USING (size, a, b, c)),
tok AS (SELECT doc_id, pos, size, a, b, c, p, tokens[p] AS token FROM cand, unnest(range(1, size + 1)) AS u(p)),
sup AS (SELECT size, a, b, c, p, token FROM tok GROUP BY ALL HAVING count(*) >= 10),
shape AS (SELECT doc_id, pos, size, a, b, c, list((p, token) ORDER BY p) AS shape
          FROM tok JOIN sup USING (size, a, b, c, p, token) WHERE token <> '<*>' GROUP BY ALL),
good AS (SELECT * FROM shape WHERE 100 * len(shape) >= 60 * size),
rec AS (SELECT size, a, b, c, shape, min((doc_id, pos)) AS first FROM good GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT doc_id, pos FROM good JOIN rec USING (size, a, b, c, shape) WHERE (doc_id, pos) <> first),
drops AS (SELECT doc_id, list(DISTINCT pos) AS drops FROM gone GROUP BY 1)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(drops), 0)::BIGINT AS n_dropped,
       sha256(CASE WHEN drops IS NULL THEN coalesce(text, '')
                   ELSE coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(drops, i - 1)), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN drops USING (doc_id)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t, {_words("text")} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM again, unnest(range(i, i + 8)) AS u(p) GROUP BY 1),
ln AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '{GAP}', ' ', 'g')) AS key, len({_words("x")}) AS words
       FROM d, unnest(lines) AS u(x)),
host AS (SELECT source, count(DISTINCT doc_id) AS documents FROM d GROUP BY 1),
often AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM ln GROUP BY ALL HAVING n > 10),
freq AS (SELECT source, key FROM often JOIN host USING (source) WHERE 100 * n > 10 * documents),
lost AS (SELECT doc_id, sum(words)::BIGINT AS lost FROM ln SEMI JOIN freq USING (source, key) GROUP BY 1),
s AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{GAP}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (100 * (n_words - lost) < 30 * n_words) AS kept, lost::BIGINT AS n_line_words_removed
FROM f
"""

_RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)


def _spans(o: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {o} AS o, '{kind}' AS kind, i, gaps, hits, tested FROM (
      SELECT doc_id, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS hits,
             list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x) >= {least}) AS tested FROM d), unnest(range(1, len(hits) + 1)) AS u(i) WHERE tested[i]"""


OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_spans(o, *r) for o, r in enumerate(_RULES))}),
s AS (SELECT doc_id, o, kind, (list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0))::BIGINT AS s, hits[i] AS n FROM m),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) FILTER (o < 3) AS base,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS u(i)),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY 1),
cls AS MATERIALIZED (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY 1),
cs AS MATERIALIZED (SELECT rep, n, s FROM cls JOIN sh ON sh.doc_id = cls.rep),
links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM cs a JOIN cs b ON a.s = b.s AND a.rep <> b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, c) AS (SELECT rep, rep FROM cls UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.c),
comp AS (SELECT a, min(c) AS c FROM reach GROUP BY 1),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT d.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(deg.n, 0)::BIGINT AS n_links
FROM d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN cls ON cls.k = sets.k LEFT JOIN comp ON comp.a = cls.rep LEFT JOIN deg ON deg.a = cls.rep
"""

OP9 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words("text")} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM late, unnest(range(i, i + 50)) AS u(p)),
left_over AS (SELECT d.doc_id, string_agg(w[i], ' ' ORDER BY i) AS t FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = d.doc_id AND gone.p = i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP12 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY 1),
g AS MATERIALIZED (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, (1 + (1000000000 * (coalesce(n, 0)::HUGEINT + 2)) // (total + 2 * v))::HUGEINT AS p, (1 + (1000000000 * (lang_n::HUGEINT + 2)) // (lang_total + 2 * v))::HUGEINT AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM every LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
"""

OP13 = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(b[i:i + 49]) AS k FROM d, unnest(range(1, octet_length(b) - 48)) AS u(i)),
late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
edge AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM late),
run AS (SELECT doc_id, i, sum(CASE WHEN reach >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM edge),
span AS MATERIALIZED (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS e FROM run GROUP BY ALL),
gap AS (SELECT doc_id, e AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000000) AS e FROM span UNION ALL SELECT doc_id, 1, min(a) FROM span GROUP BY 1),
kept AS (SELECT doc_id, string_agg(hex(b[gap.a:gap.e - 1]), '' ORDER BY gap.a) AS h FROM d JOIN gap USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, sum(e - a) AS n, count(*) AS spans FROM span GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op3_adaptive_prefix_join": OP3,
    "op9_block_anchor_repeats": OP9,
    "op4_log_template_lines": OP4,
    "op5_line_frequency_quality": OP5,
    "op7_blob_ledger_secrets": OP7,
    "op12_sketched_source_audit": OP12,
    "op13_bwt_merge_repeats": OP13,
}
