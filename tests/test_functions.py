import random
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.functions import formats, hashing, text
from tracequarry.operators import chunker, evidence
from tracequarry.plans import cursor
from tracequarry.plans.engine import problem_codes
from tracequarry.sources.filesystem import Ignore, default_excluded, sensitive


def test_frozen_fingerprints():
    assert hashing.pipeline_fingerprint().startswith("ff465d49") and hashing.pipeline_fingerprint().endswith("f5b")
    assert hashing.chunker_fingerprint("markdown").startswith("071dbd9f") and hashing.chunker_fingerprint("markdown").endswith("c812")
    assert hashing.kind_of_fingerprint(hashing.chunker_fingerprint("sql")) == "sql"


def test_frozen_revision(spark):
    body = b"\xef\xbb\xbf# Source\r\ncaf\xc3\xa9\r\n"
    meta = hashing.canonical_json({"z": "é", "a": {"two": 2, "one": 1}})
    stamp = hashing.utc_timestamp("2026-07-20T03:00:00+03:00")
    row = spark.createDataFrame([(body,)], "b binary").select(
        hashing.body_sha256(F.col("b")).alias("h"), hashing.revision_sha256(F.col("b"), F.lit("repo://notes/source.md"), F.lit("Source"), F.lit(meta), F.lit(stamp)).alias("r")
    ).first()
    assert row.h.startswith("ae19817d") and row.h.endswith("5bb33")
    assert row.r.startswith("e3591b43") and row.r.endswith("3962")


def test_frozen_bloom():
    bloom = hashing.quote_bloom(b"abc")
    assert {i: b for i, b in enumerate(bloom) if b} == {207: 0x20, 210: 0x08, 213: 0x02, 215: 0x80}
    assert len(hashing.quote_bloom(b"")) == 512


@given(st.binary(max_size=60), st.integers(0, 50), st.integers(3, 10))
@settings(max_examples=50, deadline=None)
def test_bloom_has_no_false_negative(content, at, n):
    assert hashing.bloom_may_contain(hashing.quote_bloom(content), content[at : at + n])


def test_uris_and_keys():
    assert hashing.source_uri(b"a b/\xc3\xa9~.md") == "repo://a%20b/%C3%A9~.md"
    assert hashing.display_title(b"x/a\\b\xff") == "a\\\\b\\xFF"
    assert hashing.format_mtime(1_500_000_000_120_000_000) == "2017-07-14T02:40:00.12Z"


def test_citation_round_trip(spark):
    u = [hashing.name_uuid(x) for x in "abc"]
    c = spark.range(1).select(hashing.citation(*map(F.lit, u), F.lit("0" * 64), F.lit(120), F.lit(480))).first()[0]
    assert hashing.parse_citation(c) == {"index_id": u[0], "source_id": u[1], "document_id": u[2], "revision": "0" * 64, "start": 120, "end": 480}
    for bad in (c.replace("120", "0120"), c + "#", c.upper(), c.replace("120-480", "480-120")):
        with pytest.raises(ValueError):
            hashing.parse_citation(bad)


def test_chunk_vectors():
    assert chunker.cut("é".encode() * 1001, "plain-text")[0] == (0, 1800)
    assert chunker.cut(b"\xef\xbb\xbfalpha\r\nbeta\r\ngamma\r\n", "plain-text", 8, 12, 2)[0][0] == 3
    assert chunker.cut(b"\xef\xbb\xbf", "markdown") == [] == chunker.cut(b"", "sql")
    rows = chunker.passages(b"one\r\ntwo", "plain-text")
    assert rows[0][3:5] == (1, 2)
    with pytest.raises(ValueError):
        chunker.cut(b"a\0b", "rust")
    code = b"".join(b"fn f%d() {\n%s}\n" % (i, b"    x();\n" * 20) for i in range(20))
    assert all(code[s:].startswith(b"fn ") for s, _ in chunker.cut(code, "rust", overlap=0))


@given(st.text(alphabet=st.sampled_from("ab. \n\ré日#`"), max_size=9000), st.sampled_from(["markdown", "plain-text", "python", "sql"]))
@settings(max_examples=60, deadline=None)
def test_chunks_cover(content, kind):
    data = content.encode()
    spans = chunker.cut(data, kind)
    assert (spans[0][0], spans[-1][1]) == (0, len(data)) if data else not spans
    for (s, e), (s2, e2) in zip(spans, spans[1:]):
        assert s < s2 <= e < e2 and e - s2 <= 180 and e - s <= 1800
    for s, e in spans:
        data[s:e].decode()


def test_literals(spark):
    body = "HTTPServer::handle_request repo://src/lib.rs snake_case kebab-case dot.name key:value plain + also@plain " + "a" * 130 + "-x"
    got = spark.createDataFrame([(body,)], "t string").select(text.identifier_literals(F.col("t"))).first()[0]
    assert got == ["HTTPServer::handle_request", "repo://src/lib.rs", "snake_case", "kebab-case", "dot.name", "key:value"]
    many = " ".join(f"t-{i}" for i in range(100))
    rows = spark.createDataFrame([("a.b", "u.v", many)], "t string, u string, b string").select(text.passage_literals(*map(F.col, "tub"))).first()[0]
    assert len(rows) == 64 and rows[0] == ("a.b", "title") and rows[1] == ("u.v", "source_uri")


def test_query_parsing():
    q = text.parse_query('foo "a b" x.y "a b"')
    assert q.atoms == (("a b", "quoted"), ("x.y", "identifier")) and len(q.spans) == 2
    assert text.fts_expression("alpha) OR (beta* NEAR(title:gamma)") == '"alpha" AND "OR" AND "beta" AND "NEAR" AND "title:gamma"'
    for bad, code in (("", "blank"), ('"a', "unmatched_quote"), ('" "', "empty_quote"), ('"++"', "punctuation_quote_too_short"), ('"a"', "atom_too_short"), ("\0", "nul"), ("a" * 4097, "too_long"), ("x." * 129, "atom_too_long"), (" ".join(f"a.{i}" for i in range(17)), "too_many_atoms")):
        with pytest.raises(text.QueryError) as e:
            text.parse_query(bad)
        assert e.value.code == code


def test_tokens_like_fts5(spark):
    samples = ["Café gamma. x_y a-b:c/d", "ß ½ Ⅷ ² don't", "tab\tnew\nline (paren)", "日本語 テスト", "a..b --c"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(b, tokenize=\"unicode61 remove_diacritics 0 tokenchars '_-.:/'\")")
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    for i, s in enumerate(samples):
        con.execute("insert into f(rowid, b) values (?, ?)", (i, s))
    want = {i: [t for t, in con.execute("select term from v where doc = ? order by offset", (i,))] for i in range(len(samples))}
    got = spark.createDataFrame([*enumerate(samples)], "i int, t string").select("i", text.tokens(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == want


def test_slugs_and_terminal():
    assert text.slugify("My Repo!!") == "my-repo" and text.slugify("***") == "index" and text.slug_with_suffix("a" * 64, 2) == "a" * 62 + "-2"
    assert text.escape_terminal(b"a\x1b[31m\xff\\") == "a\\u{1B}[31m\\xFF\\\\"
    assert text.heading_queries("# One two\ntext\n###### x\n####### no\n") == ["One two"]


def test_window_expansion():
    spans = [(0, 10), (8, 20), (18, 30), (28, 60)]
    assert evidence.expand_window(spans, 1, 12) == (1, 1)
    assert evidence.expand_window(spans, 1, 30) == (0, 2)
    assert evidence.expand_window(spans, 1, 60) == (0, 3)


def test_cursor():
    state = cursor.State(hashing.name_uuid("i"), 3, 9, 2)
    config, query = cursor.config_fingerprint("1"), cursor.query_fingerprint("v1", hashing.name_uuid("p"), "q", "auto", False)
    c = cursor.encode(7, state, config, query)
    assert cursor.decode(c, state, config, query) == 7

    def code(*a):
        with pytest.raises(cursor.CursorError) as e:
            cursor.decode(*a)
        return e.value.code

    assert code(c[:-1] + ("A" if c[-1] != "A" else "B"), state, config, query) == "malformed"
    assert code(c, state, config, b"\0" * 32) == "stale_fingerprint"
    for changed, want in ((dict(epoch=10), "stale_index"), (dict(generation=3), "stale_generation"), (dict(scope_revision=4), "stale_scope")):
        assert code(c, cursor.State(**{**state.__dict__, **changed}), config, query) == want


def test_ignore_rules():
    g = Ignore(["*.log", "!keep.log", "/build/", "a/**/z", "# no", "docs/*.md"])
    assert g.matched("x/y.log", False) and g.matched("keep.log", False) is False and g.matched("build", True) and g.matched("x/build", True) is None
    assert g.matched("a/b/c/z", False) and g.matched("docs/a.md", False) and g.matched("docs/b/a.md", False) is None
    assert default_excluded("a/.x", False) and default_excluded("dist", True) and not default_excluded("dist", False)
    assert sensitive("a/.git/x") and sensitive("k.pem") and sensitive(".env.local") and not sensitive("env")
    assert formats.chunk_kind("a/b.MD") is None and formats.chunk_kind(".md") is None and formats.chunk_kind("x.tar.rs") == "rust"


def test_problem_codes():
    assert problem_codes(0, None, 0, 0, 0, []) == ["NO_SOURCE", "NO_ACTIVE_GENERATION"]
    assert problem_codes(1, 1, 2, 0, 1, ["partial"]) == ["NO_SEARCHABLE_PASSAGES", "INCOMPLETE_GENERATION", "SOURCE_SYNC_PARTIAL"]


def test_literals_pass_over_plain_words(spark):
    """Runs with a mark are found without listing plain words, and are those that a list of all runs has."""
    rng = random.Random(4)
    bodies = ["plain words only 12", "a.b c -- x- -x é.é a_b\nc:d/e .a. ..", *("".join(rng.choice("ab1._:/- é\n") for _ in range(rng.randint(0, 80))) for _ in range(300))]
    every = [list(dict.fromkeys(r for r in re.findall(text.IDENTIFIER, b) if 2 <= len(r) <= 128 and re.search("[A-Za-z0-9]", r) and re.search("[_.:/-]", r)))[:64] for b in bodies]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, t string").select("i", text.identifier_literals(F.col("t")).alias("l"))
    assert [r.l for r in rows.orderBy("i").collect()] == every
    assert spark.range(1).select(F.regexp_extract_all(F.lit(bodies[0]), F.lit(text.MARKED), F.lit(0))).first()[0] == []


def test_trigrams_are_looked_up_in_a_table():
    """Texts' trigrams are not sorted: known ones have their place in a table, one for all texts, and more than KEPT begin it anew."""
    trigrams = hashing.Trigrams()
    texts = [b"", b"ab", b"abc", b"abcabcabc", "日本é".encode(), bytes(range(256))]
    assert hashing.quote_blooms(texts, trigrams) == [hashing.quote_bloom(t) for t in texts]
    assert trigrams.places[int.from_bytes(b"abc", "big")] and not trigrams.places[int.from_bytes(b"abb", "big")]
    trigrams.KEPT = 5
    assert hashing.quote_blooms([b"xyzxyz"], trigrams) == [hashing.quote_bloom(b"xyzxyz")] and len(trigrams.bits) == 4
