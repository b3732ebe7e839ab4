import hashlib
import json
import math
import os
import random
import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tests.oracle import differences
from tracequarry.functions import formats
from tracequarry.operators import retrieval, snapshot
from tracequarry.plans import catalog, indexed
from tracequarry.plans.cursor import CursorError
from tracequarry.plans.engine import Engine, EvidenceError
from tracequarry.plans.store import StoreError
from tracequarry.sources import filesystem
from tracequarry.streaming import incremental


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    mine, theirs, n, m = differences(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    assert not mine and not theirs and n == m


@pytest.mark.parametrize("name", sorted(indexed.ORACLES))
def test_index_oracle(spark, name):
    mine, theirs, n, m = differences(spark, indexed.QUERIES[name], indexed.ORACLES[name])
    assert not mine and not theirs and n == m


def test_rows_only_queries(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def passages(spark, rows):
    cols = "source_id string, document_id string, start_byte long, end_byte long, title string, source_uri string, body_text string"
    return spark.createDataFrame([("s", f"d{i:03d}", s, s + len(b.encode()), f"t{i}", f"repo://u{i}", b) for i, (s, b) in enumerate(rows)], cols).withColumn("content_sha256", F.sha2("body_text", 256))


def test_fusion_units(spark):
    r = spark.range(1).select(retrieval.exact_units(F.lit(1)), retrieval.lexical_units(F.lit(3)), retrieval.lexical_units(F.lit(1))).first()
    assert r[0] + r[1] == 40463179807 and r[2] == 16393442623
    assert retrieval.overlap_half(0, 100, 50, 150) and not retrieval.overlap_half(0, 100, 51, 151)


def test_search_contract(spark):
    p = passages(spark, [(0, "EVIDENCE_FORGOTTEN alpha-beta\n"), (0, "ordinary alpha material\n"), (0, "the alpha beta phrase"), (0, "operator a+b remains"), (0, "café"), (0, "café")])
    hit = lambda q: [(r.document_id, r.exact_rank, r.lexical_rank, r.fallback) for r in retrieval.search(p, {"q": q}).where("hit is not null").orderBy("hit").collect()]
    assert hit("alpha-beta")[0][:3] == ("d000", 1, 1)
    assert hit('"alpha beta"')[0][0] == "d002"
    assert [(h[0], h[3]) for h in hit('"a+b"') if h[1]] == [("d003", True)]
    assert [h[0] for h in hit('"café"') if h[1]] == ["d005"]


def test_duplicates(spark):
    p = passages(spark, [(0, "shared-id exact evidence")] * 60)
    rows = retrieval.search(p, {"q": "shared-id"}).collect()
    assert sum(r.hit is not None for r in rows) == 1 and sum(r.reason == "same_content" for r in rows) == 59


def test_bm25_like_fts5(spark):
    bodies = ["alpha beta beta gamma", "alpha", "beta gamma delta " * 5, "nothing here", "alpha beta", "Gamma GAMMA alpha x"] + ["filler text"] * 12
    p = passages(spark, [(0, b) for b in bodies])
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, uri, body, tokenize=\"unicode61 remove_diacritics 0 tokenchars '_-.:/'\")")
    for i, b in enumerate(bodies):
        con.execute("insert into f values (?, ?, ?)", (f"t{i}", f"repo://u{i}", b))
    for q in ("alpha", "alpha beta", "gamma alpha"):
        want = {f"d{r - 1:03d}": s for r, s in con.execute("select rowid, bm25(f) from f where f match ?", (" AND ".join(f'"{t}"' for t in q.split()),))}
        got = {r.document_id: r.score for r in retrieval.bm25_scores(retrieval.index_fields(p), {"q": q}).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def put(root, name, body):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "wb") as f:
        f.write(body)


def test_lifecycle(spark, tmp_path):
    root = str(tmp_path / "r")
    put(root, "README.md", b"# Title\n\nalpha-beta EVIDENCE\n")
    put(root, "src/lib.rs", b"fn main() {}\n ordinary material\n")
    put(root, "bad.txt", b"\xff\xfe")
    put(root, "nul.txt", b"a\0")
    put(root, ".hidden.md", b"x")
    put(root, "node_modules/a.js", b"x")
    os.symlink(f"{root}/README.md", f"{root}/link.md")
    e = Engine.create(spark, str(tmp_path / "i"))
    with pytest.raises(StoreError):
        Engine.create(spark, str(tmp_path / "i"))
    files, failures = filesystem.split(filesystem.observe(spark, root))
    assert sorted(r.code for r in failures.collect()) == ["invalid_utf8", "nul_content"]
    first = e.ingest(files, failures)
    assert (first["generation"], first["changed_documents"], first["state"]) == (1, 2, "partial")
    os.remove(f"{root}/bad.txt")
    os.remove(f"{root}/nul.txt")
    again = e.ingest(filesystem.observe(spark, root))
    assert again["generation"] is None and again["unchanged_documents"] == 2 and e.status()["epoch"] == 1
    hit = e.search("alpha-beta").where("hit = 1").first()
    assert e.get(hit.citation)["content"] == "# Title\n\nalpha-beta EVIDENCE\n"
    index, source = hit.citation.removeprefix(formats.CITATION_PREFIX).split("/")[:2]
    for foreign in (hit.citation.replace(index, source), hit.citation.replace(source, index), hit.citation.replace(hit.document_id, source)):
        with pytest.raises(EvidenceError) as refused:  # nothing tells which of them exists
            e.get(foreign)
        assert refused.value.code == "scope_denied"
    assert e.project()["project"] == "default" and e.project()["generation"] == 1 and "md" in e.project()["extensions"]
    assert e.plan(filesystem.observe(spark, root))["would_create_generation"] is False
    pinned = e.pin()
    put(root, "README.md", b"# Title\n\nchanged\n")
    os.rename(f"{root}/src/lib.rs", f"{root}/src/lib2.rs")
    assert {r.state for r in e.drift(root, deadline_ms=None).collect()} == {"missing", "metadata_changed"}
    second = e.ingest(filesystem.observe(spark, root))
    assert (second["renamed_documents"], second["changed_documents"], second["new_documents"]) == (1, 2, 0)
    assert e.get(hit.citation)["content"].endswith("EVIDENCE\n")
    assert e.passages(pinned).where("body_text like '%EVIDENCE%'").count() == 1
    assert e.doctor().isEmpty()
    with pytest.raises(EvidenceError):
        e.get(hit.citation, 3)
    os.remove(f"{root}/README.md")
    with pytest.raises(snapshot.DeletionRefused) as refused:
        e.ingest(filesystem.observe(spark, root))
    assert refused.value.code == "mass_delete"
    third = e.ingest(filesystem.observe(spark, root), confirmed=snapshot.Confirmations(allow_mass_delete=True))
    assert third["tombstoned_documents"] == 1 and e.status()["documents"] == 1 and e.doctor().isEmpty()


def test_doctor_finds_tampering(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    corpus = filesystem.table_corpus(spark.createDataFrame([("s", i, f"text {i} " * 300) for i in range(4)], "source string, id int, text string"), "source", "id", "text")
    e.ingest(corpus)
    assert e.doctor().isEmpty()
    m = e.pin()
    broken = e.table("blobs", m).withColumn("body", F.concat("body", F.lit(b"!")))
    tables = m["tables"] | {"blobs": e.store.put(broken, "blobs") | {"schema": m["tables"]["blobs"]["schema"]}}
    e.store.commit({"meta": m["meta"], "tables": tables}, m["version"])
    assert {"blobs", "layouts"} <= {r.audit for r in e.doctor().collect()}
    with pytest.raises(StoreError):
        e.store.commit({"meta": m["meta"], "tables": tables}, m["version"])


def test_guards(spark):
    heads = spark.createDataFrame([(f"{c}.md", "r", c, c, True) for c in "abcd"], "connector_key string, revision_sha256 string, body_sha256 string, document_id string, active boolean")
    ready = lambda keys: spark.createDataFrame([(f"{c}.md", "r", c, 5) for c in keys], "connector_key string, revision_sha256 string, body_sha256 string, body_len int")
    none = spark.createDataFrame([], "connector_key string, code string, detail string")
    plan = lambda keys: snapshot.plan_counts(heads, ready(keys), none).first()
    assert not plan("abc").requires_mass_delete_confirmation and plan("ab").requires_mass_delete_confirmation and plan("").requires_empty_confirmation
    with pytest.raises(ValueError):
        snapshot.check_snapshot(ready("aa"), none)


def test_stream(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    src = str(tmp_path / "in")
    rows = lambda x: filesystem.table_corpus(spark.createDataFrame(x, "source string, id int, text string"), "source", "id", "text")
    rows([("s", 1, "one alpha"), ("s", 2, "two beta")]).write.parquet(src)
    stream = lambda: spark.readStream.schema(rows([("s", 1, "")]).schema).parquet(src)
    incremental.start(stream(), e, str(tmp_path / "c")).awaitTermination()
    assert e.status()["documents"] == 2
    rows([("s", 2, "two changed"), ("s", 3, "three")]).write.mode("append").parquet(src)
    incremental.start(stream(), e, str(tmp_path / "c")).awaitTermination()
    s = e.status()
    assert (s["documents"], s["generation"]) == (3, 2) and e.search("changed").count() == 1


def test_limits(spark, tmp_path):
    root = str(tmp_path / "r")
    put(root, "a.md", b"x" * 100)
    put(root, "b.md", b"y")
    with pytest.raises(filesystem.DiscoveryError):
        filesystem.walk(root, filesystem.Options(max_files=1))
    w = filesystem.walk(root, filesystem.Options(max_file_bytes=50))
    assert [f[0] for f in w.files] == [b"b.md"] and w.issues[0][1] == "oversize"
    assert [f[0] for f in filesystem.walk(root, filesystem.Options(includes=("a.md",))).files] == [b"a.md"]


def text_corpus(spark, rows):
    return filesystem.table_corpus(spark.createDataFrame([("s", i, t) for i, t in rows], "source string, id int, text string"), "source", "id", "text")


def test_paging_and_reports(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"alpha text number{i} " + "pad " * (i % 7)) for i in range(60)] + [(i, "alpha twin") for i in range(100, 103)]))
    seen, after = [], None
    for _ in range(9):
        page = e.page("alpha", 20, after, explain=True, deadline_ms=None)
        seen += [r["hit"] for r in page["results"]]
        after = page["next"]
        if after is None:
            break
    assert seen == list(range(1, 51)) and page["stop_reason"] == "limit_reached" and page["effective_mode"] == "lexical" and page["retrievers"] == ["exact", "lexical"]
    assert sum(len(r["content"]) for r in page["results"]) and all(r["untrusted_content"] for r in page["results"])
    first = e.page('"alpha twin"', 3, deadline_ms=None)
    assert first["results"][0]["score"]["lists"][0]["retriever"] == "exact" and "backend_score" not in first["results"][0]["score"]["lists"][0]
    assert {d["reason"] for d in first["results"][0]["duplicates"]} == {"same_content"} and len(first["results"][0]["duplicates"]) == 2
    none = e.page("zzzz", deadline_ms=None)
    assert none["results"] == [] and none["next"] is None and none["stop_reason"] == "unique_exhausted"
    cursor = e.page("alpha", 7, deadline_ms=None)["next"]
    for bad, code in ((("beta", 7, cursor), "stale_fingerprint"), (("alpha", 7, cursor[:-2] + "AA"), "malformed")):
        with pytest.raises(CursorError) as refused:
            e.page(*bad)
        assert refused.value.code == code
    e.ingest(text_corpus(spark, [(0, "alpha new")]), gone=spark.createDataFrame([], "connector_key binary"))
    with pytest.raises(CursorError) as refused:
        e.page("alpha", 7, cursor)
    assert refused.value.code == "stale_index"
    with pytest.raises(EvidenceError):
        e.page("alpha", mode="vector")
    assert e.search("alpha", deadline_ms=10_000).count() > 0
    with pytest.raises(EvidenceError) as refused:
        e.search("alpha", deadline_ms=5)
    assert refused.value.code == "invalid_deadline"


def test_deadline(spark, tmp_path, monkeypatch):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"alpha-beta alpha {i}") for i in range(20)]))
    whole, told = e.answer("alpha-beta", deadline_ms=None)
    assert told["stop_reason"] == "limit_reached" and whole.where("hit is not null").count() == 10
    in_time = Engine._in_time
    steps = []

    def slow(self, rows, end):  # the second step begins when the time is over
        steps.append(1)
        return in_time(self, rows, None if len(steps) == 1 else time.monotonic() - 1)

    monkeypatch.setattr(Engine, "_in_time", slow)
    some, told = e.answer("alpha-beta", 50)
    rows = some.where("hit is not null").collect()
    assert told["stop_reason"] == "deadline" and told["examined_lexical"] == 0 and len(rows) == 20 and {r.lexical_rank for r in rows} == {None}
    monkeypatch.setattr(Engine, "_in_time", in_time)
    monkeypatch.setattr(formats, "DEADLINE_MIN_MS", 1)
    page = e.page("alpha-beta", deadline_ms=1)
    assert page["results"] == [] and page["stop_reason"] == "deadline" and page["next"] is None
    with pytest.raises(EvidenceError):
        e.page("alpha", deadline_ms=20_000)


def test_cancelled_jobs_end(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    slow = spark.range(0, 1 << 40, 1, 4).selectExpr("sum(id % 7) AS s")
    began = time.monotonic()
    assert e._in_time(slow, began + 0.5) is None and time.monotonic() - began < 20
    assert spark.range(5).count() == 5


def test_trim():
    from tracequarry.operators.evidence import trim

    reply = {"results": [{"c": "é" * 100}] * 10, "truncated": False}
    got = trim(reply, 1000)
    assert 0 < len(got["results"]) < 10 and got["truncated"] and len(json.dumps(got, ensure_ascii=False).encode()) <= 1000
    assert trim(reply, 10_000) == reply and trim(reply, 50) is None


def test_corrupt_candidates_fail_the_query(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"alpha-beta text {i}") for i in range(5)]))
    m = e.pin()
    broken = e.table("chunks", m).withColumn("body_text", F.when(F.col("body_text").contains("text 3"), F.lit("alpha-beta texx 3")).otherwise(F.col("body_text")))
    tables = m["tables"] | {"chunks": e.store.put(broken, "chunks") | {"schema": m["tables"]["chunks"]["schema"]}}
    e.store.commit({"meta": m["meta"], "tables": tables}, m["version"])
    with pytest.raises(Exception, match="content hash"):
        e.search("alpha-beta", 1).collect()


def test_slices_lose_nothing(spark, tmp_path):
    """An exhaustive search through the sliced blooms finds what a scan finds."""
    e = Engine.create(spark, str(tmp_path / "i"))
    texts = ["operator a+b remains", "café crème", "日本語のテキスト", "xyz" * 300, "no such thing", "c.d/e_f g", "a+ b"]
    e.ingest(text_corpus(spark, [*enumerate(texts * 3)]))
    asked = {"a": '"a+b"', "b": '"crème"', "c": '"語の"', "d": '"zxyz"', "e": "c.d/e_f", "f": '"s 3.t"', "g": '"+ "', "h": "s/4.txt"}
    got = {(r.query_id, r.document_id, r.exact_rank) for r in e.find(asked, exhaustive=True).collect()}
    want = {(r.query_id, r.document_id, r.exact_rank) for r in retrieval.search(e.passages(), asked).collect()}
    assert got == want and {q for q, *_ in got} >= set("abcdegh")


def test_slices_like_single_blooms(spark, monkeypatch):
    from tracequarry.functions.hashing import quote_bloom_column
    from tracequarry.operators import slices

    monkeypatch.setattr(slices, "BLOCK", 70)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefé ", k=rng.randrange(40))) for _ in range(300)]
    p = spark.createDataFrame([(f"d{i}", "r", i, t) for i, t in enumerate(texts)], "document_id string, revision_sha256 string, ordinal int, body string").repartition(3)
    blooms = p.select(*slices.PASSAGE, quote_bloom_column(F.col("body")).alias("bloom"))
    cut = slices.sliced(blooms)
    assert {(r.ordinal, bytes(r.bloom)) for r in slices.unsliced(cut).collect()} == {(r.ordinal, bytes(r.bloom)) for r in blooms.collect()}
    asked = ["abc", "éa", "dea", "fé ", "zzz", "bcdef", "no"]
    got = {(r.text, r.ordinal) for r in slices.may_hold(cut, asked).collect()}
    assert {(a, i) for a in asked for i, t in enumerate(texts) if len(a.encode()) > 2 and a in t} <= got
    assert len(got) < 300 and not [g for g in got if g[0] in ("zzz", "no")]
    plan = slices.may_hold(cut, ["abc"])._jdf.queryExecution().optimizedPlan().toString()
    assert "bit" in plan


def test_blooms_like_single_ones():
    from tracequarry.functions import hashing

    texts = [b"", b"ab", b"abc", "日本語 café".encode(), b"the cat sat on the mat" * 50, bytes(range(1, 128))]
    trigrams = hashing.Trigrams()
    for _ in range(2):
        assert hashing.quote_blooms(texts, trigrams) == [hashing.quote_bloom(t) for t in texts]
    trigrams.KEPT = 10
    assert hashing.quote_blooms(texts, trigrams) == [hashing.quote_bloom(t) for t in texts]
    assert hashing.quote_blooms([], trigrams) == []


def test_dead_writer(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    killed = e.store.lock()
    killed._touch = lambda: None
    killed.__enter__()  # a writer that died: nobody touches its lock
    with pytest.raises(StoreError):
        with e.store.lock(timeout=0.2):
            pass
    e.store._fs.setTimes(e.store._path(f"{e.store.path}/writer.lock"), 1000, -1)
    assert e.ingest(text_corpus(spark, [(1, "alpha")]))["generation"] == 1
    with e.store.lock(stale=1.0):  # a living writer's is touched
        time.sleep(2.5)
        with pytest.raises(StoreError):
            with e.store.lock(timeout=0.2, stale=1.0):
                pass
    with e.store.lock(timeout=0.5):
        pass


def test_deltas_read_only_what_they_name(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"alpha {i}") for i in range(30)]))
    m = e.pin()
    lost = {k: v for k, v in m["tables"].items()} | {"blobs": e.store.put(e.table("blobs", m).where("body = X'616c7068612031'"), "blobs") | {"schema": m["tables"]["blobs"]["schema"]}}
    e.store.commit({"meta": m["meta"], "tables": lost}, m["version"])  # bodies of the others can't be read any more
    batch = text_corpus(spark, [(2, "beta 2"), (90, "alpha 91")]).unionByName(text_corpus(spark, [(5, "x")]).withColumn("body", F.lit(None).cast("binary")))
    done = incremental.merge(e, batch)
    assert (done["new_documents"], done["changed_documents"], done["tombstoned_documents"], done["prior_active_documents"], done["projected_active_documents"]) == (1, 2, 1, 30, 30)
    assert incremental.merge(e, batch)["generation"] is None and e.status()["documents"] == 30
    keys = {bytes(r.connector_key) for r in e.table("heads").where("active").collect()}
    assert b"s/90.txt" in keys and b"s/5.txt" not in keys and len(keys) == 30


def test_snapshot_is_staged_once(spark, tmp_path):
    """What is applied is what was planned, though the source changes at every reading."""
    reads = spark.sparkContext.accumulator(0)

    def body(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    e = Engine.create(spark, str(tmp_path / "i"))
    corpus = text_corpus(spark, [(i, f"alpha {i}") for i in range(8)])
    e.ingest(corpus.mapInPandas(body, corpus.schema))
    assert reads.value == 8 and not os.listdir(tmp_path / "i" / "data" / "staged")


def test_refresh_rebuild_suggest(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    root = str(tmp_path / "r")
    put(root, "a.md", b"# Alpha heading\n\nsome text\n## Second one\n")
    put(root, "b.rs", b"fn parse_query() {}\n")
    assert e.refresh(lambda: filesystem.observe(spark, root))["state"] == "refreshed"
    assert e.suggest() == "Alpha heading"
    before = [r.asDict() for r in e.search("parse_query").select("citation", "units").collect()]
    epoch = e.status()["epoch"]
    e.rebuild()
    assert e.status()["epoch"] == epoch + 1 and e.doctor().isEmpty() and [r.asDict() for r in e.search("parse_query").select("citation", "units").collect()] == before
    put(root, "c.txt", b"\xff")
    assert e.refresh(lambda: filesystem.observe(spark, root))["state"] == "partial"
    status = e.status()
    assert status["problems"] == ["SOURCE_SYNC_PARTIAL"] and status["health"][0]["code"] == "invalid_utf8" and status["drift_possible"]
    os.remove(f"{root}/a.md")
    os.remove(f"{root}/c.txt")
    stale = e.refresh(lambda: filesystem.observe(spark, root))
    assert stale["state"] == "stale" and "DeletionRefused" in stale["problem"] and e.status()["documents"] == 2
    assert e.refresh(lambda: filesystem.observe(spark, str(tmp_path / "nowhere")))["state"] == "stale"


def test_collisions_are_refused(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(1, "alpha"), (2, "beta")]))
    m = e.pin()
    for name, change in (("blobs", {"body": F.lit(b"other")}), ("chunks", {"body_text": F.lit("other")})):
        tables = m["tables"] | {name: e.store.put(e.table(name, m).withColumns(change), name) | {"schema": m["tables"][name]["schema"]}}
        e.store.commit({"meta": m["meta"], "tables": tables}, e.pin()["version"])
        with pytest.raises(StoreError, match="differs"):
            e.ingest(text_corpus(spark, [(1, "alpha"), (2, "beta"), (3, "alpha")]))


def test_capacity(spark, tmp_path):
    need = 100 + (64 << 20)
    assert snapshot.preflight(100, 0, need, need) == {"reserve_bytes": 64 << 20, "required_free_bytes": need, "required_quota_bytes": need}
    for args, code in (((100, 0, need - 1, need), "quota_exceeded"), ((100, 0, None, need - 1), "insufficient_capacity")):
        with pytest.raises(snapshot.CapacityError) as refused:
            snapshot.preflight(*args)
        assert refused.value.code == code
    assert snapshot.storage_reserve(10**10 + 1) == 10**9 + 1
    e = Engine.create(spark, str(tmp_path / "i"))
    with pytest.raises(snapshot.CapacityError):
        e.ingest(text_corpus(spark, [(1, "alpha")]), quota=1000)
    assert e.status()["generation"] is None and e.store.free() > 0


def test_source_config():
    from tracequarry.sources.config import ConfigError, SourceConfig

    text = '{"schema_version":1,"root":"/srv/docs","max_file_bytes":1000,"max_source_files":5,"max_source_bytes":9000,"includes":["*.md"]}'
    c = SourceConfig.parse(text)
    assert c.options.includes == ("*.md",) and c.options.max_files == 5 and SourceConfig.parse(c.to_json()) == c
    assert c.to_json().startswith('{"allow_sensitive":false,"excludes":[],"includes":["*.md"],"max_directory_depth":128,') and "index_quota_bytes" not in c.to_json()
    bad = {"unknown_field": text[:-1] + ',"x":1}', "missing_field": '{"schema_version":1}', "unsupported_schema": text.replace(":1,", ":2,", 1), "invalid_root": text.replace("/srv", "srv"), "invalid_json": "[", "invalid_value": text.replace("1000", "true"), "invalid_quota": text[:-1] + ',"index_quota_bytes":0}', "too_large": text + " " * 20_000}
    for code, wrong in bad.items():
        with pytest.raises(ConfigError) as refused:
            SourceConfig.parse(wrong)
        assert refused.value.code == code


def test_walk_guards(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    put(root, "a.md", b"x")
    os.symlink(root, tmp_path / "l")
    with pytest.raises(filesystem.DiscoveryError) as refused:
        filesystem.walk(str(tmp_path / "l"))
    assert refused.value.code == "root_unreadable"
    os.makedirs(f"{root}/sub")
    with pytest.raises(filesystem.DiscoveryError) as refused:
        filesystem.walk(str(tmp_path / "l" / "sub"))  # a link above the root
    assert refused.value.code == "root_unreadable"
    told = filesystem.estimate(root)
    put(root, "b.md", b"y")
    with pytest.raises(filesystem.DiscoveryError) as refused:
        filesystem.observe(spark, root, estimated=told)
    assert refused.value.code == "estimate_exceeded"
    plain = os.listdir

    def meddling(folder):
        names = plain(folder)
        put(root, "c.md", b"z")
        return names

    monkeypatch.setattr(os, "listdir", meddling)
    with pytest.raises(filesystem.DiscoveryError) as refused:
        filesystem.walk(root)
    assert refused.value.code == "directory_changed"


def plain_chunks(data, kind):
    """The chunker's contract by plain search: the last best boundary up to the target, else the first one after it."""
    from tracequarry.functions import formats

    lists = {"markdown": "hfps", "plain-text": "psl", "shell": "pl", "sql": "pl"}.get(kind, "dpl")
    lead = lambda at: at >= len(data) or data[at] & 0xC0 != 0x80
    starts = [0] + [i + 1 for i, b in enumerate(data) if b == 10]
    line = {s: data[s : (starts[k + 1] - 1 if k + 1 < len(starts) else len(data))].decode().rstrip("\r") for k, s in enumerate(starts)}

    def is_boundary(rule, b, first, hard):
        if rule == "s":
            return data[b - 1 : b] in (b".", b"?", b"!") and b - 1 >= first and (b >= hard and b >= len(data) or data[b : b + 1] in (b" ", b"\t", b"\n", b"\x0c", b"\r"))
        if b not in line or b >= hard:
            return False
        own = line[b]
        before = max((s for s in starts if s < b), default=None)
        if rule == "l":
            return b > first
        if rule == "p":
            return before is not None and b > first and not line[before].strip() and own.strip() != ""
        if rule == "h":
            return own.lstrip().startswith("#")
        if rule == "f":
            return own.lstrip().startswith(("```", "~~~"))
        return own[:1].strip() != "" and own.rstrip().startswith(formats.DECLARATIONS[kind])

    at, out = 3 if data.startswith(b"\xef\xbb\xbf") else 0, []
    while at < len(data):
        hard = min(at + 1800, len(data))
        while not lead(hard):
            hard -= 1
        end = hard
        if len(data) - at > 1200:
            target = min(at + 1200, hard)
            while not lead(target):
                target -= 1
            least = at + (target - at) // 2
            while not lead(least):
                least += 1
            for rule in lists:
                found = [b for b in range(least, hard + 1) if is_boundary(rule, b, at, hard)]
                if found:
                    end = max([b for b in found if b <= target], default=found[0])
                    break
        out.append((at, end))
        if end == len(data):
            break
        after = max(end - 180, 0)
        while not lead(after):
            after += 1
        at = after if after > at else end
    return out


@pytest.mark.parametrize("kind", ["plain-text", "markdown", "python", "rust", "sql", "shell"])
def test_chunks_like_plain_version(kind):
    from tracequarry.operators import chunker

    rng = random.Random(kind)
    pieces = ["word ", "Ünïcode ", "End. ", "Why? ", "\n", "\n\n", "\r\n", "# Head\n", "```\n", "def f(x):\n", "fn main() {\n", "class A:\n", "  indented\n", "日本語", "a" * 90 + " ", "SELECT 1;\n", " \n"]
    for _ in range(25):
        data = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 900))).encode()
        assert chunker.cut(data, kind) == plain_chunks(data, kind)
        for k, (n, s, e, first, last, text, digest) in enumerate(chunker.passages(data, kind)):
            assert (n, text.encode()) == (k, data[s:e]) and digest == hashlib.sha256(data[s:e]).hexdigest()
            assert first == 1 + data[:s].count(b"\n") and last == 1 + data[: e - 1].count(b"\n")


def test_unstable_file_is_carried(spark, tmp_path):
    """A file that fails at the first reading and not at a later one is a failure: its head stays as it is."""
    root, e = str(tmp_path / "r"), Engine.create(spark, str(tmp_path / "i"))
    for k in range(8):
        put(root, f"{k}.md", f"text {k}".encode())
    e.ingest(filesystem.observe(spark, root))
    mark = str(tmp_path / "read")

    def once(batches):
        for pdf in batches:
            bad = pdf["connector_key"].map(bytes) == b"3.md"
            if bad.any() and not os.path.exists(mark):
                open(mark, "w").close()
                pdf["body"] = pdf["body"].where(~bad, None)
                pdf["code"], pdf["detail"] = pdf["code"].where(~bad, "unstable"), pdf["detail"].where(~bad, "the file is unstable")
            yield pdf

    observed = filesystem.observe(spark, root)
    done = e.ingest(observed.mapInPandas(once, observed.schema))
    assert (done["tombstoned_documents"], done["carried_forward_documents"], done["failed_documents"], done["state"]) == (0, 1, 1, "partial")
    assert e.status()["documents"] == 8 and e.status()["health"][0]["code"] == "unstable"
    assert e.ingest(observed.mapInPandas(once, observed.schema))["state"] == "success"


def test_every_fate_occurs(spark):
    fates = {r.status for r in catalog.QUERIES["snapshot_fates"](spark, "/root/testdata/sf0.001").select("status").distinct().collect()}
    assert fates == {"unchanged", "changed", "reactivated", "renamed", "new", "tombstoned", "carried", "failed"}
    assert indexed.QUERIES["index_errors"](spark, "/root/testdata/sf0.001").count() > 0


def test_budget_stops_a_raw_quote(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"ordinary evidence number {i}") for i in range(501)]))
    page = e.page('"+=+"', deadline_ms=None)
    assert (page["results"], page["examined_fallback"], page["stop_reason"], page["retrievers"]) == ([], 500, "work_budget_exhausted", ["exact", "exact_fallback", "lexical"])
    plan = e.find({"q": "evidence"})._jdf.queryExecution().executedPlan().toString()
    assert "/entries/" not in plan and "/slices/" not in plan
    none = e.find({"q": "evidence"}, scope=F.col("source_uri").endswith("/7.txt")).where("hit is not null").collect()
    assert len(none) == 1


def test_lists_are_read_to_their_ends(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, "shared-id exact evidence") for i in range(60)]))
    rows, told = e.answer("shared-id", deadline_ms=None)
    assert (told["examined_exact"], told["examined_lexical"], told["stop_reason"]) == (60, 60, "unique_exhausted")
    assert rows.where("hit is null").count() == 59
    m = e.pin()
    forged = e.table("literals", m).limit(1).withColumn("literal", F.lit("forged-token"))
    entry = m["tables"]["literals"]
    e.store.commit({"meta": m["meta"], "tables": m["tables"] | {"literals": entry | {"files": entry["files"] + e.store.put(forged, "literals")["files"]}}}, m["version"])
    assert e.answer("forged-token", deadline_ms=None)[0].isEmpty()  # a literal is a hint, and texts decide
    assert {r.audit for r in e.doctor().collect()} == {"index_literals"}


def plain_pager(lists, matches, steps, budget=500):
    """What is found and examined, by a list of single reads."""
    at, ended, read, turn, seen, found = [0] * len(lists), [False] * len(lists), 0, 0, [], []
    for wanted in steps:
        while len(found) < wanted and read < budget and not all(ended):
            open_ = [k for k in range(len(lists)) if not ended[k]]
            quota = max(1, math.ceil((wanted - len(found)) / len(open_)))
            got = 0
            for k in [*range(turn, len(lists)), *range(turn)]:
                if k not in open_ or read >= budget:
                    continue
                n, room = 0, min(quota, budget - read)
                while n < room and at[k] < len(lists[k]):
                    c = lists[k][at[k]]
                    at[k], n, read = at[k] + 1, n + 1, read + 1
                    if c not in seen:
                        seen.append(c)
                        found += [c] if c in matches else []
                ended[k] |= n < room
                got += n
            turn = (turn + 1) % len(lists)
            if not got:
                break
    return found, read, all(ended)


def test_pager_like_plain_version():
    from tracequarry.operators.budget import Pager

    rng = random.Random(6)
    for _ in range(200):
        lists = [rng.sample(range(900), rng.randrange(501)) for _ in range(rng.randrange(1, 5))]
        matches = {c: c for c in rng.sample(range(900), rng.randrange(900))}
        pager = Pager(lists, matches, len(lists) - 1, True)
        steps = range(50, rng.choice([51, 301, 501]), 50)
        for wanted in steps:
            pager.read_to(wanted)
        assert (pager.found, pager.read, pager.exhausted) == plain_pager(lists, matches, steps)


def test_deltas_are_merged(spark, tmp_path, monkeypatch):
    """Writes of a change do not grow with the corpus, and a table has few folders after many commits."""
    from tracequarry.plans import engine

    monkeypatch.setattr(engine, "FAN", 2)
    monkeypatch.setattr(engine, "FOLD", 1)
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"alpha text {i}") for i in range(300)]))
    none = spark.createDataFrame([], "connector_key binary")
    base = e.pin()["tables"]["heads"]["files"]
    texts = {}
    for k in range(4):
        texts[k % 3] = f"beta {k}"
        e.ingest(text_corpus(spark, [(k % 3, texts[k % 3])]), gone=none)
        files = e.pin()["tables"]["heads"]["files"]
        if k < 2:
            assert files[0] == base[0] and max(e.store.size(f) for f in files[1:]) < e.store.size(base[0])
    m = e.pin()
    assert all(len(t["files"]) <= 4 for t in m["tables"].values()) and e.doctor().isEmpty()
    assert max(e.store.level(f) for f in m["tables"]["postings"]["files"]) == 2
    assert e.table("heads").count() == 300 and e.status()["documents"] == 300
    got = {r.source_uri: r.body_text for r in e.passages().where("body_text like 'beta%'").collect()}
    assert got == {f"repo://s/{k}.txt": t for k, t in texts.items()}
    assert m["meta"]["passages"] == 300 and e.search("beta").where("hit is not null").count() == 3
    assert e.store.vacuum() > 0 and e.search("beta").where("hit is not null").count() == 3


def test_drift_within_a_time(spark, tmp_path):
    root, e = str(tmp_path / "r"), Engine.create(spark, str(tmp_path / "i"))
    for k in range(5):
        put(root, f"d/{k}.md", f"text {k}".encode())
    e.ingest(filesystem.observe(spark, root))
    assert {r.state for r in e.drift(root, deadline_ms=0).collect()} == {"unknown"}
    assert {r.state for r in e.drift(root, deadline_ms=None).collect()} == {"metadata_unchanged"}
    os.rename(f"{root}/d", f"{root}/e")
    os.symlink(f"{root}/e", f"{root}/d")
    assert {r.state for r in e.drift(root, deadline_ms=None).collect()} == {"blocked"}
    assert {r.state for r in e.drift(str(tmp_path / "no"), deadline_ms=None).collect()} == {"blocked"}


def test_folders_that_become_links_lead_nowhere(tmp_path):
    """A folder that is replaced by a link between the walk and the reading is not followed."""
    root = str(tmp_path / "r")
    put(root, "a/b/x.md", b"inside")
    put(str(tmp_path), "other/x.md", b"outside")
    (key, size, mtime), = filesystem.walk(root).files
    top = filesystem.open_root(root)
    assert filesystem._read(top, key, size, mtime) == (b"inside", None)
    os.rename(f"{root}/a/b", f"{root}/a/c")
    os.symlink(str(tmp_path / "other"), f"{root}/a/b")
    assert filesystem._read(top, key, size, mtime) == (None, "unreadable")
    os.close(top)
    os.symlink(root, str(tmp_path / "link"))
    for bad in (str(tmp_path / "link"), str(tmp_path / "link" / "a"), str(tmp_path / "none")):
        with pytest.raises(filesystem.DiscoveryError) as refused:
            filesystem.walk(bad)
        assert refused.value.code == "root_unreadable"
    before = len(os.listdir("/proc/self/fd"))
    filesystem.walk(root)
    assert len(os.listdir("/proc/self/fd")) == before


def test_includes_below_folders():
    """may_match_below against all paths of two names below a folder."""
    names = ["a", "b", "ab"]
    paths = [f"{x}/{y}" for x in names for y in names] + names
    for pattern in ("a", "a/b", "/a/b", "*/b", "a*/b", "**/b", "**", "a/**", "a/**/b", "b/?", "ab/a/b", "*/*/*"):
        for folder in ["a", "b", "ab", "a/b", "b/ab"]:
            rx = re.compile("".join({"**/": "(?:[^/]+/)*", "/**": "(?:/[^/]+)+", "**": ".+", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]", pattern.lstrip("/"))))
            want = any(rx.fullmatch(f"{folder}/{p}") for p in paths)
            assert filesystem.may_match_below(pattern, folder) == want, (pattern, folder)


def test_get_tells_the_source(spark, tmp_path):
    root, e = str(tmp_path / "r"), Engine.create(spark, str(tmp_path / "i"))
    put(root, "a.md", b"alpha text")
    e.ingest(filesystem.observe(spark, root))
    cited = e.search("alpha").where("hit = 1").first().citation
    told = lambda: [e.get(cited, root=root)[k] for k in ("source_state", "hash_verification", "cited_verification")]
    assert told() == ["content_unchanged", "unchanged", "unchanged"] and "source_state" not in e.get(cited)
    put(root, "a.md", b"alpha tex2")
    assert told() == ["changed_since_ingest", "changed", "changed"]
    e.ingest(filesystem.observe(spark, root))
    assert told() == ["content_unchanged", "unchanged", "changed"]  # the file is what is indexed now, the citation is of before
    os.remove(f"{root}/a.md")
    assert told()[:2] == ["missing_since_ingest", "missing"] and e.get(cited, root=root)["content"] == "alpha text"


def test_documents_are_checked(spark, tmp_path):
    e = Engine.create(spark, str(tmp_path / "i"))
    good = text_corpus(spark, [(1, "alpha")])
    for column, value in (("chunk_kind", F.lit("novel")), ("source_uri", F.lit("")), ("title", F.lit("x" * 20_000)), ("body", F.lit(b"\xff\xfe")), ("body", F.lit(b"a\0b")), ("body", F.lit(None).cast("binary"))):
        with pytest.raises(ValueError, match=column):
            e.ingest(good.withColumn(column, value))
    assert e.status()["generation"] is None and e.ingest(good)["generation"] == 1


def test_postings_are_kept_by_blocks(spark, tmp_path):
    """Postings take less than the texts they are of, give every term of every passage, and damage to them is told."""
    from tracequarry.operators import postings

    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(0, ""), *((i, " ".join(rng.choices(words, k=150))) for i in range(1, 400))]))
    m = e.pin()
    size = lambda name: sum(e.store.size(f) for f in m["tables"][name]["files"])
    assert size("postings") < size("chunks")
    got = {(r.document_id, r.ordinal, r.term): r.f for r in postings.postings_of(e.table("postings", m)).collect()}
    fields = retrieval.index_fields(e.passages(m)).select("document_id", "ordinal", F.explode(F.concat(*retrieval.FIELDS)).alias("term"))
    assert got == {(r.document_id, r.ordinal, r.term): r["count"] for r in fields.groupBy("document_id", "ordinal", "term").count().collect()}
    moved = F.when(F.col("term") != "w7", F.col("slots")).otherwise(F.transform("slots", lambda x: (x + 1).cast("smallint")))
    changed = {"moved": moved, "term": F.col("slots"), "all": F.col("slots")}
    for what, slots in changed.items():
        rows = e.table("postings", m).withColumn("slots", slots)
        rows = rows.withColumn("term", F.when(F.col("term") == "w7", "w7x").otherwise(F.col("term"))) if what == "term" else rows.where("members IS NULL") if what == "all" else rows
        other = {"meta": m["meta"], "tables": m["tables"] | {"postings": e.store.put(rows, "postings") | {"schema": m["tables"]["postings"]["schema"]}}}
        assert {r.audit for r in e.doctor(other).collect()} == {"index_postings"}, what


def test_budgeted_lists_are_made_once(spark):
    """The lists, their texts and their matches come from six scans at most, one for terms and phrases together, and the lists are not made again."""
    lists = indexed.budget.passage_lists(catalog.whole_passages(spark, "/root/testdata/sf0.001"), catalog.PAGED, 9)
    assert lists._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6


def test_a_build_moves_no_texts(spark, tmp_path):
    """Bodies and passages are not shuffled to find what the store lacks or to make the index, copies and known bodies included."""
    rng = random.Random(5)
    text = lambda: " ".join(f"{rng.getrandbits(64):016x}" for _ in range(2500))
    bodies = [text() for _ in range(50)]
    rows = list(enumerate(bodies + bodies[:10]))
    moved = lambda: sum(x.totalShuffleWrite() for x in (s.apply(0) for s in [spark._jsc.sc().statusStore().executorList(True)]))
    e = Engine.create(spark, str(tmp_path / "i"))
    files = text_corpus(spark, rows).localCheckpoint()
    before = moved()
    e.ingest(files)
    assert moved() - before < sum(len(t) for _, t in rows)
    more = text_corpus(spark, rows + [(99, bodies[3]), (100, text())]).localCheckpoint()
    before = moved()
    e.ingest(more)
    assert moved() - before < sum(len(t) for _, t in rows)
    m = e.pin()
    assert e.doctor(m).isEmpty() and (e.table("blobs", m).count(), e.table("versions", m).count()) == (51, 62)
    assert e.table("chunks", m).select("body_sha256").distinct().count() == 51 and not os.listdir(tmp_path / "i" / "data" / "staged")[1:]


def test_postings_of_some_passages(spark, tmp_path):
    """Postings of some documents come from their blocks' groups; those of others never become rows."""
    from tracequarry.operators import postings

    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(0, ""), (1, "a b a"), (2, "b c"), (3, "a c c c")]))
    m = e.pin()
    some = e.table("heads", m).where("source_uri like '%1%' or source_uri like '%3%'").select("document_id", "revision_sha256", "source_uri")
    rows = lambda df: sorted((r.source_uri, r.term, r.f) for r in df.collect())
    got = postings.postings_among(e.table("postings", m), some)
    assert rows(got) == rows(postings.postings_of(e.table("postings", m)).join(some, ["document_id", "revision_sha256"])) and rows(got)
    assert "Generate explode(" not in got._jdf.queryExecution().optimizedPlan().toString() and "inline" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_build_keeps_no_shuffles_and_texts_once(spark, tmp_path, monkeypatch):
    """Shuffle files go with their jobs, whether or not the driver collects garbage; while the index is written no staged folder holds bodies,
    and bodies that are dealt out in several rounds all arrive."""
    from tracequarry.plans import engine, store

    monkeypatch.setattr(engine, "ROUND_BYTES", 2000)
    e = Engine.create(spark, str(tmp_path / "i"))
    put, staged, rounds = e.store.put, [], []

    def watched(df, name, level=0):
        there = tmp_path / "i" / "data" / "staged"
        if name == "postings":
            staged.extend("body" in e.store.folder(f"data/staged/{f}").columns for f in os.listdir(there))
        rounds.append(name == "staged" and "body" in df.columns)
        return put(df, name, level)

    monkeypatch.setattr(e.store, "put", watched)
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    kept = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, setting = kept(), spark.conf.get(store.TIDY)
    rng = random.Random(3)
    e.ingest(text_corpus(spark, [(i, " ".join(f"{rng.getrandbits(64):016x}" for _ in range(50))) for i in range(60)]))
    end = time.time() + 20
    while kept() - before and time.time() < end:  # Spark deletes them in the background
        time.sleep(0.2)
    assert not kept() - before and spark.conf.get(store.TIDY) == setting
    assert staged and not any(staged) and sum(rounds) == 1 + engine.ROUNDS
    assert e.doctor().isEmpty() and e.table("blobs").count() == 60


def test_exhaustive_search_deals_texts_out_in_rounds(spark, tmp_path, monkeypatch):
    """An exhaustive search's ranking reads no texts, and rounds lose no passage that holds an atom."""
    from tracequarry.plans import engine

    monkeypatch.setattr(engine, "ROUND_BYTES", 3000)
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"alpha {i} needle{i % 3}") for i in range(40)]))
    m = e.pin()
    assert len(e._text_rounds(m)) > 1 and e.staged_passages(m).count() == e.passages(m).count() == 40
    found = e.find({"a": '"needle1"'}, 50, m, exhaustive=True)
    assert "body_text" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("hit IS NOT NULL AND exact_rank IS NOT NULL").count() == 13


def test_bodies_are_stored_as_their_passages(spark, tmp_path):
    """A body is kept once, in its passages, and comes back byte by byte; its size is told without a text, and a body that the store
    knows in another layout is compared with that one."""
    e = Engine.create(spark, str(tmp_path / "i"))
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice(["été", "日本", "alpha", "b.", "c\n\nd", "x\r\n"]) for _ in range(n))
    texts = ["", "a", "ab\n", "﻿", "﻿# marked " + words(900), "é" * 5000, words(3000), words(3000).replace(" ", ""), "\n" * 4000, "﻿z"]
    rows = text_corpus(spark, list(enumerate(texts + texts[4:7])))
    kinds = rows.withColumn("chunk_kind", F.when(F.col("connector_key").cast("string").rlike("s/1[0-9]"), "markdown").otherwise(F.col("chunk_kind")))
    e.ingest(kinds)
    m = e.pin()
    assert {bytes(r.body) for r in e.table("blobs", m).collect()} == {t.encode() for t in texts}
    assert all(r.bytes == len(r.body) for r in e.table("blobs", m).collect()) and e.doctor().isEmpty()
    assert max(len(r.body or b"") for r in e.store.table("blobs", m).collect()) <= 3
    assert "body_text" not in e.table("blobs", m).select("body_sha256", "bytes")._jdf.queryExecution().optimizedPlan().toString()
    other = e.table("chunks", m).withColumn("body_text", F.when(F.col("start_byte") > 0, F.lit("other")).otherwise(F.col("body_text")))
    tables = m["tables"] | {"chunks": e.store.put(other, "chunks") | {"schema": m["tables"]["chunks"]["schema"]}}
    e.store.commit({"meta": m["meta"], "tables": tables}, m["version"])
    assert "blobs" in {r.audit for r in e.doctor().collect()}
    with pytest.raises(StoreError, match="differs"):
        e.ingest(kinds.unionByName(text_corpus(spark, [(99, texts[7])]).withColumn("chunk_kind", F.lit("sql"))))


def test_blooms_are_kept_once_for_each_layout(spark, tmp_path):
    """Copies share their blooms, a search by them finds every copy, and a rebuild has the same."""
    e = Engine.create(spark, str(tmp_path / "i"))
    rows = [(i, f"alpha+{i % 3} beta " * 200) for i in range(12)]
    e.ingest(text_corpus(spark, rows))
    e.ingest(text_corpus(spark, rows + [(40, rows[1][1]), (41, "gamma+1")]))
    for _ in range(2):
        m = e.pin()
        members = e.table("slices", m).where("bit = -1").select(F.explode("members").alias("m")).count()
        assert members == e.table("chunks", m).count() < e.table("entries", m).count() / 3
        found = e.find({"q": '"a+1 b"'}, 50, m, exhaustive=True).select("document_id").distinct().join(e.table("heads", m), "document_id")
        assert {r.source_uri for r in found.collect()} == {f"repo://s/{i}.txt" for i in (1, 4, 7, 10, 40)} and e.doctor().isEmpty()
        e.rebuild()


def test_staged_texts_go_round_by_round(spark, tmp_path, monkeypatch):
    """A round's bodies go when they have been cut, and a round's passages when they have been indexed; rounds share a table's folder."""
    from tracequarry.plans import engine

    monkeypatch.setattr(engine, "ROUND_BYTES", 20_000)
    e = Engine.create(spark, str(tmp_path / "i"))
    rng = random.Random(7)
    texts = [(i, " ".join(f"{rng.getrandbits(64):016x}" for _ in range(120))) for i in range(120)]
    there = lambda: {f: e.store.folder(f"data/staged/{f}").columns for f in os.listdir(tmp_path / "i" / "data" / "staged")}
    size = lambda column: sum(e.store.size(f"data/staged/{f}") for f, names in there().items() if column in names)
    put, extend, bodies, passages = e.store.put, e.store.extend, [], []

    def watched(df, name, level=0):
        if name == "staged" and "body_text" in df.columns:
            bodies.append(size("body"))
        return put(df, name, level)

    def extended(df, name, folder):
        if name == "postings":
            passages.append(size("body_text"))
        return extend(df, name, folder)

    monkeypatch.setattr(e.store, "put", watched)
    monkeypatch.setattr(e.store, "extend", extended)
    e.ingest(text_corpus(spark, texts).repartition(16))
    assert len(bodies) > 2 and bodies == sorted(bodies, reverse=True) and bodies[-1] < bodies[0] / 2
    assert len(passages) == engine.INDEXED - 1 and passages == sorted(passages, reverse=True) and passages[-1] < passages[0] / 1.5
    m = e.pin()
    assert all(len(t["files"]) == 1 for n, t in m["tables"].items() if n in ("chunks", "postings", "slices")) and not there()
    assert e.doctor(m).isEmpty() and e.table("chunks", m).select("body_sha256").distinct().count() == 120


def test_a_round_reads_its_bodies_once(spark, tmp_path, monkeypatch):
    """A round's passages, those of layouts that the store knows under another kind included, come from one reading of its staged bodies."""
    e = Engine.create(spark, str(tmp_path / "i"))
    rows = text_corpus(spark, [(i, f"alpha {i} " * 300) for i in range(6)])
    e.ingest(rows)
    put, scans = e.store.put, []

    def watched(df, name, level=0):
        if name == "staged" and "body_text" in df.columns:
            scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return put(df, name, level)

    monkeypatch.setattr(e.store, "put", watched)
    e.ingest(rows.unionByName(text_corpus(spark, [(i + 10, f"alpha {i} " * 300) for i in range(6)]).withColumn("chunk_kind", F.lit("markdown"))))
    assert set(scans) == {1} and e.doctor().isEmpty()


def test_postings_are_audited_by_sums(spark):
    """The audit of postings adds hashes up where the rows are: a block deals out its members and a row of sums, not a row for each term, and each
    kind of damage is told."""
    from tracequarry.operators import postings

    rows = [(f"d{i}", "r", 0, 0, 3, ["b", f"a{i}", "b"]) for i in range(500)] + [("e", "r", 0, 0, 0, [])]
    p = spark.createDataFrame(rows, "document_id string, revision_sha256 string, ordinal int, start_byte long, len int, tokens array<string>").coalesce(1)
    blocks = postings.posted(p).localCheckpoint()
    told = postings.stored_digests(blocks)
    assert sorted(told.collect()) == sorted(postings.digests(p.withColumn("tokens", F.reverse("tokens"))).collect())
    assert "MapInArrow" in told._jdf.queryExecution().optimizedPlan().toString()
    wrong = {"counts": F.transform("counts", lambda x: x + 1), "slots": F.transform("slots", lambda x: (x - 1).cast("smallint")), "term": F.concat("term", F.lit("x")), "members": F.lit(None).cast(blocks.schema["members"].dataType)}
    for name, value in wrong.items():
        changed = postings.stored_digests(blocks.withColumn(name, F.when(F.col("term").isNull() if name == "members" else F.col("term") == "a7", value).otherwise(F.col(name))))
        assert set(changed.collect()) != set(told.collect()), name


def test_audits_keep_no_shuffles(spark, tmp_path):
    """An audit's shuffles and the doctor's staged texts go as it ends; vacuum() deletes what it told."""
    e = Engine.create(spark, str(tmp_path / "i"))
    e.ingest(text_corpus(spark, [(i, f"alpha {i} " * 100) for i in range(20)]))
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    kept = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = kept()
    told = e.doctor()
    end = time.time() + 20
    while kept() - before and time.time() < end:  # Spark deletes them in the background
        time.sleep(0.2)
    assert not kept() - before and told.isEmpty()
    assert not os.listdir(tmp_path / "i" / "data" / "staged") and not os.listdir(tmp_path / "i" / "data" / "bodies")


def test_sql_cuts_as_the_chunker_does():
    """The passages that the SQL of index_matches cuts are chunker.cut's, on odd texts too."""
    import duckdb

    from tracequarry.operators.chunker import cut

    rng = random.Random(3)
    parts = ["a", "bc ", "\n", "\n\n", ". ", "? ", "é", "日本", "　", " ", "\r\n", "\t", "😀", "\x1c", "\x02", "word " * 8, ".", "\x0b\n", " \n"]
    texts = ["", "﻿", "﻿abc" * 900, "x" * 5000, "é" * 5000, "\n" * 4000, "😀" * 2000, "é. " * 2000, " \n" * 1000 + "a\n" * 1500]
    texts += ["".join(rng.choices(rng.sample(parts, rng.randint(1, 8)), k=rng.randint(100, 3000))) for _ in range(40)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, source varchar, lang varchar, text varchar)")
    con.executemany("insert into documents values (?, 's', 'en', ?)", list(enumerate(texts)))
    rows = con.sql(f"WITH RECURSIVE {catalog._D}, {indexed._CUTS} SELECT doc_id, s, e, part FROM cuts JOIN psg USING (doc_id, s) WHERE ordinal >= 0").fetchall()
    assert sorted(rows) == [(i, s, e, t.encode()[s:e].decode()) for i, t in enumerate(texts) for s, e in cut(t.encode(), "plain-text")]


def test_matches_are_of_whole_documents(spark):
    """index_matches finds atoms in every passage of the documents, not in short ones alone."""
    import __spark_entry__

    assert differences(spark, __spark_entry__.queries()["index_matches"], __spark_entry__.oracle_sql()["index_matches"])[:2] == ([], [])
    rows = __spark_entry__.queries()["index_matches"](spark, "/root/testdata/sf0.001").collect()
    assert max(r.start_byte for r in rows) > 1200
