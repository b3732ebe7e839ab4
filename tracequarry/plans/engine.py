"""The engine: snapshots become generations of passages; queries, citations, status and audits read them."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import formats
from ..functions.hashing import body_sha256, chunker_fingerprint, citation, derive_source_id, name_uuid_column, parse_citation, pipeline_fingerprint, quote_bloom_column, revision_sha256
from ..functions.text import QueryError, parse_query, passage_literals
from ..operators import audit, budget, evidence, postings, retrieval, scopes, slices, snapshot
from ..operators.chunker import chunk
from ..sources.drift import probe
from ..sources.filesystem import split
from . import cursor
from .store import Store, StoreError

HEADS = "source_id string, connector_key binary, document_id string, source_uri string, title string, chunk_kind string, active boolean, revision_sha256 string, body_sha256 string, generation_id long, passages int, tokens long"
CHANGES = "generation_id long, document_id string, prior string, next string, next_state string"
#: body is null where it is that of its passages put together, as of all bodies of more than STORED_BYTES; a longer one has a passage.
BLOBS = "body_sha256 string, body binary, bytes long"
STORED_BYTES = 3
VERSIONS = "document_id string, revision_sha256 string, body_sha256 string, source_uri string, title string, chunk_kind string, metadata_json string, source_updated_at string, indexed_at string"
CHUNKS = "body_sha256 string, chunk_kind string, ordinal int, start_byte long, end_byte long, start_line long, end_line long, body_text string, content_sha256 string"
GENERATIONS = "id long, state string, committed_at string, pipeline_fingerprint string"
ERRORS = "generation_id long, source_id string, connector_key binary, code string, detail string"
#: The search index: a row for each passage of a version, its tokens by blocks of passages, its literals, and how many passages and tokens
#: each version has; and the bloom's bits of each passage of a layout.
ENTRIES = "document_id string, revision_sha256 string, ordinal int, start_byte long, end_byte long, len int"
LITERALS = "literal string, field string, document_id string, revision_sha256 string, ordinal int, start_byte long"
SIZES = "document_id string, revision_sha256 string, passages int, tokens long"
INDEX = {"entries": ENTRIES, "postings": postings.POSTINGS, "literals": LITERALS, "sizes": SIZES, "slices": slices.SLICES}
TABLES = {"heads": HEADS, "changes": CHANGES, "blobs": BLOBS, "versions": VERSIONS, "chunks": CHUNKS, "generations": GENERATIONS, "errors": ERRORS} | INDEX
#: Tables that only grow, by files added to the manifest.
APPENDED = ("changes", "blobs", "versions", "chunks", "generations", "errors", *INDEX)
PASSAGE = slices.PASSAGE
#: So many folders of one level are merged into one of the next; heads' changes of 1 / FOLD of the base's bytes are folded into it.
FAN, FOLD = 8, 4
#: Texts are dealt out in rounds of so many stored bytes, at most ROUNDS of them, and a round's shuffle is gone before the next one's. A build
#: indexes what it has cut in INDEXED steps at most, and a search, which reads all texts in each round, has SCANS rounds at most.
ROUND_BYTES, ROUNDS, INDEXED, SCANS = 16 << 20, 16, 4, 8
#: So many audits run at once.
AUDITS = 2
#: Bytes of a page's JSON, and of the keys that a status reads.
RESPONSE_BYTES, KEY_BYTES = 512 * 1024, 64 << 20


class EvidenceError(RuntimeError):
    """code: scope_denied, not_found, invalid_bound, bound_below_passage, corrupt, invalid_deadline, invalid_mode or
    response_too_large."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Engine:
    """One index with one project and source."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, project: str = "default", index_id: str | None = None) -> "Engine":
        engine = cls(spark, path)
        if engine.store.versions():
            raise StoreError("the index exists")
        index_id, project_id = index_id or str(uuid.uuid4()), str(uuid.uuid5(uuid.NAMESPACE_URL, project))
        meta = {"index_id": index_id, "project": project, "project_id": project_id, "source_id": derive_source_id(index_id, project_id), "scope_revision": 0, "epoch": 0, "generation": None}
        meta |= {"pipeline_fingerprint": pipeline_fingerprint(), "last_success_at": None, "last_error": None, "passages": 0, "tokens": 0}
        tables = {n: {"files": [], "schema": spark.createDataFrame([], ddl).schema.json()} for n, ddl in TABLES.items()}
        engine.store.commit({"meta": meta, "tables": tables}, None)
        return engine

    def pin(self) -> dict:
        m = self.store.manifest()
        if m is None:
            raise StoreError("there is no index")
        if m["meta"]["pipeline_fingerprint"] != pipeline_fingerprint():
            raise StoreError("the index was built by another pipeline")
        return m

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        m = manifest or self.pin()
        if name == "blobs":
            return self._bodies(m)
        return self._current(m["tables"]["heads"]) if name == "heads" else self.store.table(name, m)

    def _bodies(self, m: dict, own: Column | None = None) -> DataFrame:
        """The blobs with their bodies, of which the store has the passages; without the body no text is read. own: a condition on body_sha256."""
        stored, chunks = (t if own is None else t.where(own) for t in (self.store.table(n, m) for n in ("blobs", "chunks")))
        return stored.join(_joined(chunks), "body_sha256", "left").select("body_sha256", F.coalesce("body", "joined").alias("body"), "bytes")

    def _current(self, entry: dict) -> DataFrame:
        """The heads: a base folder, and later ones with the heads that changed since, of which the last of a key counts.
        A key without active (null) is no more."""
        part = lambda files: self.store.table("heads", {"tables": {"heads": entry | {"files": files}}})
        base, later = entry["files"][:1], entry["files"][1:]
        if not later:
            return part(base)
        newest = self._newest(part(later))
        return part(base).join(newest.select("connector_key"), "connector_key", "left_anti").unionByName(newest.where("active IS NOT NULL"))

    @staticmethod
    def _newest(heads: DataFrame) -> DataFrame:
        return heads.groupBy("connector_key").agg(F.max_by(F.struct(*heads.columns), "generation_id").alias("h")).select("h.*")

    def prepare(self, files: DataFrame) -> DataFrame:
        """Files with body and revision hash and length."""
        meta = F.lit("{}")
        rows = files.withColumns({"metadata_json": meta, "body_sha256": body_sha256(F.col("body")), "body_len": F.octet_length("body").cast("long")})
        return rows.withColumn("revision_sha256", revision_sha256(F.col("body"), F.col("source_uri"), F.col("title"), meta, F.col("source_updated_at")))

    def plan(self, files: DataFrame, failures: DataFrame | None = None) -> dict:
        """What ingest would do; no generation is written."""
        m = self.pin()
        staged = self._stage(files, failures)
        try:
            ready, failures = self._staged(staged)
            snapshot.check_snapshot(ready, failures)
            return snapshot.plan_counts(self.table("heads", m), ready, failures).first().asDict()
        finally:
            self.store.remove(staged)

    def _stage(self, files: DataFrame, failures: DataFrame | None) -> str:
        """Documents and failures of one reading as a folder."""
        rows = self.prepare(files)
        if "code" not in rows.columns:
            rows = rows.withColumns({"code": F.lit(None).cast("string"), "detail": F.lit(None).cast("string")})
        if failures is not None:
            rows = rows.unionByName(failures.select("connector_key", "code", "detail"), allowMissingColumns=True)
        return self.store.put(rows, "staged")["files"][0]

    def _staged(self, folder: str) -> tuple[DataFrame, DataFrame]:
        return split(self.store.folder(folder))

    def ingest(self, files: DataFrame, failures: DataFrame | None = None, confirmed: snapshot.Confirmations = snapshot.Confirmations(), strict: bool = False, gone: DataFrame | None = None, quota: int | None = None) -> dict:
        """Applies a snapshot as a new generation, or as none if nothing changes. files may hold its failures too, as rows
        with a code and a detail (see filesystem.observe). With gone, a table of connector_key, files are only what
        changed and gone what was deleted: heads of other keys stay as they are and are read only to be counted.

        The snapshot is staged once, documents and failures from one reading, so that what is planned is what is applied,
        whatever its files do meanwhile.
        """
        with self.store.lock(), self.store.tidy():
            m = self.pin()
            staged = self._stage(files, failures)
            facts = None
            try:
                snapshot.check_documents(self._staged(staged)[0])
                own = F.element_at(F.split(F.input_file_name(), "/"), -1)
                facts = self.store.put(self.store.folder(staged).drop("body").withColumn("file", own), "staged")["files"][0]
                return self._commit(m, *self._staged(facts), staged, confirmed, strict, gone, quota)
            finally:
                for folder in (staged, facts):
                    if folder:
                        self.store.remove(folder)

    def _commit(self, m: dict, ready: DataFrame, failures: DataFrame, bodies: str, confirmed: snapshot.Confirmations, strict: bool, gone: DataFrame | None, quota: int | None) -> dict:
        """ready has no bodies, but tells the files of the staged folder of that name, where they are until the changed ones are taken from it."""
        heads = self.table("heads", m)
        snapshot.check_snapshot(ready, failures)
        touched, others = heads, None
        if gone is not None:
            keys = ready.select("connector_key").union(failures.select("connector_key")).union(gone.select("connector_key")).distinct()
            touched, others = heads.join(keys, "connector_key", "left_semi"), heads.join(keys, "connector_key", "left_anti").where("active")
        staged = self.store.put(snapshot.classify(touched, ready, failures), "staged")["files"][0]
        try:
            return self._apply_plan(m, ready, failures, bodies, touched, others, self.store.folder(staged), confirmed, strict, quota)
        finally:
            self.store.remove(staged)

    def _apply_plan(self, m: dict, ready: DataFrame, failures: DataFrame, bodies: str, touched: DataFrame, others: DataFrame | None, fate: DataFrame, confirmed: snapshot.Confirmations, strict: bool, quota: int | None) -> dict:
        meta = m["meta"]
        plan = snapshot.fate_counts(fate, touched, failures, others).first().asDict()
        if strict and plan["failed_documents"]:
            raise StoreError("strict ingest with failures")
        snapshot.enforce(plan, confirmed)
        snapshot.preflight(plan["estimated_write_bytes"], self.store.size(), quota, self.store.free())
        accepted = plan["projected_active_documents"] - plan["carried_forward_documents"]
        tables, generation = dict(m["tables"]), None
        if plan["would_create_generation"]:
            generation = (meta["generation"] or 0) + 1
            sizes = self._apply(tables, touched, ready, failures, bodies, fate, meta["source_id"], generation, plan)
            meta = meta | {"generation": generation, "epoch": meta["epoch"] + 1} | {k: meta[k] + sizes[k] for k in ("passages", "tokens")}
            for name in ("heads", *APPENDED):
                self._compact(tables, name)
        bad = None if not plan["failed_documents"] else failures.orderBy("connector_key").select("code", "detail").first()
        meta = meta | snapshot.source_status(meta, accepted, None if bad is None else bad.asDict(), _now())
        self.store.commit({"meta": meta, "tables": tables}, m["version"])
        return plan | {"generation": generation, "state": snapshot.ingest_state(plan["failed_documents"], accepted, generation)}

    def _apply(self, tables: dict, touched: DataFrame, ready: DataFrame, failures: DataFrame, bodies: str, fate: DataFrame, source: str, generation: int, plan: dict) -> dict:
        """Adds a generation's rows to tables; by how many passages and tokens the active documents grow. Only heads that
        change are written."""
        moved = fate.where("old_key IS NOT NULL").select(F.col("old_key").alias("connector_key"))
        fresh = name_uuid_column(F.concat_ws("/", F.lit(source), F.hex("connector_key")))
        found = fate.where(F.col("status").isin("new", "changed", "renamed", "reactivated")).select("connector_key", F.coalesce("document_id", fresh).alias("document_id"))
        named = ready.select("connector_key", "revision_sha256", "body_sha256", "chunk_kind").join(found, "connector_key")
        staged = self.store.put(ready.join(self._lacking(tables, named), "connector_key"), "staged")["files"][0]
        changed = self.store.folder(staged)
        if plan["changed_documents"]:
            self._store_texts(tables, changed, bodies)
        g, none = F.lit(generation).cast("long"), F.lit(None)
        sized = changed.join(self.table("sizes", {"tables": tables}), ["document_id", "revision_sha256"], "left").fillna(0, ["passages", "tokens"])
        new_heads = sized.select(F.lit(source).alias("source_id"), "connector_key", "document_id", "source_uri", "title", "chunk_kind", F.lit(True).alias("active"), "revision_sha256", "body_sha256", g.alias("generation_id"), "passages", "tokens")
        empty = {"revision_sha256": none.cast("string"), "body_sha256": none.cast("string"), "generation_id": g, "passages": F.lit(0), "tokens": F.lit(0).cast("long")}
        dead = touched.join(fate.where("status = 'tombstoned'").select("connector_key"), "connector_key").withColumns(empty | {"active": F.lit(False)})
        left = touched.join(moved, "connector_key").withColumns(empty | {"active": none.cast("boolean")})
        names = [f.split()[0] for f in HEADS.split(", ")]
        delta = self._add(tables, "heads", dead.select(names).unionByName(left.select(names)).unionByName(new_heads))
        prior = touched.join(delta.select("connector_key"), "connector_key", "left_semi")
        log = delta.where("active IS NOT NULL").select("document_id", F.col("revision_sha256").alias("next"), F.when(F.col("active"), "active").otherwise("tombstoned").alias("next_state"))
        more = {"changes": log.join(prior.select("document_id", F.col("revision_sha256").alias("prior")), "document_id", "left").select(g.alias("generation_id"), "document_id", "prior", "next", "next_state")}
        more["generations"] = self.spark.createDataFrame([(generation, "committed", _now(), pipeline_fingerprint())], GENERATIONS)
        if plan["failed_documents"]:
            more["errors"] = failures.select(g.alias("generation_id"), F.lit(source).alias("source_id"), "connector_key", "code", "detail")
        self._add_all(tables, more)
        self.store.remove(staged)
        signed = lambda rows, sign: rows.where("active").select(*[(F.lit(sign) * F.col(c)).cast("long").alias(c) for c in ("passages", "tokens")])
        return signed(delta, 1).unionByName(signed(prior, -1)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("passages", "tokens")]).first().asDict()

    def _compact(self, tables: dict, name: str) -> None:
        """Merges FAN folders of one level into one of the next, so that a table has some folders for each power of FAN and a row
        is written again as often as there are levels. Heads keep the last change of a key; changes of 1 / FOLD of the base's
        bytes are folded into a new base. What was there stays for readers of older generations, until vacuum()."""
        entry = tables[name]
        part = lambda files: self.store.table(name, {"tables": {name: entry | {"files": files}}})
        fixed = 1 if name == "heads" else 0
        while True:
            later = entry["files"][fixed:]
            full = next((x for x in sorted({self.store.level(f) for f in later}) if sum(self.store.level(f) == x for f in later) >= FAN), None)
            if full is None:
                break
            merged = [f for f in later if self.store.level(f) == full]
            rows = self._newest(part(merged)) if name == "heads" else _ordered(name, part(merged))
            new = self.store.put(rows, name, full + 1)["files"]
            entry = entry | {"files": [f for f in entry["files"] if f not in merged] + new}
        if name == "heads" and len(entry["files"]) > 1:
            base, *later = [self.store.size(f) for f in entry["files"]]
            if len(later) >= FAN // 2 and FOLD * sum(later) >= base:
                entry = entry | {"files": self.store.put(self._current(entry), name)["files"]}
        tables[name] = entry

    def _lacking(self, tables: dict, named: DataFrame) -> DataFrame:
        """(connector_key, document_id, blob, layout, version, other) of changed documents: whether the store lacks their body, its
        layout and the version. Of documents with the same body one tells of it, the others have null. other is a kind that the
        store has a layout of, if it has the body in other layouts alone. No text is read."""
        m, version = {"tables": tables}, ["document_id", "revision_sha256"]
        body = F.unhex("body_sha256").alias("own")  # hashes go through shuffles as bytes
        kinds = self.store.table("chunks", m).select(body, "chunk_kind").groupBy("own").agg(F.collect_set("chunk_kind").alias("kinds"))
        there = self.store.table("blobs", m).select(body, F.lit(True).alias("there")).distinct()
        first = named.select("connector_key", body, "chunk_kind").groupBy("own", "chunk_kind").agg(F.min("connector_key").alias("connector_key"))
        bodies = first.groupBy("own").agg(F.min("connector_key").alias("one"), F.collect_list(F.struct("connector_key", "chunk_kind")).alias("layouts"))
        told = bodies.join(there, "own", "left").join(kinds, "own", "left").select("one", F.col("there").isNull().alias("lacks"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.inline("layouts"))
        layout = ~F.array_contains("kinds", F.col("chunk_kind"))
        out = told.select("connector_key", F.when(F.col("one") == F.col("connector_key"), F.col("lacks")).alias("blob"), layout.alias("layout"), F.when(layout, F.array_min("kinds")).alias("other"))
        revision = F.unhex("revision_sha256").alias("revision")
        known = self.table("versions", m).select("document_id", revision, F.lit(True).alias("there"))
        made = named.select("connector_key", "document_id", revision).join(known, ["document_id", "revision"], "left")
        return made.select("connector_key", "document_id", F.col("there").isNull().alias("version")).join(out, "connector_key", "left")

    def _store_texts(self, tables: dict, documents: DataFrame, bodies: str) -> None:
        """Adds the blobs, versions, passages and index rows of changed documents that the store lacks (as _lacking() has
        told in their rows); what it has under the same names must be the same. Passages are cut from the documents' own bodies, in
        rounds, and those of the store are compared by their hashes, so none is shuffled. Staged texts are deleted when they have been taken on."""
        m = {"tables": dict(tables)}
        known = {n: self.store.table(n, m) for n in ("blobs", "versions", "chunks")}
        made = documents.select("document_id", "revision_sha256", "body_sha256", "source_uri", "title", "chunk_kind", "metadata_json", "source_updated_at", F.lit(_now()).alias("indexed_at"), "version")
        texts = self._staged(bodies)[0].select("connector_key", "body")
        short = texts.where(F.octet_length("body") <= STORED_BYTES)
        self._add(tables, "blobs", documents.where("blob").join(short, "connector_key", "left").withColumnRenamed("body_len", "bytes"))
        folders = self._staged_passages(documents, bodies)
        self.store.remove(bodies)
        held = self.store.folder(*folders).where("NOT layout")
        different = {"blob": known["blobs"].where(F.sha2("body", 256) != F.col("body_sha256")).select("body_sha256").join(documents.where("NOT blob").select("body_sha256"), "body_sha256", "left_semi")}
        different["version"] = snapshot.collisions(made.where("NOT version"), known["versions"], ["document_id", "revision_sha256"], ["body_sha256", "source_uri", "title", "chunk_kind", "metadata_json", "source_updated_at"])
        again = _digests(held)
        different["layout"] = again.exceptAll(_digests(known["chunks"]).join(again.select("layout").distinct(), "layout", "left_semi"))
        found = reduce(DataFrame.unionByName, [rows.select(F.lit(what).alias("what")) for what, rows in different.items()]).first()
        if found is not None:
            raise StoreError(f"a stored {found['what']} differs from the one of the same name in the snapshot")
        self._add(tables, "versions", made.where("version"))
        added: dict[str, str] = {}
        for own in [folders[k::INDEXED] for k in range(min(INDEXED, len(folders)))]:
            passages = self.store.folder(*own)
            self._add_all(tables, {"chunks": passages.where("layout")} | index_rows(passages.where("version"), passages.where("layout")), added)
            for folder in own:
                self.store.remove(folder)

    def _shares(self, bodies: str) -> list[tuple[DataFrame, Column, list[str]]]:
        """The rounds of a staged folder's bodies: (connector_key, body), which documents these are, and what of the folder no later round
        needs. A round has whole files, or where these are too few, a share of the keys."""
        files, rounds = self.store.files(bodies), _rounds(self.store.size(bodies), "connector_key", ROUNDS)
        texts = lambda *of: self.store.folder(*of).where("code IS NULL").select("connector_key", "body")
        if len(files) < min(len(rounds), ROUNDS // 2):
            return [(texts(bodies).where(own), own, []) for own in rounds]
        dealt: list[list[str]] = [[] for _ in range(min(len(rounds), len(files)))]
        for name in sorted(files, key=files.get, reverse=True):
            min(dealt, key=lambda names: sum(files[n] for n in names)).append(name)
        return [(texts(*(f"{bodies}/{n}" for n in names)), F.col("file").isin(names), [f"{bodies}/{n}" for n in names]) for names in dealt]

    def _staged_passages(self, documents: DataFrame, bodies: str) -> list[str]:
        """Folders of the passages of changed documents whose version or layout the store lacks or whose layout is to be compared, a round's
        each. A round's bodies are staged again while it is cut, and then they go."""
        folders, keys = [], ["body_sha256", *PASSAGE[:2], "source_uri", "title", "layout", "version"]
        for texts, own, done in self._shares(bodies):
            staged = self.store.put(texts.join(documents.where(own), "connector_key"), "staged")["files"][0]
            changed = self.store.folder(staged)
            kinds = F.array(F.expr("if(layout IS NOT NULL OR version, struct(chunk_kind, layout, version), NULL)"), F.expr("if(other IS NOT NULL, struct(other AS chunk_kind, false AS layout, false AS version), NULL)"))
            cuts = changed.select(*[c for c in changed.columns if c not in ("chunk_kind", "layout", "version")], F.inline(F.array_compact(kinds)))
            folders += self.store.put(_sized(_cut(cuts, keys)), "staged")["files"]
            for gone in (staged, *done):
                self.store.remove(gone)
        return folders

    def _add_index(self, tables: dict, versions: DataFrame) -> None:
        """Writes the index rows of versions and of all layouts. Their passages are joined and counted once."""
        chunks = self.table("chunks", {"tables": tables})
        folder = self.store.put(indexed_passages(versions, chunks), "staged")["files"][0]
        self._add_all(tables, index_rows(self.store.folder(folder), chunks))
        self.store.remove(folder)

    def _add_all(self, tables: dict, rows: dict[str, DataFrame], added: dict[str, str] | None = None) -> None:
        """Writes rows of several tables at once; each is a job of its own. added: the folders of tables that are written round by round."""
        added = {} if added is None else added
        with ThreadPoolExecutor(len(rows)) as pool:
            list(pool.map(lambda item: self._add(tables, *item, added.get(item[0])), rows.items()))
        added.update({name: tables[name]["files"][-1] for name in rows})

    def _add(self, tables: dict, name: str, rows: DataFrame, folder: str | None = None) -> DataFrame:
        """Writes rows as a further folder of a table, or into its folder of that name; returns what the folder has."""
        schema = StructType.fromDDL(TABLES[name])
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        rows = rows.sortWithinPartitions(*ORDERED[name]) if name in ORDERED else rows
        if folder is not None:
            self.store.extend(rows, name, folder)
            return self.spark.read.schema(schema).parquet(f"{self.store.path}/{folder}")
        entry = self.store.put(rows, name)
        tables[name] = {"files": tables[name]["files"] + entry["files"], "schema": tables[name]["schema"]}
        return self.spark.read.schema(schema).parquet(f"{self.store.path}/{entry['files'][0]}")

    def passages(self, manifest: dict | None = None) -> DataFrame:
        """The active passages."""
        m = manifest or self.pin()
        return self._heads(m).drop("passages").join(self.table("chunks", m), ["body_sha256", "chunk_kind"])

    def staged_passages(self, m: dict) -> DataFrame:
        """passages() as they are staged; vacuum() deletes them. Their texts are dealt out once, in rounds."""
        chunks, heads = self.table("chunks", m), self._heads(m).drop("passages")
        return self._kept([heads.where(own).join(chunks.where(own), ["body_sha256", "chunk_kind"]) for own in self._text_rounds(m)])

    def _text_rounds(self, m: dict, key: str = "body_sha256") -> list[Column]:
        return _rounds(sum(self.store.size(f) for f in m["tables"]["chunks"]["files"]), key, SCANS)

    def _kept(self, parts: list[DataFrame], name: str = "staged") -> DataFrame:
        """Rows of the same columns, staged part by part."""
        with self.store.tidy():
            return self.store.folder(*[self.store.put(rows, name)["files"][0] for rows in parts])

    def _heads(self, m: dict) -> DataFrame:
        return self.table("heads", m).where("active").select("source_id", "document_id", "source_uri", "title", "chunk_kind", "revision_sha256", "body_sha256", "passages")

    def find(self, queries: dict[str, str], limit: int = formats.RESULTS_DEFAULT, manifest: dict | None = None, exhaustive: bool = False, scope: Column | None = None) -> DataFrame:
        """The hits of queries from the stored index. Of postings and literals only the rows of the queries' terms and
        identifiers are read, statistics are the manifest's, and texts are read of candidates alone.

        The exact list is read within its budget (budget.hits, whose rows of fused_rank 0 tell about each query). exhaustive
        instead ranks every passage that holds an atom, found by the sliced blooms, titles and URIs (retrieval.hits); what it has
        found is staged step by step until vacuum(), texts are dealt out in rounds. scope is a condition on heads, which holds before any limit; statistics are of all documents."""
        m = manifest or self.pin()
        heads = self._heads(m) if scope is None else self._heads(m).where(scope)
        scores = self._scores(heads, retrieval.query_terms(queries), m, scope is not None)
        if exhaustive:
            near = self._kept([self._near(heads, sorted({t for q in queries.values() for t, _ in parse_query(q).atoms}), m)])
            exact = self._kept([retrieval.exact_matches(scopes.checked(self._texts(near.where(own), m, own)), queries) for own in self._text_rounds(m)])
            scores = self._kept([scores])
            found = exact.select(*retrieval.IDENTITY).union(scores.select(*retrieval.IDENTITY)).distinct()
            return retrieval.hits(exact, scores, self._spans(found, heads, m), limit)
        return budget.hits(self._candidates(heads, queries, m), self._ranked(scores, heads, m), queries, limit)

    def _ranked(self, scores: DataFrame, heads: DataFrame, m: dict) -> DataFrame:
        """The best scores of each query with their passages' spans."""
        best = retrieval.best(scores, ["score"]).where(F.col("rank") <= formats.CANDIDATES_MAX)
        return best.join(self._spans(best.select(*retrieval.IDENTITY).distinct(), heads, m), retrieval.IDENTITY)

    def _candidates(self, heads: DataFrame, queries: dict[str, str], m: dict) -> DataFrame:
        """The lists of budget.hits, with what their texts hold of the atoms."""
        at = ["source_id", "document_id", "start_byte"]
        live = heads.select("source_id", "document_id", "revision_sha256")
        held = [budget.identifier_candidates(self.table("literals", m).join(live, ["document_id", "revision_sha256"]), queries).drop("n")]
        plans = {k: budget.lists_of(q) for k, q in queries.items()}
        phrases = [(f"{k}\x1f{p.phrase(i)}", 0, " ".join(t), 1) for k, p in plans.items() for i, t in enumerate(p.phrases)]
        if phrases:
            own = F.split("query_id", "\x1f")
            scored = self._scores(heads, phrases, m, False).select(own[0].alias("query_id"), own[1].cast("int").alias("list"), *at, "score")
            held.append(budget.top(scored, ["score"]).select("query_id", "list", "place", *at))
        hinted = reduce(DataFrame.unionByName, held)
        first = heads.where("passages > 0").orderBy("source_id", "document_id").limit(formats.CANDIDATES_MAX)
        scanned = self._texts(first, m).orderBy(*at).limit(formats.CANDIDATES_MAX)
        texts = scopes.checked(self._texts(self._placed(hinted.select(*at).distinct(), heads), m).unionByName(scanned).dropDuplicates(at))
        lists = hinted
        if any(p.atoms for p in plans.values()):
            lists = lists.unionByName(budget.scan_candidates(scanned, queries))
        spans = texts.select(*at, "end_byte", "content_sha256")
        return lists.join(spans, at).join(retrieval.exact_matches(texts, queries), ["query_id", *at], "left")

    def _placed(self, found: DataFrame, heads: DataFrame) -> DataFrame:
        """Identities with their heads' columns."""
        return heads.join(found, ["source_id", "document_id"])

    def _texts(self, rows: DataFrame, m: dict, own: Column | None = None) -> DataFrame:
        """The passages of heads, or with start_byte those that start there. own: a condition on body_sha256 that all rows fulfil."""
        on = ["body_sha256", "chunk_kind", *(["start_byte"] if "start_byte" in rows.columns else [])]
        held = rows.select("source_id", "document_id", "source_uri", "title", *on)
        chunks = self.table("chunks", m) if own is None else self.table("chunks", m).where(own)
        return held.join(chunks.select("body_sha256", "chunk_kind", "start_byte", "end_byte", "body_text", "content_sha256"), on).drop("body_sha256", "chunk_kind")

    def _spans(self, found: DataFrame, heads: DataFrame, m: dict) -> DataFrame:
        """(identity, end_byte, content_sha256) of identities, without their texts."""
        chunks = self.table("chunks", m).select("body_sha256", "chunk_kind", "start_byte", "end_byte", "content_sha256")
        return self._placed(found, heads).join(chunks, ["body_sha256", "chunk_kind", "start_byte"]).select(*retrieval.IDENTITY, "end_byte", "content_sha256")

    def _near(self, heads: DataFrame, atoms: list[str], m: dict) -> DataFrame:
        """Heads' columns and start_byte of the passages that may hold an atom: by their blooms' bits, by title or URI, and all
        where an atom has no trigram."""
        entries = self.table("entries", m).select(*PASSAGE, "start_byte")
        named = reduce(lambda a, b: a | b, [F.contains(F.col(c), F.lit(t)) for t in atoms for c in ("title", "source_uri")], F.lit(any(len(t.encode()) < 3 for t in atoms)))
        near = heads.where(named).join(entries, ["document_id", "revision_sha256"])
        if long := [t for t in atoms if len(t.encode()) >= 3]:
            bits = slices.may_hold(self.table("slices", m), long).select(*slices.CUT).distinct()
            near = near.unionByName(heads.join(bits, slices.CUT[:2]).join(entries, PASSAGE).select(near.columns))
        return near.dropDuplicates(["source_id", "document_id", "start_byte"])

    def _scores(self, heads: DataFrame, terms: list[tuple], m: dict, scoped: bool) -> DataFrame:
        """retrieval.bm25_of_terms from the postings of the terms; scores are of all documents, rows of the heads alone."""
        meta = m["meta"]
        stats = lambda: self.spark.range(1).select(F.lit(meta["passages"]).alias("n"), F.lit(meta["tokens"] / max(1, meta["passages"])).alias("avg_len"))
        every = self._heads(m) if scoped else heads
        keyed = every.select("source_id", "document_id", F.lit(0).cast("long").alias("start_byte"))
        scores = retrieval.bm25_of_terms(self._counts(every, retrieval.phrases_of(terms), m), stats, terms, keyed)
        return scores.join(heads.select("source_id", "document_id"), ["source_id", "document_id"], "left_semi") if scoped else scores

    def _counts(self, heads: DataFrame, phrases: list[tuple[str, ...]], m: dict) -> DataFrame | None:
        """(identity, len, term, f) of phrases in the passages of heads."""
        if not phrases:
            return None
        keys = ["source_id", "document_id", "start_byte"]
        words = sorted({t for p in phrases for t in p})
        live = postings.postings_of(self.table("postings", m), words).join(heads, ["document_id", "revision_sha256"])
        counts = live.where(F.col("term").isin([p[0] for p in phrases if len(p) == 1])).select(*keys, "len", "term", "f")
        for p in (p for p in phrases if len(p) > 1):  # the index tells which passages hold all tokens; their texts tell how often in a row
            whole = live.where(F.col("term").isin(list(p))).groupBy(*keys, "len", "body_sha256", "chunk_kind", "title", "source_uri").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(p)))
            texts = retrieval.index_fields(whole.join(self.table("chunks", m).select("body_sha256", "chunk_kind", "start_byte", "body_text"), ["body_sha256", "chunk_kind", "start_byte"]))
            counts = counts.unionByName(texts.select(*keys, "len", F.lit(" ".join(p)).alias("term"), retrieval.phrase_count(list(p)).cast("long").alias("f")).where("f > 0"))
        return counts

    def search(self, text: str, limit: int = formats.RESULTS_DEFAULT, deadline_ms: int | None = None) -> DataFrame:
        """Hits in order with their citations and texts; duplicates as further rows that name their hit. A stored
        passage among them that is not what its hashes say fails the query. With a deadline the work is done here, see answer()."""
        m = self.pin()
        if deadline_ms is None:
            return self._cited(self.find({"q": text}, limit, m), m).orderBy("fused_rank")
        found, _ = self.answer(text, limit, deadline_ms, m)
        return found

    def _cited(self, found: DataFrame, m: dict) -> DataFrame:
        """Found passages with their texts and citations."""
        cited = citation(F.lit(m["meta"]["index_id"]), F.col("source_id"), F.col("document_id"), F.col("revision_sha256"), F.col("start_byte"), F.col("end_byte"))
        return found.join(scopes.checked(self.passages(m)), retrieval.IDENTITY).withColumn("citation", cited)

    def answer(self, text: str, limit: int = formats.RESULTS_DEFAULT, deadline_ms: int | None = formats.DEADLINE_DEFAULT_MS, manifest: dict | None = None) -> tuple[DataFrame, dict]:
        """(hits as search() has them, why it stopped and what it examined) of one query, ranked step by step: the exact
        candidates, then the lexical list. When the time is over the step's jobs are cancelled, and what has been ranked by then is told,
        with the stop reason deadline. None is no deadline. Texts of hits are read in any case."""
        if deadline_ms is not None and not formats.DEADLINE_MIN_MS <= deadline_ms <= formats.DEADLINE_MAX_MS:
            raise EvidenceError("invalid_deadline")
        end = None if deadline_ms is None else time.monotonic() + deadline_ms / 1000
        m = manifest or self.pin()
        heads, queries = self._heads(m), {"q": text}
        steps = [lambda: self._candidates(heads, queries, m), lambda: self._ranked(self._scores(heads, retrieval.query_terms(queries), m, False), heads, m).withColumns({"list": F.lit(-1), "place": F.col("rank")})]
        records, late = [], False
        for step in steps:
            got = None if late else self._in_time(step(), end)
            late |= got is None
            records += [r.asDict() for r in got or ()]
        blank = dict.fromkeys((*budget.MATCHED, "score"))
        told, *rows = budget.rank(budget.lists_of(text), [blank | r for r in records], limit, late)
        types = ", ".join(f"{n} {t}" for n, t in zip(retrieval.IDENTITY, ("string", "string", "long")))
        local = self.spark.createDataFrame([tuple("q" if n == "query_id" else r.get(n) for n in ("query_id", *budget.NAMES)) for r in rows], f"query_id string, {types}, {budget.BUDGET_COLUMNS}")
        found = self._cited(retrieval.explained(local), m).orderBy("fused_rank")
        return self.spark.createDataFrame(found.collect(), found.schema), {k: told[k] for k in ("stop_reason", "examined_exact", "examined_lexical", "examined_fallback")}

    def _in_time(self, rows: DataFrame, end: float | None) -> list | None:
        """rows, of at most some candidate lists, read now; None if the time ended first, when their jobs are cancelled."""
        sc, group, over, done = self.spark.sparkContext, uuid.uuid4().hex, threading.Event(), threading.Event()

        def stop() -> None:
            if not done.wait(max(0.0, end - time.monotonic())):
                over.set()
                while not done.is_set():  # also jobs that begin after the deadline
                    sc.cancelJobGroup(group)
                    done.wait(0.1)

        if end is None:
            return rows.collect()
        if time.monotonic() >= end:
            return None
        sc.setJobGroup(group, "search", interruptOnCancel=True)
        threading.Thread(target=stop, daemon=True).start()
        try:
            return rows.collect()
        except Exception:
            if not over.is_set():
                raise
            return None
        finally:
            done.set()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def page(self, text: str, limit: int = formats.RESULTS_DEFAULT, after: str | None = None, mode: str = "auto", explain: bool = False, deadline_ms: int | None = formats.DEADLINE_DEFAULT_MS) -> dict:
        """A page of an answer: the best RESULTS_MAX hits are ranked, and limit of them from the cursor on are told, up
        to PAGE_BODY_BYTES of text and RESPONSE_BYTES of JSON. A cursor holds only for the query and state it was made for."""
        if mode not in retrieval.MODES:
            raise EvidenceError("invalid_mode")
        if not 1 <= limit <= formats.RESULTS_MAX:
            raise ValueError("limit out of range")
        m = self.pin()
        meta = m["meta"]
        state = cursor.State(meta["index_id"], meta["scope_revision"], meta["epoch"], meta["generation"])
        config, asked = cursor.config_fingerprint("1"), cursor.query_fingerprint("v1", meta["project_id"], text, mode, explain)
        offset = cursor.decode(after, state, config, asked) if after else 0
        rows, stopped = self.answer(text, formats.RESULTS_MAX, deadline_ms, m)
        found = rows.collect()  # at most two candidate lists
        total = sum(r["hit"] is not None for r in found)
        local = self.spark.createDataFrame(found, rows.schema).coalesce(1)
        own = [r.asDict(recursive=True) for r in retrieval.page(local.where("hit is not null"), offset, limit).orderBy("hit").collect()]
        copies = [r for r in found if r["hit"] is None]
        results = [
            {
                "hit": r["hit"], "citation": r["citation"], "source_uri": r["source_uri"], "title": r["title"], "lines": [r["start_line"], r["end_line"]], "content": r["body_text"], "content_sha256": r["content_sha256"], "untrusted_content": True,
                "score": {"fused": r["units"] / formats.RRF_SCALE, "fusion_units": r["units"], "lists": [x if explain else {k: v for k, v in x.items() if k != "backend_score"} for x in r["lists"]]},
                "duplicates": [{"citation": c["citation"], "reason": c["reason"]} for c in copies if c["duplicate_of"] == r["fused_rank"]],
            }
            for r in own
        ]
        told = retrieval.report(local, {"q": text}, mode).first().asDict()
        out = {"results": results, **stopped, "retrievers": told["retrievers"], "requested_mode": mode, "effective_mode": told["effective_mode"], "generation": meta["generation"], "epoch": meta["epoch"]}
        out = evidence.trim(out | {"truncated": offset + len(results) < min(total, offset + limit)}, RESPONSE_BYTES)
        if out is None:
            raise EvidenceError("response_too_large")
        end = offset + len(out["results"])
        return out | {"next": cursor.encode(end, state, config, asked) if end < total and end < formats.RESULTS_MAX else None}

    def get(self, cited: str, most: int = formats.GET_DEFAULT, root: str | None = None) -> dict:
        """The bytes of a citation with its neighbours, of the revision it was made for. With the root of its directory also
        what its file says now: source_state, hash_verification and cited_verification."""
        m = self.pin()
        c = parse_citation(cited)
        if not 1 <= most <= formats.GET_MAX:
            raise EvidenceError("invalid_bound")
        if c["index_id"] != m["meta"]["index_id"] or c["source_id"] != m["meta"]["source_id"]:
            raise EvidenceError("scope_denied")
        head = self.table("heads", m).where(F.col("document_id") == c["document_id"]).first()
        if head is None:
            raise EvidenceError("scope_denied")
        v = self.table("versions", m).where((F.col("document_id") == c["document_id"]) & (F.col("revision_sha256") == c["revision"])).first()
        if v is None:
            raise EvidenceError("not_found")
        own = (F.col("body_sha256") == v["body_sha256"]) & (F.col("chunk_kind") == v["chunk_kind"])
        if most < c["end"] - c["start"]:
            raise EvidenceError("bound_below_passage")
        near = self.table("chunks", m).where(own & (F.col("end_byte") > c["start"] - most) & (F.col("start_byte") < c["end"] + most))  # no window reaches farther
        spans = [(r["start_byte"], r["end_byte"]) for r in near.orderBy("ordinal").select("start_byte", "end_byte").collect()]
        if (c["start"], c["end"]) not in spans:
            raise EvidenceError("not_found")
        first, last = evidence.expand_window(spans, spans.index((c["start"], c["end"])), most)
        s, e = spans[first][0], spans[last][1]
        part = F.substring("body", s + 1, e - s).alias("part")  # the body is hashed where it is, and only the window's bytes come here
        r = self.table("blobs", m).where(F.col("body_sha256") == v["body_sha256"]).select((F.sha2("body", 256) == F.col("body_sha256")).alias("whole"), part).first()
        if r is None or not r["whole"]:
            raise EvidenceError("corrupt")
        seen = {} if root is None else self._seen(head, c["revision"], root, m)
        return seen | {"source_uri": v["source_uri"], "title": v["title"], "start": s, "end": e, "cited": (c["start"], c["end"]), "content": bytes(r["part"]).decode("utf-8"), "layout": chunker_fingerprint(v["chunk_kind"])}

    def _seen(self, head: Row, cited: str, root: str, m: dict) -> dict:
        """What the file of a head says of it and of a cited revision."""
        own = (F.col("document_id") == head["document_id"]) & (F.col("revision_sha256") == head["revision_sha256"])
        now = self.table("versions", m).where(own).join(self.table("blobs", m).select("body_sha256", F.col("bytes").alias("size")), "body_sha256").select("document_id", "revision_sha256", "body_sha256", "source_updated_at", "size")
        target = now.withColumn("connector_key", F.lit(bytes(head["connector_key"])))
        found = probe(target, root, verify=True).join(now.select("document_id", "revision_sha256"), "document_id")
        state, same = F.col("state"), F.col("content_matches")
        told = {"source_state": evidence.source_state(state, same), "hash_verification": evidence.hash_verification(state, same), "cited_verification": evidence.cited_verification(F.lit(cited), F.col("revision_sha256"), state, same)}
        row = found.select(*(c.alias(k) for k, c in told.items())).first()
        return dict.fromkeys(told, "missing_since_ingest") if row is None else row.asDict()  # a head without a revision is of a file that was gone

    def project(self) -> dict:
        meta = self.pin()["meta"]
        return {k: meta[k] for k in ("project", "project_id", "scope_revision", "source_id", "generation")} | {"extensions": [*formats.EXTENSIONS]}

    def counts(self, manifest: dict | None = None) -> DataFrame:
        """(project, sources, documents, passages) of the index's project."""
        m = manifest or self.pin()
        meta = m["meta"]
        projects = self.spark.createDataFrame([(meta["project_id"], meta["project"])], "project_id string, project string")
        sources = self.spark.createDataFrame([(meta["project_id"], meta["source_id"])], "project_id string, source_id string")
        return scopes.project_counts(projects, sources, self.table("heads", m), self.passages(m))

    def status(self) -> dict:
        m = self.pin()
        meta = m["meta"]
        counts = self.counts(m).first()
        state = "never" if meta["last_success_at"] is None and not meta["last_error"] else "success" if not meta["last_error"] else "partial" if meta["last_success_at"] else "failed"
        problems = problem_codes(1, meta["generation"], counts["documents"], counts["passages"], 0, [state])
        keys = scopes.key_budget(self.table("heads", m).where("active"), "connector_key", KEY_BYTES).first()
        health = [{"source_id": meta["source_id"], "code": meta["last_error"]["code"], "detail": scopes.truncated(meta["last_error"]["detail"]), "observed_at": meta.get("last_error_at")}] if meta["last_error"] else []
        out = {"epoch": meta["epoch"], "generation": meta["generation"], "sources": counts["sources"], "documents": counts["documents"], "passages": counts["passages"], "source_state": state, "problems": problems}
        return out | {"health": health[: scopes.ISSUES], "key_bytes": keys["key_bytes"], "drift_possible": not keys["over_budget"]}

    def refresh(self, files, confirmed: snapshot.Confirmations = snapshot.Confirmations()) -> dict:
        """Ingests the snapshot that files() gives, a frame as filesystem.observe has it, once; what was committed last stays readable whatever happens."""
        try:
            done = self.ingest(files(), confirmed=confirmed)
        except Exception as error:  # whatever it is, the last generation is as it was
            return {"policy": "once_per_task", "state": "stale", "problem": scopes.truncated(f"{type(error).__name__}: {error}", 1024)}
        if done["state"] == "success":
            return {"policy": "once_per_task", "state": "refreshed", "problem": None}
        return {"policy": "once_per_task", "state": "partial", "problem": "the refresh was partial; the last safely committed evidence remains available"}

    def rebuild(self) -> None:
        """Cuts and indexes every stored version again, as a new manifest of the same generation; bodies, heads and the log stay."""
        with self.store.lock(), self.store.tidy():
            m = self.pin()
            tables = dict(m["tables"]) | {n: {"files": [], "schema": m["tables"][n]["schema"]} for n in ("chunks", *INDEX)}
            layouts = self.table("versions", m).select("body_sha256", "chunk_kind").distinct().join(self.table("blobs", m), "body_sha256").withColumn("kind", F.col("chunk_kind"))
            self._add(tables, "chunks", chunk(layouts, ["body_sha256", "kind"]).withColumnRenamed("kind", "chunk_kind"))
            self._add_index(tables, self.table("versions", m))
            self.store.commit({"meta": m["meta"] | {"epoch": m["meta"]["epoch"] + 1}, "tables": tables}, m["version"])

    def suggest(self, most: int = 32) -> str | None:
        """The first of the suggested queries whose search finds the passage it was taken from."""
        m = self.pin()
        picked = scopes.suggested_queries(self.passages(m), retrieval.IDENTITY).orderBy("place").limit(most).collect()
        asked = {str(r["place"]): r["query"] for r in picked if _parses(r["query"])}
        if not asked:
            return None
        found = self.find(asked, formats.RESULTS_DEFAULT, m).where("hit is not null").join(self.passages(m).select(*retrieval.IDENTITY, "source_uri", "content_sha256"), retrieval.IDENTITY)
        got = {(r["query_id"], r["source_uri"], r["content_sha256"]) for r in found.select("query_id", "source_uri", "content_sha256").collect()}
        return next((r["query"] for r in picked if (str(r["place"]), r["source_uri"], r["content_sha256"]) in got), None)

    def drift(self, root: str, verify: bool = False, deadline_ms: int | None = formats.DRIFT_DEADLINE_MS) -> DataFrame:
        """(document_id, state, content_matches) of the active documents against the files under root, probed in tasks
        within a time for each (None: however long it takes); unknown is what there was no time for."""
        m = self.pin()
        heads = self.table("heads", m).where("active")
        made = self.table("versions", m).join(self.table("blobs", m).select("body_sha256", F.col("bytes").alias("size")), "body_sha256").select("document_id", "revision_sha256", "source_updated_at", "size")
        return probe(heads.join(made, ["document_id", "revision_sha256"]), root, verify, deadline_ms)

    def _statistics(self, heads: DataFrame, sizes: DataFrame, meta: dict) -> DataFrame:
        """What the manifest says of the active passages, where their sizes add up to something else."""
        live = heads.where("active").select("document_id", "revision_sha256").join(sizes, ["document_id", "revision_sha256"])
        found = live.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("passages", "tokens")])
        return found.where((F.col("passages") != meta["passages"]) | (F.col("tokens") != meta["tokens"]))

    def doctor(self, manifest: dict | None = None) -> DataFrame:
        """(audit, detail) of every violation, staged until vacuum(). The bodies and then the passages that the index is derived from again are
        staged meanwhile; some audits run at once, and the shuffles of each go at its end."""
        m = manifest or self.pin()
        with self.store.tidy():
            rounds = [self.store.put(self._bodies(m, own), "bodies")["files"][0] for own in self._text_rounds(m)]
        t = {n: self.table(n, m) for n in TABLES} | {"blobs": self.store.folder(*rounds)}
        changes, layouts = t["changes"], t["chunks"].select("body_sha256", "chunk_kind").distinct()
        live = t["heads"].select("document_id", F.col("revision_sha256").alias("next"), F.when(F.col("active"), "active").otherwise("tombstoned").alias("next_state"), "generation_id")
        again = chunk(t["blobs"].join(layouts.withColumnRenamed("chunk_kind", "kind"), "body_sha256").withColumn("chunk_kind", F.col("kind")), ["body_sha256", "kind"]).withColumnRenamed("kind", "chunk_kind")
        hashed = lambda blooms: blooms.withColumn("bloom", F.sha2("bloom", 256))
        found = self._told([*{
            "layouts": audit.parity(*(rows.withColumn("body_text", F.sha2("body_text", 256)) for rows in (t["chunks"], again.select(t["chunks"].columns)))), "revisions": audit.revision_violations(t["versions"], t["blobs"]),
            "chunks": audit.chunk_violations(t["chunks"], ["body_sha256", "chunk_kind"]), "blobs": audit.blob_violations(t["blobs"]),
            "replay": audit.replay_violations(changes), "heads": audit.head_violations(live, changes), "orphan_heads": audit.orphan_heads(live, changes), "generations": audit.empty_generations(t["generations"], changes),
            "versions": scopes.missing_targets(t["versions"], t["blobs"], "body_sha256").select("document_id", "revision_sha256"), "layout_blobs": scopes.missing_targets(layouts, t["blobs"], "body_sha256"),
            "generation_ids": scopes.generation_counts(t["generations"]).where("coalesce(last, 0) <> n"), "statistics": self._statistics(t["heads"], t["sizes"], m["meta"]),
        }.items()])
        for folder in rounds:
            self.store.remove(folder)
        with self.store.tidy():
            staged = self.store.put(indexed_passages(t["versions"], t["chunks"]), "staged")["files"][0]
        passages = self.store.folder(staged)
        stored = {n: hashed(slices.unsliced(t[n])) if n == "slices" else postings.stored_digests(t[n]) if n == "postings" else t[n] for n in INDEX}
        made = plain_rows(passages, t["chunks"])
        found += self._told([*((f"index_{n}", audit.parity(stored[n], hashed(made[n]) if n == "slices" else made[n])) for n in INDEX if n != "literals"),
            *(("index_literals", audit.parity(t["literals"].where(own), plain_rows(passages.where(own), t["chunks"])["literals"])) for own in self._text_rounds(m, "document_id"))])
        self.store.remove(staged)
        return self.store.folder(*found)

    def _told(self, audits: list[tuple[str, DataFrame]]) -> list[str]:
        """Folders of (audit, detail) of the rows of audits."""
        told = lambda item: self.store.put(item[1].select(F.lit(item[0]).alias("audit"), F.to_json(F.struct("*")).alias("detail")), "audits")["files"][0]
        with self.store.tidy(), ThreadPoolExecutor(AUDITS) as pool:
            return list(pool.map(told, audits))


def _rounds(size: int, key: str, most: int) -> list[Column]:
    """Conditions that deal rows out by a key, one for each ROUND_BYTES of size, up to most."""
    n = min(most, 1 + size // ROUND_BYTES)
    return [F.pmod(F.xxhash64(key), F.lit(n)) == k for k in range(n)]


def indexed_passages(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The passages of versions, with how many tokens each has."""
    rows = versions.select("document_id", "revision_sha256", "body_sha256", "chunk_kind", "source_uri", "title").join(chunks, ["body_sha256", "chunk_kind"])
    return _sized(rows).select(*PASSAGE, "start_byte", "end_byte", "source_uri", "title", "body_text", "len")


def _sized(passages: DataFrame) -> DataFrame:
    return retrieval.index_fields(passages).withColumn("len", sum((F.size(n) for n in retrieval.FIELDS), F.lit(0))).drop(*retrieval.FIELDS)


def _joined(chunks: DataFrame) -> DataFrame:
    """(body_sha256, joined) of bodies with passages: those of one layout put together, what two of them share once."""
    parts = chunks.groupBy("body_sha256").agg(F.array_sort(F.collect_list(F.struct("chunk_kind", "start_byte", "end_byte", "body_text"))).alias("parts"))
    one = parts.withColumn("parts", F.filter("parts", lambda p: p["chunk_kind"] == F.col("parts")[0]["chunk_kind"]))
    after = "substring(cast(p.body_text AS binary), cast(1 + if(i = 0, 0, greatest(0, parts[i - 1].end_byte - p.start_byte)) AS int))"
    text = F.expr(f"cast(array_join(transform(parts, (p, i) -> cast({after} AS string)), '') AS binary)")
    mark = F.when(F.col("parts")[0]["start_byte"] == 3, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b""))
    return one.select("body_sha256", F.concat(mark, text).alias("joined"))


def _digests(chunks: DataFrame) -> DataFrame:
    """(layout, passage) of chunks: hashes, in bytes, of which layout it is of and of all that is stored of it."""
    one = lambda *of: F.unhex(F.sha2(F.to_json(F.struct(*of)), 256))
    rest = [f.name for f in _fields(CHUNKS)[2:] if f.name != "body_text"]
    return chunks.select(one("body_sha256", "chunk_kind").alias("layout"), one(*rest, F.sha2(F.col("body_text").cast("binary"), 256).alias("text")).alias("passage"))


def _cut(documents: DataFrame, keys: list[str]) -> DataFrame:
    """The passages of documents with their keys and chunk_kind."""
    return chunk(documents.withColumn("kind", F.col("chunk_kind")), [*keys, "kind"]).withColumnRenamed("kind", "chunk_kind")


def plain_rows(passages: DataFrame, cuts: DataFrame) -> dict[str, DataFrame]:
    """What the index has of indexed_passages and of layouts' passages, without blocks: entries, literals, sizes, the digest of each passage's
    postings, and the bloom of each passage of a layout, which tells of its text alone."""
    entries = passages.select([f.name for f in _fields(ENTRIES)])
    literals = passages.select(*PASSAGE, "start_byte", F.inline(passage_literals(F.col("title"), F.col("source_uri"), F.col("body_text"))))
    sizes = entries.groupBy("document_id", "revision_sha256").agg(F.count(F.lit(1)).cast("int").alias("passages"), F.sum("len").alias("tokens"))
    made = {"entries": entries, "literals": literals.select([f.name for f in _fields(LITERALS)]), "sizes": sizes}
    return made | {"postings": postings.digests(_tokens(passages)), "slices": cuts.select(*slices.CUT, quote_bloom_column(F.col("body_text")).alias("bloom"))}


def index_rows(passages: DataFrame, cuts: DataFrame) -> dict[str, DataFrame]:
    """The index tables' rows for indexed_passages and for layouts' passages: entries with token counts, literals, sizes, and the
    postings and the blooms' slices by blocks of passages."""
    plain = plain_rows(passages, cuts)
    return plain | {"postings": postings.posted(_tokens(passages)), "slices": slices.sliced(plain["slices"], slices.CUT)}


def _tokens(passages: DataFrame) -> DataFrame:
    return retrieval.index_fields(passages).withColumn("tokens", F.concat(*retrieval.FIELDS))


def _fields(ddl: str):
    return StructType.fromDDL(ddl)


#: Tables whose files are in order of a column, so that a scan for a value skips most of a file: each file by itself as it is added, all
#: files of a folder together where folders are merged. There a term that most passages hold is split by range.
ORDERED = {"postings": ["term", "block"], "literals": ["literal", *PASSAGE], "slices": ["bit", "block"]}


def _ordered(name: str, rows: DataFrame) -> DataFrame:
    keys = ORDERED.get(name)
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows


def _parses(text: str) -> bool:
    try:
        return bool(parse_query(text))
    except QueryError:
        return False


def problem_codes(sources: int, generation: int | None, documents: int, passages: int, building: int, states: list[str]) -> list[str]:
    found = (
        ("NO_SOURCE", sources == 0), ("NO_ACTIVE_GENERATION", generation is None), ("NO_ACTIVE_DOCUMENTS", generation is not None and documents == 0),
        ("NO_SEARCHABLE_PASSAGES", documents != 0 and passages == 0), ("INCOMPLETE_GENERATION", building != 0), ("SOURCE_SYNC_PARTIAL", any(s in ("partial", "failed") for s in states)),
    )
    return [code for code, holds in found if holds]
