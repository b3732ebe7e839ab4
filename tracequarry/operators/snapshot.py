"""Generations: the difference of a snapshot to the heads, with renames, guards and estimates.

heads: source_id, connector_key, document_id, active, revision_sha256, body_sha256.
ready: connector_key, revision_sha256, body_sha256, body_len. failures: connector_key, code, detail.
All of one source. Every step is a join or an aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from .scopes import STAMP_BYTES, TITLE_BYTES, URI_BYTES


class DeletionRefused(RuntimeError):
    """A snapshot that would delete too much without confirmation; code is empty or mass_delete."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def check_snapshot(ready: DataFrame, failures: DataFrame) -> None:
    """Keys occur once over documents and failures, and failures have a code and a detail."""
    keys = ready.select("connector_key").unionByName(failures.select("connector_key"))
    if not keys.groupBy("connector_key").count().where("count > 1").isEmpty():
        raise ValueError("a key occurs twice in the snapshot")
    if not failures.where("coalesce(code, '') = '' or coalesce(detail, '') = ''").isEmpty():
        raise ValueError("a failure has no code or detail")


def check_documents(ready: DataFrame) -> None:
    """Documents have a URI and a known chunk kind, no field beyond its bounds, and a body of UTF-8 without NUL."""
    text = F.col("body").cast("string")
    bad = {
        "source_uri": ~F.coalesce(F.octet_length("source_uri"), F.lit(0)).between(1, URI_BYTES),
        "title": F.coalesce(F.octet_length("title"), F.lit(0)) > TITLE_BYTES,
        "chunk_kind": ~F.coalesce(F.col("chunk_kind").isin(*sorted(set(formats.EXTENSIONS.values()))), F.lit(False)),
        "source_updated_at": F.coalesce(F.octet_length("source_updated_at"), F.lit(0)) > STAMP_BYTES,
        "body": F.col("body").isNull() | (F.octet_length("body") > formats.FILE_BYTES_MAX) | ~F.coalesce(F.is_valid_utf8(text), F.lit(True)) | F.coalesce(F.contains(text, F.lit("\0")), F.lit(False)),
    }
    wrong = ready.select("connector_key", *(c.alias(n) for n, c in bad.items())).where(reduce(lambda a, b: a | b, (F.col(n) for n in bad))).first()
    if wrong is not None:
        raise ValueError(f"{bytes(wrong['connector_key'])!r} has a {next(n for n in bad if wrong[n])} that is out of bounds")


def observed_keys(ready: DataFrame, failures: DataFrame) -> DataFrame:
    return ready.select("connector_key").union(failures.select("connector_key")).distinct()


def unseen_heads(heads: DataFrame, ready: DataFrame, failures: DataFrame) -> DataFrame:
    """Active heads that the snapshot neither has nor failed to read."""
    return heads.where("active").join(observed_keys(ready, failures), "connector_key", "left_anti")


def renames(heads: DataFrame, ready: DataFrame, failures: DataFrame) -> DataFrame:
    """(new_key, old_key, document_id): a new key and an unseen one with a body that no other new or unseen key has."""
    new = ready.join(heads.select("connector_key"), "connector_key", "left_anti")
    one_new = new.groupBy("body_sha256").agg(F.count(F.lit(1)).alias("n"), F.first("connector_key").alias("new_key")).where("n = 1").drop("n")
    old = unseen_heads(heads, ready, failures).where("body_sha256 is not null")
    one_old = old.groupBy("body_sha256").agg(F.count(F.lit(1)).alias("n"), F.first("connector_key").alias("old_key"), F.first("document_id").alias("document_id")).where("n = 1").drop("n")
    return one_new.join(one_old, "body_sha256").select("new_key", "old_key", "document_id")


def classify(heads: DataFrame, ready: DataFrame, failures: DataFrame) -> DataFrame:
    """(connector_key, status, document_id, body_len, old_key): unchanged, changed, reactivated, renamed, new,
    tombstoned, carried or failed. A rename counts as changed; its key is the new one, and old_key the one before."""
    moved = renames(heads, ready, failures)
    known = heads.select("connector_key", "active", F.col("revision_sha256").alias("old_revision"), F.col("document_id").alias("old_document"))
    kept = ready.join(known, "connector_key", "left").join(moved.select(F.col("new_key").alias("connector_key"), F.col("document_id").alias("moved_document"), "old_key"), "connector_key", "left")
    status = (
        F.when(F.col("moved_document").isNotNull(), "renamed").when(F.col("old_document").isNull(), "new").when(~F.col("active"), "reactivated")
        .when(F.col("old_revision").eqNullSafe(F.col("revision_sha256")), "unchanged").otherwise("changed")
    )
    rows = kept.select("connector_key", status.alias("status"), F.coalesce("moved_document", "old_document").alias("document_id"), F.col("body_len").cast("long").alias("body_len"), "old_key")
    gone = unseen_heads(heads, ready, failures).join(moved.select(F.col("old_key").alias("connector_key")), "connector_key", "left_anti")
    none = F.lit(0).cast("long").alias("body_len"), F.lit(None).cast(ready.schema["connector_key"].dataType).alias("old_key")
    lost = gone.select("connector_key", F.lit("tombstoned").alias("status"), "document_id", *none)
    failed = failures.select("connector_key").join(heads.where("active").select("connector_key", "document_id"), "connector_key", "left")
    bad = failed.select("connector_key", F.when(F.col("document_id").isNotNull(), "carried").otherwise("failed").alias("status"), "document_id", *none)
    return rows.unionByName(lost).unionByName(bad)


def empty_guard(prior: Column, projected: Column) -> Column:
    return (prior != 0) & (projected == 0)


def mass_guard(prior: Column, absent: Column) -> Column:
    return (absent != 0) & ((absent > 1000) | (4 * absent > prior))


def plan_counts(heads: DataFrame, ready: DataFrame, failures: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The plan as one row of counts, guards and the write estimate. others: active heads that the snapshot says
    nothing about, which stay; they count as active before and after."""
    return fate_counts(classify(heads, ready, failures), heads, failures, others)


def fate_counts(c: DataFrame, heads: DataFrame, failures: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """plan_counts from what classify() has found."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    changed = F.col("status").isin("new", "changed", "renamed", "reactivated")
    counts = c.agg(
        n("new").alias("new_documents"), n("new", "changed", "renamed", "reactivated").alias("changed_documents"), n("renamed").alias("renamed_documents"),
        n("unchanged").alias("unchanged_documents"), n("tombstoned").alias("tombstoned_documents"), n("carried").alias("carried_forward_documents"),
        n("carried", "failed").alias("failed_documents"), n("new", "changed", "renamed", "reactivated", "unchanged", "carried").alias("projected_active_documents"),
        F.coalesce(F.sum(F.when(changed, 6 * F.col("body_len") + 8192)), F.lit(0)).alias("_changed_bytes"),
    )
    prior = heads.agg(F.count_if("active").alias("_prior"))
    stay = heads.limit(0) if others is None else others
    staying = stay.agg(F.count(F.lit(1)).alias("_others"))
    failed = failures.agg(F.coalesce(F.sum(F.octet_length("connector_key") + F.octet_length("code") + F.octet_length("detail") + 1024), F.lit(0)).alias("_failed_bytes"))
    row = counts.join(F.broadcast(prior)).join(F.broadcast(failed)).join(F.broadcast(staying))  # one row each
    row = row.withColumns({"prior_active_documents": F.col("_prior") + F.col("_others"), "projected_active_documents": F.col("projected_active_documents") + F.col("_others")})
    return row.select(
        *[c for c in counts.columns if c[0] != "_"], "prior_active_documents",
        ((F.col("changed_documents") != 0) | (F.col("tombstoned_documents") != 0)).alias("would_create_generation"),
        empty_guard(F.col("prior_active_documents"), F.col("projected_active_documents")).alias("requires_empty_confirmation"),
        mass_guard(F.col("prior_active_documents"), F.col("tombstoned_documents")).alias("requires_mass_delete_confirmation"),
        (F.lit(65536) + F.col("_changed_bytes") + 8192 * F.col("tombstoned_documents") + F.col("_failed_bytes")).cast("long").alias("estimated_write_bytes"),
    )


@dataclass(frozen=True)
class Confirmations:
    allow_empty: bool = False
    allow_mass_delete: bool = False


def enforce(plan: dict, confirmed: Confirmations) -> None:
    if plan["requires_empty_confirmation"] and not confirmed.allow_empty:
        raise DeletionRefused("empty")
    if plan["requires_mass_delete_confirmation"] and not confirmed.allow_mass_delete:
        raise DeletionRefused("mass_delete")


def ingest_state(failed: int, accepted: int, generation: int | None) -> str:
    if not failed:
        return "success"
    return "failed" if generation is None and accepted == 0 else "partial"


def source_state(failed: Column, accepted: Column, generation: Column) -> Column:
    """ingest_state of rows."""
    return F.when(failed == 0, "success").when(generation.isNull() & (accepted == 0), "failed").otherwise("partial")


def source_status(before: dict, accepted: int, failure: dict | None, now: str) -> dict:
    """A source's last success and error after an ingest; without an accepted document the last success stays."""
    success = before.get("last_success_at") if failure and not accepted else now
    return {"last_success_at": success, "last_error": failure, "last_error_at": now if failure else None}


def content_blobs(rows: DataFrame, body_sha256: str, document: str, size: str) -> DataFrame:
    """(body_sha256, documents, first_doc, body_bytes) of the distinct bodies of rows."""
    return rows.groupBy(F.col(body_sha256).alias("body_sha256")).agg(F.count(F.lit(1)).alias("documents"), F.min(document).alias("first_doc"), F.max(size).alias("body_bytes"))


def collisions(rows: DataFrame, known: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys of rows that known has with another value in any of the fields; nulls are equal."""
    theirs = known.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    differs = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])
    return rows.select(*keys, *fields).join(theirs, keys).where(differs).select(*keys)


def storage_reserve(managed: int) -> int:
    return max(64 << 20, -(-managed // 10))


class CapacityError(RuntimeError):
    """code is quota_exceeded or insufficient_capacity; required is the number of bytes that were needed."""

    def __init__(self, code: str, required: int):
        super().__init__(f"{code}: {required} bytes are needed")
        self.code, self.required = code, required


def preflight(estimated: int, managed: int, quota: int | None, available: int | None) -> dict:
    """What a write of estimated bytes needs beside a recovery reserve; refused if the store or the quota lacks it."""
    reserve = storage_reserve(managed)
    needed = estimated + reserve
    if available is not None and available < needed:
        raise CapacityError("insufficient_capacity", needed)
    if quota is not None and quota < managed + needed:
        raise CapacityError("quota_exceeded", managed + needed)
    return {"reserve_bytes": reserve, "required_free_bytes": needed, "required_quota_bytes": None if quota is None else managed + needed}
