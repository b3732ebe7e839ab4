"""Integrity audits as relations: every row that comes back is a violation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import revision_sha256


def replay_violations(changes: DataFrame) -> DataFrame:
    """Changes (document_id, generation_id, prior, next, next_state) that do not follow from the one before:
    prior is not the last next, prior equals next, or a tombstone without an active document."""
    w = Window.partitionBy("document_id").orderBy("generation_id")
    seen = changes.withColumns({"was": F.lag("next").over(w)})
    broken = ~F.col("prior").eqNullSafe(F.col("was"))
    same = F.col("prior").eqNullSafe(F.col("next"))
    dead = (F.col("next_state") == "tombstoned") & F.col("prior").isNull()
    code = F.when(broken, "prior_mismatch").when(same, "no_change").when(dead, "tombstone_without_head")
    return seen.withColumn("code", code).where("code is not null").select("document_id", "generation_id", "code")


def replayed_heads(changes: DataFrame) -> DataFrame:
    """The last change of each document."""
    last = F.max_by(F.struct("next", "next_state", "generation_id"), "generation_id").alias("h")
    return changes.groupBy("document_id").agg(last).select("document_id", "h.next", "h.next_state", "h.generation_id")


def head_violations(heads: DataFrame, changes: DataFrame) -> DataFrame:
    """Heads (document_id, next, next_state, generation_id) that differ from the replay, either way."""
    cols = ["document_id", "next", "next_state", "generation_id"]
    return parity(heads.select(*cols), replayed_heads(changes).select(*cols))


def parity(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either side, as multisets, that the other lacks; side says whose they are."""
    names = expected.columns
    both = stored.select(*names, F.lit(1).alias("_n")).unionByName(expected.select(*names, F.lit(-1).alias("_n")))
    more = both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")  # each side is dealt out once
    side = F.when(F.col("_n") > 0, "stored").otherwise("expected").alias("side")
    return more.select(*names, side, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_k")).drop("_k")


def empty_generations(generations: DataFrame, changes: DataFrame) -> DataFrame:
    return generations.where("state = 'committed'").join(changes.select(F.col("generation_id").alias("id")), "id", "left_anti")


def orphan_heads(heads: DataFrame, changes: DataFrame) -> DataFrame:
    """Heads without the change that made them; null versions compare equal."""
    h, c = heads.alias("h"), changes.alias("c")
    on = (F.col("h.document_id") == F.col("c.document_id")) & (F.col("h.generation_id") == F.col("c.generation_id")) & F.col("h.next").eqNullSafe(F.col("c.next"))
    return h.join(c, on, "left_anti")


def blob_violations(blobs: DataFrame) -> DataFrame:
    """Blobs (body_sha256, body) whose name is not their hash, as of one without a body, and names that occur twice."""
    wrong = blobs.where(~F.sha2("body", 256).eqNullSafe(F.col("body_sha256"))).select("body_sha256", F.lit("digest").alias("code"))
    twice = blobs.groupBy("body_sha256").count().where("count > 1").select("body_sha256", F.lit("duplicate").alias("code"))
    return wrong.unionByName(twice)


def chunk_violations(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Chunks whose text isn't their span or hash, ordinals with gaps, and gaps or wide overlaps between spans."""
    w = Window.partitionBy(*key).orderBy("ordinal")
    own = F.when(F.sha2(F.col("body_text").cast("binary"), 256) != F.col("content_sha256"), "content_hash").when(F.octet_length("body_text") != F.col("end_byte") - F.col("start_byte"), "span")
    spans = chunks.select(*key, "ordinal", "start_byte", "end_byte", own.alias("own"))  # texts are not dealt out
    seen = spans.withColumns({"n": F.row_number().over(w) - 1, "before": F.lag("end_byte").over(w), "from": F.lag("start_byte").over(w)})
    code = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("n") != F.col("ordinal"), "ordinal").when(F.col("start_byte") > F.col("before"), "gap")
        .when(F.col("before") - F.col("start_byte") > 180, "overlap").when(F.col("start_byte") <= F.col("from"), "order")
    )
    return seen.withColumn("code", code).where("code is not null").select(*key, "ordinal", "code")


def revision_violations(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Versions whose revision is not the hash of their fields and body, or whose URI is out of form."""
    rows = versions.join(blobs, "body_sha256")
    again = revision_sha256(F.col("body"), F.col("source_uri"), F.col("title"), F.col("metadata_json"), F.col("source_updated_at"))
    code = F.when(again != F.col("revision_sha256"), "revision").when(~F.col("source_uri").startswith("repo://"), "source_uri")
    return rows.withColumn("code", code).where("code is not null").select("document_id", "revision_sha256", "code")


def scan_statistics(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("body_bytes"), F.coalesce(F.max(F.octet_length("body")), F.lit(0)).alias("max_body"))


def store_statistics(blobs: DataFrame, chunks: DataFrame, versions: DataFrame, passages: DataFrame) -> DataFrame:
    """One row of what a scan of a store reads: blobs, layouts, chunks, versions and passages, the bodies' bytes and the
    longest of them, and the most layouts that one body has at once."""
    layouts = chunks.groupBy("body_sha256", "chunk_kind").agg(F.count(F.lit(1)).alias("n"))
    per_body = layouts.groupBy("body_sha256").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    cut = per_body.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("layouts"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.max("k"), F.lit(0)).alias("max_layouts"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = scan_statistics(blobs)
    for other in (cut, count(versions, "versions"), count(passages, "passages")):
        row = row.join(F.broadcast(other))  # one row each
    return row.select(*[F.col(c).cast("long").alias(c) for c in row.columns])


def ordered_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of all rows in order: each row's hash, hashed again in sorted order by blocks of a
    hash prefix, so that no task gathers every row."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    each = rows.select(row.alias("h"))
    blocks = each.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("b"))
    return blocks.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "b"))), ""), 256).alias("digest"))
