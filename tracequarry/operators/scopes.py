"""Scopes, counts and guards: what belongs to a project, how much of it there is, and whether it is fit to be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a passage's fields, in bytes.
URI_BYTES, TITLE_BYTES, CONTENT_BYTES, STAMP_BYTES = 16 * 1024, 16 * 1024, 1800, 128
#: Health issues that a status tells, and bytes of each one's detail.
ISSUES, DETAIL_BYTES = 64, 4096


def project_counts(projects: DataFrame, project_sources: DataFrame, heads: DataFrame, passages: DataFrame) -> DataFrame:
    """(project, sources, documents, passages) of every project, those without sources too.

    projects: project_id, project. project_sources: project_id, source_id. heads: source_id, document_id,
    active. passages: document_id. Each side is aggregated before it is joined, the largest map-side first.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    per_document = passages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    per_source = heads.where("active").join(per_document, "document_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("passages"))
    per_project = project_sources.join(per_source, "source_id", "left").groupBy("project_id").agg(F.count(F.lit(1)).alias("sources"), F.sum("documents").alias("documents"), F.sum("passages").alias("passages"))
    return projects.join(per_project, "project_id", "left").select("project", *map(zero, ("sources", "documents", "passages")))


def in_scope(rows: DataFrame, project_sources: DataFrame, project_id) -> DataFrame:
    """Rows whose source belongs to the project."""
    return rows.join(project_sources.where(F.col("project_id") == project_id).select("source_id"), "source_id", "left_semi")


def existing_documents(documents: DataFrame, heads: DataFrame, versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """documents with what is known of their head, its version and its body, null where there is none.
    heads: document_id, version_id. versions: version_id, body_id. blobs: body_id."""
    return documents.join(heads, "document_id", "left").join(versions, "version_id", "left").join(blobs, "body_id", "left")


def missing_targets(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose key no target has; null keys are missing too."""
    return rows.join(targets.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").where("_there is null").drop("_there")


def source_rows(sources: DataFrame, heads: DataFrame, errors: DataFrame) -> DataFrame:
    """sources with their numbers of active documents and of logged errors, by two aggregates joined from the left."""
    active = heads.where("active").groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))
    failed = errors.groupBy("source_id").agg(F.count(F.lit(1)).alias("errors"))
    return sources.join(active, "source_id", "left").join(failed, "source_id", "left").fillna(0, ["documents", "errors"])


def ordinals(rows: DataFrame, group: str, key: str, span: Column) -> DataFrame:
    """rows with their ordinal from 0 in order of key within group. span is a coarse, order-preserving part of the
    key: rows are ranked within (group, span) and the spans' counts are added up, so no task needs a whole group."""
    cut = rows.withColumn("_span", span)
    sizes = cut.groupBy(group, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(group, "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_span").orderBy(key)) - 1
    return cut.withColumn("_at", within).join(starts, [group, "_span"]).withColumn("ordinal", (F.col("_before") + F.col("_at")).cast("long")).drop("_span", "_at", "_before")


def field_guards(bounds: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """For each field whether its bytes are out of (least, most); null counts as no bytes."""
    return {c: ~F.coalesce(F.octet_length(c), F.lit(0)).between(*b) for c, b in bounds.items()}


def passage_projection(passages: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """passages with passage_invalid, whether any field is out of its bounds, and such fields blanked, so that
    nothing oversized is carried on."""
    bad = field_guards(bounds)
    blank = {c: F.when(b, F.lit("")).otherwise(F.col(c)) for c, b in bad.items()}
    return passages.withColumn("passage_invalid", reduce(lambda x, y: x | y, bad.values(), F.lit(False))).withColumns(blank)


PASSAGE_BOUNDS = {"source_uri": (1, URI_BYTES), "title": (0, TITLE_BYTES), "body_text": (1, CONTENT_BYTES), "content_sha256": (64, 64)}


def checked(passages: DataFrame) -> DataFrame:
    """passages, of which the first that is out of bounds, whose span is not its text's length or whose hash is
    not its text's fails the query."""
    wrong = reduce(lambda x, y: x | y, field_guards(PASSAGE_BOUNDS).values())
    code = (
        F.when(wrong, "stored search candidate exceeds field bounds")
        .when(F.octet_length("body_text") != F.col("end_byte") - F.col("start_byte"), "stored span is not its content's length")
        .when(F.sha2(F.col("body_text").cast("binary"), 256) != F.col("content_sha256"), "stored content hash is not its content's")
    )
    return passages.withColumn("body_text", F.when(code.isNotNull(), F.raise_error(F.concat(F.lit("corrupt: "), code))).otherwise(F.col("body_text")))


def more_than(rows: DataFrame, n: int) -> bool:
    """Whether there are more than n rows, by reading at most n + 1."""
    return rows.limit(n + 1).count() > n


def key_budget(rows: DataFrame, key: str, most: int) -> DataFrame:
    """One row: the bytes of all keys and whether they are over the budget."""
    total = F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).cast("long")
    return rows.agg(total.alias("key_bytes"), (total > most).alias("over_budget"))


def generation_counts(generations: DataFrame) -> DataFrame:
    """One row: the largest id and the number of committed generations."""
    return generations.where("state = 'committed'").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))


def truncated(text: str, most: int = DETAIL_BYTES) -> str:
    """The longest beginning of a text of at most so many bytes that ends with a whole character."""
    return text.encode()[:most].decode("utf-8", "ignore")


def suggested_queries(passages: DataFrame, order: list[str], sample: int = 64) -> DataFrame:
    """(query, source_uri, content_sha256, place) of a sample of passages: their Markdown headings first, then their
    identifier literals, each 2 to 256 printable ASCII bytes."""
    from ..functions.text import identifier_literals

    first = passages.select(*order, "source_uri", "body_text", "content_sha256").orderBy(*order).limit(sample)
    lines = F.split(F.regexp_replace("body_text", "^﻿+", ""), "\n", -1)
    heading = F.regexp_extract(F.col("line"), r"^\s*#{1,6} (.*)$", 1)
    headings = first.select("*", F.posexplode(lines).alias("at", "line")).select(F.lit(0).alias("kind"), *order, "at", F.trim(F.regexp_replace(heading, r"^\s+|\s+$", "")).alias("query"), "source_uri", "content_sha256")
    literals = first.select("*", F.posexplode(identifier_literals(F.col("body_text"))).alias("at", "query")).select(F.lit(1).alias("kind"), *order, "at", "query", "source_uri", "content_sha256")
    both = headings.unionByName(literals).where(F.regexp_like("query", F.lit(r"^[\x20-\x7e]{2,256}$")))
    place = F.row_number().over(Window.orderBy("kind", *order, "at"))  # rows of at most sample passages
    return both.withColumn("place", place).select("query", "source_uri", "content_sha256", "place")
