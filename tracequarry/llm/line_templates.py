"""Line dedup with a log-template tree.

A line's tokens are its words; a token with a digit is a variable field, written <*>. The tree has
a fixed depth: first the token count, then the leading tokens, which give the leaf; missing levels
of lines shorter than that are empty. In a leaf that
many documents reach, a token that too few of the leaf's lines hold at its place is a variable
field too. A line is an instance of the template so found if enough of its tokens stay fixed.
Templates that recur across documents are dropped everywhere but at their first place (smallest
doc_id, then line). DataFrame functions only.

Defined results: null text has no lines and stays null; lines without words are kept; rows that repeat a
doc_id share their verdicts by line number; rows without doc_id stay as they are; of lines at equal first
places the smaller doc_id's and then the earlier one stays; very long texts are arrays of their lines in
one row; an empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, words

#: Leading tokens in the tree.
DEPTH = 3
#: A template recurs, and a token is fixed, from this count on.
LEAST = 10
#: Percentage of fixed tokens that a template needs.
FIXED = 60
FIELD = "<*>"


def masked(token: Column) -> Column:
    return F.when(F.regexp_like(token, F.lit("[0-9]")), FIELD).otherwise(token)


def leaf_of(tokens: Column, depth: int) -> Column:
    """Hash of the path in the tree; null for lines without words."""
    path = [masked(F.get(tokens, F.lit(i))) for i in range(depth)]
    return F.when(F.size(tokens) >= 1, F.xxhash64(F.size(tokens), *path))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_leaves(text: Column, depth: int) -> Column:
    """The leaf of each line of a text, as an array."""
    return F.transform(F.transform(text_lines(text), words), lambda t: leaf_of(t, depth))


def candidate_lines(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(doc_id, pos, leaf, tokens) of the lines in leaves that enough documents reach.

    Only (doc_id, pos, leaf) is dealt out to find them; texts meet their own few positions by doc_id.
    """
    leaves = line_leaves(F.col("text"), depth)
    each = docs.select(F.explode(F.array_distinct(leaves)).alias("leaf")).where("leaf is not null")
    active = each.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("leaf")
    placed = docs.select("doc_id", F.posexplode(leaves).alias("pos", "leaf")).where("leaf is not null")
    wanted = placed.join(active, "leaf", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "leaf")).alias("at"))
    both = docs.select("doc_id", "text").join(wanted, "doc_id")
    lines = both.select("doc_id", text_lines(F.col("text")).alias("lines"), "at")
    line = lambda x: F.transform(words(F.get(F.col("lines"), x["pos"])), masked)
    return lines.select("doc_id", F.inline(F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["leaf"].alias("leaf"), line(x).alias("tokens")))))


def templates(candidates: DataFrame, least: int = LEAST, fixed: int = FIXED) -> DataFrame:
    """(leaf, line, template): for each distinct candidate line that has one, by hashes.

    Equal lines are counted first, so the token counts see one row for each distinct line.
    """
    distinct = candidates.groupBy("leaf", F.xxhash64("tokens").alias("line")).agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    spread = distinct.select("leaf", "line", "n", F.posexplode("tokens").alias("p", "token"))
    support = spread.groupBy("leaf", "p", "token").agg(F.sum("n").alias("s")).where(F.col("s") >= least)
    kept = spread.where(F.col("token") != FIELD).join(support, ["leaf", "p", "token"])
    size = distinct.select("leaf", "line", F.size("tokens").alias("size"))
    shape = kept.groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("p", "token"))).alias("shape"))
    enough = 100 * F.size("shape") >= fixed * F.col("size")
    return shape.join(size, ["leaf", "line"]).where(enough).select("leaf", "line", F.xxhash64("leaf", "shape").alias("template"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, fixed: int = FIXED) -> DataFrame:
    """(doc_id, drops): the numbers of the lines that go, an array for each document that loses one."""
    candidates = cut(candidate_lines(docs.where("doc_id is not null"), depth, least))
    known = candidates.select("doc_id", "pos", "leaf", F.xxhash64("tokens").alias("line")).join(templates(candidates, least, fixed), ["leaf", "line"])
    per_doc = known.groupBy("template", "doc_id").agg(F.min("pos").alias("pos"))
    recurring = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("d"), F.min(F.struct("doc_id", "pos")).alias("first")).where(F.col("d") >= least)
    gone = known.join(recurring, "template").where(F.struct("doc_id", "pos") != F.col("first"))
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("drops"))


def drop_recurring(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, fixed: int = FIXED, count: str = "n_dropped") -> DataFrame:
    """docs with the text that is left, and the number of lines that went in a further column named count, which docs
    must not have."""
    mark, lines = free_names(docs.columns, "drops", "lines")
    marked = docs.join(dropped_lines(docs.select("doc_id", "text"), depth, least, fixed).withColumnRenamed("drops", mark), "doc_id", "left")
    cut_up = marked.withColumn(lines, F.when(F.col(mark).isNotNull(), text_lines(F.col("text"))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(mark))
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n"))
    gone = F.coalesce(F.when(F.col(mark).isNotNull(), F.size(mark)), F.lit(0)).cast("long").alias(count)
    return cut_up.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), gone)


def dedup_report(docs: DataFrame) -> DataFrame:
    """A row per document: its lines, the dropped ones, and the SHA-256 of what is left."""
    n = F.coalesce(F.size(text_lines(F.col("text"))), F.lit(0))
    counted = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"))
    return drop_recurring(counted).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
