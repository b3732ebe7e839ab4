"""Quality rules from cross-document line frequency.

Lines are normalised (lower case, digits as 0, white space as one space, trimmed) and hashed. For
each host the distinct documents that hold a line are counted; lines above the host's limit, a share of
its documents with a small floor, are removed, and a document that keeps too small a share of its words is rejected. Per-document rules
come first. DataFrame functions only.

Defined results: null text has no words and fails the base rules; a null host is a host of its own;
rows that repeat a doc_id are one document in a line's count and share the words that any of them lost;
rows without doc_id are one document of each host; a line at the limit stays, and equal lines of a
document go together; very long texts are arrays of their words and lines in one row; an empty table
gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_PATTERN, WHITE, saved, words

#: A line is boilerplate of its host in more documents than LINE_FLOOR that are more than LINE_SHARE percent of the host's.
LINE_FLOOR, LINE_SHARE = 10, 10
#: A document is depleted if less than this percentage of its words is left.
LEAST_LEFT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE)) != ""


def normalise(lines: Column) -> Column:
    """Lines with white space as one space, digits as 0 and letters in lower case. Each step has its own
    pass over the array, so nothing is computed twice; replacements run only where they find something."""
    low = F.transform(lines, F.lower)
    spaced = F.transform(low, lambda x: F.when(F.regexp_like(x, F.lit(r"[\x09-\x0D]|  ")), F.regexp_replace(x, GAP_PATTERN, " ")).otherwise(x))
    plain = F.transform(spaced, lambda x: F.when(F.regexp_like(x, F.lit("[1-9]")), F.regexp_replace(x, "[1-9]", "0")).otherwise(x))
    return F.transform(plain, F.btrim)


def symbols(text: Column) -> Column:
    """Number of the characters of SYMBOLS in a text."""
    left = text
    for c in SYMBOLS:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length(text) - F.length(left)


def repeated_window_words(ws: Column, keys: Column, n: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more. keys: the windows' hashes.

    Sorting (hash, position) puts equal windows side by side; the positions kept are then swept once.
    """
    pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # in sorted order a window is repeated if it equals the one before or after it
    shifted_down = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), pairs)
    shifted_up = F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1)))
    rows = F.slice(F.arrays_zip(pairs.alias("a"), shifted_down.alias("b"), shifted_up.alias("c")), 1, F.greatest(F.size(pairs), F.lit(1)))
    same = lambda x: (F.coalesce(x["a"]["h"] == x["b"]["h"], F.lit(False)) | F.coalesce(x["a"]["h"] == x["c"]["h"], F.lit(False)))
    at = F.array_sort(F.transform(F.filter(rows, same), lambda x: x["a"]["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))
    return F.aggregate(at, start, step, lambda acc: acc["n"])


def base_stats(docs: DataFrame) -> DataFrame:
    """doc_id, source and the per-document statistics."""
    body = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("_t"))
    listed = body.withColumn("_w", words(F.col("_t"))).withColumn("_lines", F.filter(F.split("_t", "\n", -1), has_word))
    hashed = listed.withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_n", F.size("_w"))
    no = F.array().cast("array<bigint>")
    # the hash of 8 words by joining those of halves three times; slots past the end pair with null and are cut off
    halves = hashed.withColumn("_h2", F.zip_with("_wh", F.slice("_wh", 2, F.greatest(F.col("_n"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    quarters = halves.withColumn("_h4", F.zip_with("_h2", F.slice("_h2", 3, F.greatest(F.col("_n"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    eighths = F.zip_with("_h4", F.slice("_h4", 5, F.greatest(F.col("_n"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    keyed = quarters.withColumn("_k", F.when(F.col("_n") >= WINDOW, F.slice(eighths, 1, F.col("_n") - (WINDOW - 1))).otherwise(no))
    again = F.when(F.size(F.array_distinct("_k")) < F.size("_k"), repeated_window_words(F.col("_w"), F.col("_k"), F.col("_n"))).otherwise(F.lit(0))
    long = lambda c: c.cast("long")
    chars = F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    return keyed.select(
        "doc_id", "source", long(F.col("_n")).alias("n_words"), long(chars).alias("word_chars"), long(symbols(F.col("_t"))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), long(again).alias("n_repeat_words"),
    )


def text_lines(docs: DataFrame) -> DataFrame:
    """docs with _lines, the lines that have a word."""
    return docs.withColumn("_lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), has_word))


def host_of(docs: DataFrame) -> Column:
    return F.coalesce("source", F.lit("")).alias("source")


def host_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, words): the lines of each document of a host and the words of all their occurrences,
    written once as a narrow table that both the counts and the removal read."""
    both = F.zip_with(normalise(F.col("_lines")), F.col("_lines"), lambda k, x: F.struct(F.xxhash64(k).alias("key"), F.size(words(x)).alias("words")))
    return saved(text_lines(docs).select("doc_id", host_of(docs), F.inline(both)))[0]


def frequent_lines(lines: DataFrame, hosts: DataFrame, floor: int = LINE_FLOOR, share: int = LINE_SHARE) -> DataFrame:
    """(source, key) of the lines in more than floor distinct documents of a host that are more than share percent of
    its documents. hosts: source and documents.

    Documents are made distinct by (source, key, doc_id), which spreads a common line; the counts are
    then partial ones for each task, so a line that a third of all documents hold is a row of each. Only lines above the
    floor meet their host's number.
    """
    each = lines.select("source", "key", "doc_id").distinct()
    often = each.groupBy("source", "key").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > floor)
    return often.join(hosts, "source").where(100 * F.col("d") > share * F.col("documents")).select("source", "key")


def host_sizes(docs: DataFrame) -> DataFrame:
    """(source, documents): the distinct documents of each host."""
    return docs.select(host_of(docs), "doc_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def removed_words(lines: DataFrame, hosts: DataFrame, floor: int = LINE_FLOOR, share: int = LINE_SHARE) -> DataFrame:
    """(doc_id, n_removed) for documents that lose a line: the words of all its occurrences."""
    hit = lines.join(frequent_lines(lines, hosts, floor, share), ["source", "key"], "left_semi")
    return hit.groupBy("doc_id").agg(F.sum("words").alias("n_removed"))


def quality_report(docs: DataFrame, floor: int = LINE_FLOOR, share: int = LINE_SHARE, least_left: int = LEAST_LEFT) -> DataFrame:
    stats = base_stats(docs)
    lost = F.coalesce("n_removed", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = stats.join(removed_words(host_lines(docs), host_sizes(docs), floor, share), "doc_id", "left")
    depleted = 100 * (F.col("n_words") - lost) < least_left * F.col("n_words")
    return left.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), lost.cast("long").alias("n_line_words_removed"))
