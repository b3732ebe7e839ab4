"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of documents. run() writes each stage's rows as Parquet in the shared checkpoint
folder and reads them back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import decontam, line_templates, ngram_join, piece_viterbi, toxicity
from tracequarry.llm.common import discard, free_names, has_words, release, saved, table, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts have a score like any other; repeated rows share their verdict."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for their first place, and documents that had words and
    have none left; n_chars follows the text. Null texts and rows without doc_id stay as they are, very long texts
    are read whole, and columns of any name pass through."""
    (count,) = free_names(docs.columns, "n_dropped")
    left = line_templates.drop_recurring(docs, count=count)
    kept = left.where((F.col(count) == 0) | has_words(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop(count)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; documents without words and rows without doc_id stay."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip; null and empty texts have no tokens."""
    return piece_viterbi.token_report(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", recurring_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding", token_ids),
]

#: Model scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages wrote goes as soon as the next one has been written; the last table stays for the caller."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        before = written()
        docs, path = saved(stage(spark, docs, sf_dir))
        release(spark, before, keep=(path,))
        if last:
            discard(spark, last)
        last = path
    return docs
