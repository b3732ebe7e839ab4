"""Shared pieces of the training-data operators: table access, words, shared-folder cuts."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
WHITE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile("[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP_PATTERN, -1), lambda w: w != "")


def free_names(taken: list[str], *names: str) -> list[str]:
    """names, with underscores behind while a column has them."""
    out, taken = [], [t.lower() for t in taken]
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder. An unset one is chosen only where driver and executors are
    one process; on a cluster a folder of the driver's machine would be of no use to the executors."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="tracequarry-")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(column: Column, n: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % n


def crc_of(value: object, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def saved(df: DataFrame) -> tuple[DataFrame, str]:
    """df written once as a table in the shared checkpoint folder and read back, and its path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path), path


_SAVED: list[str] = []


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables that saved() has written from the since-th on and that are still there, but for
    those to keep. For callers that have written the results that read them."""
    for path in _SAVED[since:]:
        if path not in keep:
            discard(spark, path)
    _SAVED[since:] = [p for p in _SAVED[since:] if p in keep]


def written() -> int:
    """How many tables saved() has written that release() has not deleted."""
    return len(_SAVED)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a saved table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of text, and rows, that an operator works on at once.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 500


def sliced(batches, column: int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Arrow batches cut to at most rows rows and about most bytes of a text column; a longer text has a batch of its own."""
    for b in batches:
        sizes, start, held = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist(), 0, 0
        for k, n in enumerate(sizes):
            if k > start and (held + n > most or k - start >= rows):
                yield b.slice(start, k - start)
                start, held = k, 0
            held += n
        if b.num_rows:
            yield b.slice(start)


def has_words(text: Column) -> Column:
    """Whether a text has anything but ASCII white space; null: no."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)) != ""
