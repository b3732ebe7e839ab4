"""Late-arrival partition overwrite: day files of sales that late rows bring up to date, day by day.

A layout keeps the row of each sale that arrived last and cuts each day, in order of time and sale, into files of a
fixed number of rows. write_layout() writes one below a folder: layout_day=D/layout_file=K/ holds one
Parquet file with the table's own columns. write_index() writes the record index, a table that is
hash-partitioned (bucketed) by sale_id and tells each sale's day and file. overwrite() takes late rows: the last of each sale
probes the index, which is not shuffled for that, and so is tagged with the day and file that hold the sale. Days where a winner
goes or whose file held its sale are dirty. Their files are read again, without the tagged sales, merged with the
winners, cut again and written beside the layout; then each dirty day's folder is replaced. Other folders are not touched.

No day is sorted in one task: rows are dealt by range of (day, time, sale), each task's share of a day is
counted, and the counts give each row its place in the day. Each file is written by one task, row by row.
What goes to the driver are those counts' days: as many as there are dirty days.

Defined results: of rows of a sale that arrived at one time the one of latest sold_at wins, then by the other
columns in order, so repeated rows leave one; a row that never arrived (null) is late, and loses to any
that did; rows without sale_id are one sale; rows without sold_at are of day -1; an empty table gives no files; extra columns
are written like the others; names of the folder's own columns get underscores while they clash; texts of any length
are written as they are. Days and times are those of UTC for columns with and without a zone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import ensure_checkpoint_dir, free_names, partitions, saved

#: Rows before this time are the starting layout's; a file holds one row more for so many rows of the table.
CUTOFF_MICROS, ROWS_A_FILE = 1_710_892_800_000_000, 1100  # 2024-03-20 00:00:00
_DAY = 86_400_000_000
_DIGEST = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, ids_sha256 string"
_DIGEST_SCHEMA = pa.schema([(n, pa.string() if n in ("path", "ids_sha256") else pa.int64()) for n in (x.split()[0] for x in _DIGEST.split(", "))])


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time of df, with or without a zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def day_of(at: Column) -> Column:
    """Whole days since 1970 of microseconds; -1 for none."""
    return F.coalesce(F.call_function("div", at - F.pmod(at, F.lit(_DAY)), F.lit(_DAY)), F.lit(-1).cast("long"))


def keyed(rows: DataFrame) -> DataFrame:
    """(key, seen, at, day, row): the sale as text, when it arrived, when it was sold and on which day, and the row itself."""
    at = micros(rows, "sold_at")
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    return rows.select(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).alias("key"), micros(rows, "arrived_at").alias("seen"), at.alias("at"), day_of(at).alias("day"), row)


def last(rows: DataFrame) -> DataFrame:
    """Of keyed rows the one of each sale that arrived last."""
    best = F.max(F.struct("seen", "at", "day", "row")).alias("best")
    return rows.groupBy("key").agg(best).select("key", "best.seen", "best.at", "best.day", "best.row")


class Layout:
    """Day files below root, of rows_a_file rows each, of rows with the columns of like."""

    def __init__(self, like: DataFrame, root: str, rows_a_file: int):
        self.spark, self.root, self.rows_a_file = like.sparkSession, root.rstrip("/"), rows_a_file
        self.day, self.file = free_names(like.columns, "layout_day", "layout_file")
        self.columns = like.columns
        self.schema = StructType([*like.schema.fields]).add(self.day, LongType()).add(self.file, LongType())

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.root)

    def _cut(self, rows: DataFrame) -> DataFrame:
        """Keyed rows with the number of their file in their day, as file. Only a count for each task and day, at
        most as many as tasks and days together, goes to all tasks."""
        n = partitions(self.spark)
        order = "day", "at", F.col("row.sale_id")
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        dealt, _ = saved(dealt.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
        before = Window.partitionBy("day").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        counts = dealt.groupBy("day", "task").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        shares = counts.select("day", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
        placed = dealt.join(F.broadcast(shares), ["day", "task"])
        return placed.withColumn("file", F.expr(f"(place + shift) div {self.rows_a_file}"))

    def write(self, rows: DataFrame, root: str | None = None) -> None:
        """Writes keyed rows, of each sale one, as day files. The folder must be new."""
        cut = self._cut(rows).repartition(partitions(self.spark), "day", "file").sortWithinPartitions("day", "file", "at", F.col("row.sale_id"))
        named = cut.select("row.*", F.col("day").alias(self.day), F.col("file").alias(self.file))
        named.write.option("maxRecordsPerFile", 0).partitionBy(self.day, self.file).parquet(root or self.root)

    def write_index(self, folder: str) -> str:
        """Writes (key, start_day, start_file) of every row of the layout below folder, bucketed by key; the name of the table."""
        n, name = partitions(self.spark), f"sale_index_{uuid.uuid4().hex}"
        held = self.read().select(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).alias("key"), F.col(self.day).alias("start_day"), F.col(self.file).alias("start_file"))
        held.repartition(n, "key").write.format("parquet").bucketBy(n, "key").sortBy("key").option("path", folder).saveAsTable(name)
        return name

    def overwrite(self, late: DataFrame, index: str) -> list[int]:
        """Brings the layout up to date with keyed late rows, through the index of the layout as it is; the days whose files
        are new."""
        probed = last(late).join(self.spark.table(index), "key", "left")
        winners, _ = saved(probed.where("seen IS NOT NULL OR start_day IS NULL"))
        days = winners.select(F.explode(F.array("day", "start_day")).alias("day")).where("day IS NOT NULL").distinct()
        dirty = sorted(r["day"] for r in days.collect())
        held = self.read().where(F.col(self.day).isin(dirty))
        tags = winners.where("start_day IS NOT NULL").select("key", F.col("start_day").alias(self.day), F.col("start_file").alias(self.file))
        row = F.struct(*(F.col(f"`{c}`") for c in self.columns)).alias("row")
        rows = held.select(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).alias("key"), self.day, self.file, row)
        kept = rows.join(tags, ["key", self.day, self.file], "left_anti").select("row.*")
        staged = f"{self.root}-staged-{uuid.uuid4().hex}"
        self.write(keyed(kept).unionByName(winners.select("key", "seen", "at", "day", "row")), staged)
        self._swap(staged, dirty)
        return dirty

    def _swap(self, staged: str, days: list[int]) -> None:
        """Puts the staged folders of days in the place of the layout's."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for d in days:
            new, old = path(f"{staged}/{self.day}={d}"), path(f"{self.root}/{self.day}={d}")
            fs.delete(old, True)
            if fs.exists(new) and not fs.rename(new, old):
                raise OSError(f"{new} could not be moved to {old}")
        fs.delete(path(staged), True)

    def files(self) -> DataFrame:
        """A row for each data file: day, file_no, n_rows, cents, rows_crc, path, ids_sha256. Rows are read in their files' order and
        digested as a stream, a file in one task."""
        df = self.read()
        times = [F.coalesce(micros(df, c).cast("string"), F.lit("")) for c in ("sold_at", "arrived_at")]
        sale = F.coalesce(F.col("sale_id").cast("string"), F.lit(""))
        parts = df.select(
            F.col(self.day).alias("day"), F.col(self.file).alias("file_no"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), sale.alias("sale"),
            F.coalesce(F.floor(F.lit(100) * F.col("total") + F.lit(0.5)).cast("long"), F.lit(0)).alias("cents"), F.crc32(F.concat_ws(":", sale, *times).cast("binary")).alias("crc"),
        )

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, sums, ids = None, [0, 0, 0], hashlib.sha256()
            for b in batches:
                day, file_no, cents, crc = (b.column(c).to_numpy() for c in ("day", "file_no", "cents", "crc"))
                new = np.flatnonzero((day[1:] != day[:-1]) | (file_no[1:] != file_no[:-1])) + 1
                edges = [0, *new.tolist(), b.num_rows] if b.num_rows else []
                for s, e in zip(edges, edges[1:]):
                    own = (int(day[s]), int(file_no[s]), b.column("path")[s].as_py())
                    if own != held:
                        if held:
                            yield _digested(held, sums, ids)
                        held, sums, ids = own, [0, 0, 0], hashlib.sha256()
                    text = ",".join(b.column("sale").slice(s, e - s).to_pylist())
                    ids.update((("," if sums[0] else "") + text).encode())
                    sums = [sums[0] + e - s, sums[1] + int(cents[s:e].sum()), sums[2] + int(crc[s:e].sum())]
            if held:
                yield _digested(held, sums, ids)

        return parts.repartition(partitions(self.spark), "day", "file_no").sortWithinPartitions("day", "file_no", "path", "place").mapInArrow(digest, _DIGEST)


def _digested(held: tuple, sums: list[int], ids) -> pa.RecordBatch:
    row = (held[0], held[1], *sums, held[2], ids.hexdigest())
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _DIGEST_SCHEMA)], schema=_DIGEST_SCHEMA)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_revisions(sales: DataFrame) -> DataFrame:
    """The rows, and of every third sale of every fourth day a later copy, as the contract has it."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    later = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + F.make_dt_interval((h % 2).cast("int")), "arrived_at": F.col("arrived_at") + F.make_dt_interval((1 + h % 97).cast("int"))}
    copies = sales.where((h % 3 == 0) & (F.pmod(day_of(micros(sales, "sold_at")), F.lit(4)) == 0)).select(*(later[c].cast(t).alias(c) if c in later else F.col(f"`{c}`") for c, t in sales.dtypes))
    return sales.unionByName(copies)


def overwrite_report(sales: DataFrame, cutoff: int = CUTOFF_MICROS) -> DataFrame:
    """Starting layout, index, overwrite by the late rows, and the digest of the files that stand then."""
    spark = sales.sparkSession
    layout = Layout(sales, new_folder(spark, "sales-days"), 1 + sales.count() // ROWS_A_FILE)
    rows = keyed(with_revisions(sales))
    early = F.coalesce(F.col("seen") < cutoff, F.lit(False))
    layout.write(last(rows.where(early)))
    index = layout.write_index(new_folder(spark, "sales-index"))
    dirty = layout.overwrite(rows.where(~early), index)
    spark.sql(f"DROP TABLE {index}")
    names = F.lit(",".join(layout.columns)).alias("columns")
    return layout.files().select("day", "file_no", "n_rows", "cents", "rows_crc", "path", names, "ids_sha256", F.col("day").isin(dirty).alias("rewritten"))
