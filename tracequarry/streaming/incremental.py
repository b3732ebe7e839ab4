"""Incremental ingest as a stream: files of documents that arrive are merged into the last snapshot.

Each micro-batch becomes one generation at most and costs what it holds, not what the corpus holds. Rows are documents in the shape of a snapshot's
files; deleted rows (body null) take a key out of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshot import Confirmations
from ..plans.engine import Engine

COLUMNS = ["connector_key", "source_uri", "title", "chunk_kind", "body", "source_updated_at"]


def merge(engine: Engine, batch: DataFrame, confirmed: Confirmations = Confirmations()) -> dict:
    """Applies a batch of changed and deleted documents; of rows with one key the last timestamp counts. Bodies of
    other documents are not read: the heads that the batch names are compared, the rest is carried on."""
    latest = Window.partitionBy("connector_key").orderBy(F.desc_nulls_last("source_updated_at"), F.sha2(F.coalesce("body", F.lit(b"")), 256))
    new = batch.select(*COLUMNS).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    return engine.ingest(new.where("body is not null"), confirmed=confirmed, gone=new.where("body is null").select("connector_key"))


def start(stream: DataFrame, engine: Engine, checkpoint: str, confirmed: Confirmations = Confirmations(), **trigger) -> StreamingQuery:
    """Runs merge on every micro-batch; a batch that is replayed after a failure changes nothing."""
    trigger = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(lambda batch, _: merge(engine, batch, confirmed) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()
