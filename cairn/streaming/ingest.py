"""Ingest of documents as they arrive: each micro-batch replaces its sources in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import stores
from cairn.plans import ingest
from cairn.sources import sinks

SCHEMA = "doc_id string, kb_id string, source_path string, title string, text string, seq long"


def documents(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """JSON documents, a line each, as files come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(folder)


def start(stream: DataFrame, store: str, checkpoint: str, how: ingest.Chunking = ingest.Chunking(), once: bool = False) -> StreamingQuery:
    """Of a source that comes several times in a batch the last (``seq``) counts. A batch that is run again replaces the same sources, so nothing doubles."""

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        last = batch.groupBy("source_path", "kb_id").agg(F.max_by(F.struct(*batch.columns), F.coalesce("seq", F.lit(0))).alias("r")).select("r.*").drop("seq")
        ingest.apply(batch.sparkSession, store, *ingest.prepare(last, how))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def bounded_store(stream: DataFrame, path: str, checkpoint: str, most: int, order: str, once: bool = False) -> StreamingQuery:
    """The newest ``most`` rows of a stream, as a published table."""

    def apply(batch: DataFrame, number: int) -> None:
        held = sinks.read(batch.sparkSession, path)
        rows = batch if held is None else held.unionByName(batch)
        sinks.publish({path: stores.newest(rows.dropDuplicates(), most, [order])})

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
