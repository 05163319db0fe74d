"""The newest records of each kind, kept as state: what arrives is compared with what is kept of its kind, and nothing else is read or written.

The records are where the query's checkpoint has its state; ``kept`` reads them
from there. A query that starts again from its checkpoint goes on with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cairn.functions.python import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "kind string, id string, seq long, record string, kept boolean"


class Newest(StatefulProcessor):
    """Per kind a map from id to sequence number and record, of ``most`` entries at most."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "id string", "seq long, record string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: (v[0], v[1]) for k, v in self.records.iterator()}
        fresh: dict[str, tuple[int, str]] = {}
        for frame in rows:
            for id_, seq, record in zip(frame["id"], frame["seq"], frame["record"], strict=True):
                if (seq, record) > (fresh.get(id_) or held.get(id_) or (-(2**63), "")):
                    fresh[id_] = int(seq), record
            if len(fresh) > 2 * self.most:  # older ones cannot stay
                fresh = dict(sorted(fresh.items(), key=lambda x: (x[1][0], x[0]))[-self.most :])
        both = held | fresh
        newest = dict(sorted(both.items(), key=lambda x: (x[1][0], x[0]))[-self.most :])
        gone = [k for k in held if k not in newest]
        for k in gone:
            self.records.removeKey((k,))
        come = [k for k in fresh if k in newest]
        for k in come:
            self.records.updateValue((k,), newest[k])
        changes = [(key[0], k, *both[k], False) for k in gone] + [(key[0], k, *newest[k], True) for k in come]
        if changes:
            yield pd.DataFrame(changes, columns=["kind", "id", "seq", "record", "kept"])

    def close(self) -> None:
        pass


def newest(stream: DataFrame, most: int) -> DataFrame:
    """Changes, as ``CHANGES``, of the ``most`` newest of ``stream(kind, id, seq, record)``: those that come or are renewed, and those that go.

    A record of a known id takes its place where its ``seq`` is greater. Rows
    without an id or a kind are no records.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set(PROVIDER, ROCKS)
    rows = stream.filter("id IS NOT NULL AND kind IS NOT NULL").select("kind", "id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("record", F.lit("")).alias("record"))
    return rows.groupBy("kind").transformWithStateInPandas(Newest(most), CHANGES, "Update", "None")


def start(stream: DataFrame, checkpoint: str, most: int, changes: str | None = None, once: bool = False) -> StreamingQuery:
    """Keeps the newest records in the state below ``checkpoint``; their changes are appended to ``changes``, if that is given."""
    rows = newest(stream, most)

    def log(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own folder again
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.format("noop") if changes is None else writer.foreachBatch(log)
    return (writer.trigger(availableNow=True) if once else writer).start()


def kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``kind, id, seq, record``: what the state below ``checkpoint`` holds, after its last whole batch."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "records").load()
    return rows.select(F.col("key.kind").alias("kind"), F.col("user_map_key.id").alias("id"), "user_map_value.seq", "user_map_value.record")
