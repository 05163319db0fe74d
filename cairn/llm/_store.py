"""Where the operators cut lineage: tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.python import ship


#: Keys with more than this share of all rows, and more than ``HOT_ROWS``, are hot: there are at most ``HOT_KEYS`` of them.
HOT_KEYS, HOT_ROWS = 10_000, 1_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests on one machine, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once, read back: later readers survive lost executors and repeat no work.

    The write's own shuffle files go when it is done.
    """
    spark = df.sparkSession
    path, held = fresh_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_limit(rows: int) -> int:
    """More rows of one key than this make it hot."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def spread_join(rows: DataFrame, side: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (read several times, so written before), which has one row for each key and, in ``weight``, how many ``rows`` have it.

    Hot keys, at most ``HOT_KEYS``, are broadcast, so that their rows stay where
    they are; the others are exchanged.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot, cold = side.filter(F.col(weight) > hot_limit(total)), side.filter(F.col(weight) <= hot_limit(total))
    if hot.isEmpty():
        return rows.join(side.drop(weight), key, how)
    hot = F.broadcast(hot.drop(weight))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.drop(weight), key, how), allowMissingColumns=True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches that stay small even where every text is very long; workers find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
