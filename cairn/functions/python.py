"""Python functions on Arrow batches, made where they are used, so that workers import modules without a session."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a worker is handed at a time, unless the session says how many.
MOST_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Lets workers on this machine find the package; elsewhere it is installed or sent with the job."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def bound_batches() -> None:
    """Batches by bytes, as ten thousand long texts and what is made of them are much for a worker."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, str(MOST_BYTES))


def arrow_udf(function: Callable, returns: str) -> Callable:
    """``function`` over pandas series, as its annotations say."""
    bound_batches()
    return F.pandas_udf(function, returns)


def text_udf(function: Callable[[str], str]) -> Callable:
    """``function`` of a string, null for null; all those of a row run in one worker."""
    bound_batches()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else function(text) for text in (x.as_py() for x in texts)], pa.string())

    return F.arrow_udf(run, "string")
