"""Exact vector search: normalised vectors, matrix products of bounded blocks, one best list per query and task, then global ones.

Queries go to the tasks, at most ``MOST_QUERIES`` in a pass over the vectors,
and meet them there in blocks, so no pair of a query and a vector ever is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.python import ship
from cairn.operators.bm25 import top
from cairn.operators.scoring import MOST_QUERIES, blocks, first

#: Scores that a task holds at a time.
MOST_SCORES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of different lengths are an error."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(value)


def search(chunks: DataFrame, queries: DataFrame, k: int, key: str = "key", vector: str = "vector", scoped: bool = False, most: int = MOST_QUERIES) -> DataFrame:
    """``query_id, key, score, rank`` for ``queries(query_id, vector)``.

    ``scoped``: a query has a ``scope``, and meets only chunks with that among
    their ``scopes`` (an array). ``most``: queries of a block.
    """
    columns = ["query_id", "vector", *(["scope"] if scoped else [])]
    ship(chunks.sparkSession)
    out_type = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(key, vector, *(["scopes"] if scoped else []))
    found = None
    for shipped in blocks(queries.select(*columns)):
        local = rows.mapInArrow(_best_of(shipped, k, scoped, most), f"query_id long, key {out_type}, score double")
        found = local if found is None else found.unionByName(local)
    return top(found, k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best_of(shipped: pa.Table, k: int, scoped: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` rows of a task for each query, in blocks of ``most``."""
    ids = np.array(shipped.column("query_id").to_pylist(), np.int64)
    asked = _unit(np.array(shipped.column("vector").to_pylist(), np.float64).reshape(len(ids), -1 if len(ids) else 0))
    scope = np.array(shipped.column("scope").to_pylist(), np.int64) if scoped else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows = max(1, MOST_SCORES // max(1, min(most, len(ids))))
        for batch in batches:
            for low in range(0, batch.num_rows if len(ids) else 0, rows):
                here = batch.slice(low, rows)
                here = here.filter(here.column(1).is_valid())
                if not here.num_rows:
                    continue
                held = here.column(1)
                if pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(held), asked.shape[1])).as_py():
                    raise ValueError("vectors differ in length")
                matrix = _unit(held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(here.num_rows, -1)).T
                keys, some = np.array(here.column(0).to_pylist()), min(k, here.num_rows)
                if scoped:
                    seen = [set(x or ()) for x in here.column(2).to_pylist()]
                    known = {s: np.array([s in x for x in seen]) for s in set(scope.tolist())}
                for start in range(0, len(ids), most):
                    scores = asked[start : start + most] @ matrix
                    if scoped:
                        scores[~np.array([known[s] for s in scope[start : start + most].tolist()])] = -np.inf
                    least = np.partition(scores, here.num_rows - some, axis=1)[:, here.num_rows - some][:, None]
                    q, c = np.nonzero((scores >= least - 1e-9) & (scores > -np.inf))
                    fresh = q + start, keys[c], scores[q, c]
                    best[start] = first(k, *(fresh if start not in best else (np.concatenate(p) for p in zip(best[start], fresh, strict=True))))
        for query, key, score in best.values():
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(key.tolist()), pa.array(score)], ["query_id", "key", "score"])

    return run


def search_overfetch(chunks: DataFrame, queries: DataFrame, k: int, keep: Column, key: str = "key", vector: str = "vector", most: int = MOST_QUERIES) -> DataFrame:
    """The best ``max(4k, 20)`` first, the predicate after: may return fewer than ``k``."""
    wide = search(chunks, queries, max(4 * k, 20), key, vector, most=most).drop("rank")
    kept = wide.join(chunks.filter(keep).select(F.col(key).alias("key")), "key", "left_semi")
    return top(kept, k)


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def materialise_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks; an unknown modality is text."""
    known = F.col("modality").isin("text", "image", "audio", "video")
    return hits.join(chunks.withColumn("modality", F.when(known, F.col("modality")).otherwise("text")), hits["key"] == chunks["chunk_id"]).drop("key")
