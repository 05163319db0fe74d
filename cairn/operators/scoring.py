"""Blocks of queries that are shipped to tasks, and the best rows of a task for each of them.

Scores of a block and a piece of the documents are a matrix in a task; what
leaves the task is each query's best few, so pairs of a query and a document
are rows only where a caller has to filter them one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_QUERIES = 10_000
#: Scores, and products of a posting and a query, that a task holds at a time.
MOST_PAIRS = 2_000_000
#: Rows of pairs in one Arrow batch.
MOST_ROWS = 100_000
#: Scores that agree to nine places differ by less.
ALIKE = 2e-9


def blocks(queries: DataFrame, most: int = MOST_QUERIES, depth: int = 0) -> Iterator[pa.Table]:
    """The queries, at most ``most`` at a time; one block at a time is on the driver."""
    rows = queries.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        yield rows
        return
    if depth > 8:
        raise ValueError("queries repeat one row too often")
    parts = max(2, -(-2 * queries.count() // most))
    numbered = queries.withColumn("__part", F.pmod(F.xxhash64(F.lit(depth), *queries.columns), F.lit(parts)))
    for part in range(parts):
        yield from blocks(numbered.filter(F.col("__part") == part).drop("__part"), most, depth + 1)


def with_rows(hits: DataFrame, queries: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """``hits`` of ``queries`` with the columns of a large table that they name by ``key``.

    The hits of a block of queries, a few for each, go to the rows, which stay
    where they are; only those of more queries meet them in an exchange.
    """
    few = queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES
    return rows.join(F.broadcast(hits) if few else hits, key)


def first(k: int, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each query, ties (to nine places) by key."""
    order = np.lexsort((key, -np.round(score, 9), query))
    query, key, score = query[order], key[order], score[order]
    start = np.searchsorted(query, query)
    kept = np.arange(len(query)) - start < k
    return query[kept], key[kept], score[kept]


@dataclass(frozen=True)
class Weights:
    """The terms of a block of queries: the queries of term ``t`` are ``query[start[t]:start[t + 1]]``, with their weights."""

    ids: pa.Array
    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    scope: np.ndarray | None

    @staticmethod
    def of(ids: pa.Array, bags: list[list[tuple[int, float]]], terms: list[str], scope: np.ndarray | None) -> Weights:
        """Of each query's terms (by number) and weights."""
        rows = [(t, q, w) for q, bag in enumerate(bags) for t, w in bag]
        term = np.array([r[0] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms)))))
        return Weights(ids, pa.array(terms, pa.string()), start, np.array([r[1] for r in rows], np.int64)[order], np.array([r[2] for r in rows], np.float64)[order], scope)


class Best:
    """The best ``k`` documents of a task for each query of a block, or all that score (``k`` is None)."""

    def __init__(self, block: Weights, k: int | None) -> None:
        self.block, self.k, self.kind = block, k, None
        self.floor = np.zeros(len(block.ids))
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: pa.Array, document: np.ndarray, term: np.ndarray, weight: np.ndarray, seen: dict[int, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """Postings of ``keys``: place of the key (ascending), number of the term, weight. ``seen``: by scope, which keys it has.

        Yields pairs, where all that score are wanted.
        """
        self.kind, many = keys.type, len(self.block.ids)
        if not many or not len(term):
            return
        each = self.block.start[term + 1] - self.block.start[term]
        cost = np.cumsum(np.bincount(document, each, len(keys)) + many)
        low = 0
        while low < len(keys):
            high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + MOST_PAIRS, "right")))
            one, two = np.searchsorted(document, (low, high))
            if two > one:
                scores = self._scores(high - low, document[one:two] - low, term[one:two], weight[one:two], each[one:two])
                if seen is not None:
                    outside = {s: ~x[low:high] for s, x in seen.items()}
                    for q, s in enumerate(self.block.scope.tolist()):
                        scores[outside[s], q] = 0.0
                yield from self._keep(keys.slice(low, high - low), scores)
            low = high

    def _scores(self, documents: int, document: np.ndarray, term: np.ndarray, weight: np.ndarray, each: np.ndarray) -> np.ndarray:
        many = len(self.block.ids)
        at = np.repeat(self.block.start[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        cell = np.repeat(document * many, each) + self.block.query[at]
        return np.bincount(cell, np.repeat(weight, each) * self.block.weight[at], documents * many).reshape(documents, many)

    def _keep(self, keys: pa.Array, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        over = scores > self.floor
        if self.k is not None and len(keys) > self.k and over.sum() > 4 * self.k * len(self.floor):
            least = np.partition(scores, len(keys) - self.k, axis=0)[len(keys) - self.k]
            over &= scores >= least - ALIKE
        d, q = np.nonzero(over)
        if self.k is None:
            for low in range(0, len(d), MOST_ROWS):
                part = slice(low, low + MOST_ROWS)
                yield self._batch(q[part], keys.take(pa.array(d[part])), scores[d[part], q[part]])
        elif len(d):
            self.kept.append((q, np.array(keys.to_pylist())[d], scores[d, q]))
            self.rows += len(d)
            if self.rows > 8 * self.k * len(self.floor):
                self._trim()

    def _trim(self) -> None:
        kept = first(self.k, *(np.concatenate(p) for p in zip(*self.kept, strict=True)))
        self.kept, self.rows = [kept], len(kept[0])
        full = np.bincount(kept[0], minlength=len(self.floor)) == self.k
        last = np.searchsorted(kept[0], np.arange(len(self.floor)), "right") - 1
        self.floor[full] = np.maximum(0.0, kept[2][last[full]] - ALIKE)

    def _batch(self, q: np.ndarray, keys: pa.Array, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.block.ids.take(pa.array(q)), keys, pa.array(score)], ["query_id", "key", "score"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            self._trim()
            q, key, score = self.kept[0]
            yield self._batch(q, pa.array(key.tolist(), self.kind), score)
