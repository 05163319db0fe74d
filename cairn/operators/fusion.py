"""Rank fusion of result lists ``(query_id, key, score, rank)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.bm25 import top


@dataclass(frozen=True)
class Fusion:
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    rrf_k: int = 60

    def __post_init__(self) -> None:
        if self.dense_weight < 0 or self.sparse_weight < 0 or self.dense_weight + self.sparse_weight == 0:
            raise ValueError("weights must not be negative, nor both 0")
        if self.rrf_k <= 0:
            raise ValueError("rrf_k must be positive")


def reciprocal_ranks(dense: DataFrame, sparse: DataFrame, how: Fusion = Fusion()) -> DataFrame:
    """``query_id, key, fused, dense_score, sparse_score, rank``: weights over ``k + rank``, summed; one exchange, no join."""
    null = F.lit(None).cast("double")
    one = dense.select("query_id", "key", (F.lit(how.dense_weight) / (how.rrf_k + F.col("rank"))).alias("part"), F.col("score").cast("double").alias("d"), null.alias("s"), F.col("rank").alias("seen"))
    two = sparse.select("query_id", "key", (F.lit(how.sparse_weight) / (how.rrf_k + F.col("rank"))).alias("part"), null.alias("d"), F.col("score").cast("double").alias("s"), (F.col("rank") + 1_000_000_000).alias("seen"))
    both = one.unionByName(two).groupBy("query_id", "key").agg(F.sum("part").alias("fused"), F.max("d").alias("dense_score"), F.max("s").alias("sparse_score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.round("fused", 12).desc(), "seen", "key")
    return both.withColumn("rank", F.row_number().over(order)).drop("seen")


def weighted_scores(dense: DataFrame, sparse: DataFrame, how: Fusion = Fusion()) -> DataFrame:
    """``query_id, key, fused, rank``: each list's scores over its greatest one, weighted, summed."""
    own = Window.partitionBy("query_id")

    def scaled(hits: DataFrame, weight: float) -> DataFrame:
        most = F.max("score").over(own)
        return hits.select("query_id", "key", (F.lit(weight) * F.col("score") / F.when(most == 0, F.lit(1.0)).otherwise(most)).alias("part"))

    both = scaled(dense, how.dense_weight).unionByName(scaled(sparse, how.sparse_weight)).groupBy("query_id", "key").agg(F.sum("part").alias("fused"))
    order = own.orderBy(F.round("fused", 12).desc(), "key")
    return both.withColumn("rank", F.row_number().over(order))


def variants(hits: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Lists of query variants ``(query_id, variant, key, score, rank)`` as one; a single list keeps its scores."""
    lists = F.size(F.collect_set("variant").over(Window.partitionBy("query_id")))
    marked = hits.withColumn("lists", lists)
    fused = marked.groupBy("query_id", "key").agg(
        F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("fused"), F.min(F.struct("variant", "rank")).alias("first"), F.min_by("score", F.struct("variant", "rank")).alias("own"), F.max("lists").alias("lists"),
    )
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("lists") == 1, -F.col("first.rank")).otherwise(F.round("fused", 12)).desc(), "first.variant", "first.rank", "key")
    ranked = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "key", F.when(F.col("lists") == 1, F.col("own")).otherwise(F.col("fused")).alias("score"), "rank")


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, how: Fusion = Fusion()) -> DataFrame:
    """The best ``k`` by reciprocal ranks; ``score`` is the dense one where there is one, else the fused."""
    fused = reciprocal_ranks(dense, sparse, how).filter(F.col("rank") <= k)
    return fused.withColumn("score", F.coalesce("dense_score", "fused"))


def overfetched(dense: DataFrame, sparse: DataFrame, kept: DataFrame, k: int, how: Fusion = Fusion()) -> DataFrame:
    """Weighted sums of two lists of ``max(4k, 20)``, then the predicate (``kept(key)``), then the best ``k``: may be fewer."""
    wide = max(4 * k, 20)
    both = dense.filter(F.col("rank") <= wide).select("query_id", "key", (F.lit(how.dense_weight) * F.col("score")).alias("part")).unionByName(sparse.filter(F.col("rank") <= wide).select("query_id", "key", (F.lit(how.sparse_weight) * F.col("score")).alias("part")))
    fused = top(both.groupBy("query_id", "key").agg(F.sum("part").alias("score")), wide).drop("rank")
    return top(fused.join(kept.select("key").distinct(), "key", "left_semi"), k)


def priority_merge(first: DataFrame, then: DataFrame, k: int) -> DataFrame:
    """``first`` in its order, then what of ``then`` is new, up to ``k`` in all."""
    both = first.select("query_id", "key", "score", "rank", F.lit(0).alias("list")).unionByName(then.select("query_id", "key", "score", "rank", F.lit(1).alias("list")))
    once = both.groupBy("query_id", "key").agg(F.min(F.struct("list", "rank", "score")).alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.list", "b.rank", "key")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "key", F.col("b.score").alias("score"), "rank")


__all__ = ["Fusion", "hybrid", "overfetched", "priority_merge", "reciprocal_ranks", "top", "variants", "weighted_scores"]
