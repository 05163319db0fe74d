"""Rerank scores: a model's score plus what the metadata say."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T


@dataclass(frozen=True)
class Weights:
    # Default weights of the metadata.
    stable_topic: float = 0.35
    stable_source: float = 0.15
    conflicting_penalty: float = 0.25
    section_match: float = 0.1
    doc_type_match: float = 0.08
    effective_date_recency: float = 0.12


def tokens(value: Column) -> Column:
    """Distinct lower-cased words; ``-`` and ``/`` part words."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(F.coalesce(value, F.lit(""))), "-/", "  "), r"(?U)\s+"), lambda x: x != ""))


def recency(date: Column, as_of: Column) -> Column:
    """1 up to 30 days, 0 from 365 on, linear between; future dates are new."""
    age = F.greatest(F.datediff(as_of, date), F.lit(0))
    return F.when(age <= 30, 1.0).when(age >= 365, 0.0).otherwise(F.round(1.0 - (age - 30) / F.lit(335.0), 4))


def adjustment(query: Column, wiki_kind: Column, wiki_status: Column, section: Column, doc_type: Column, date: Column, as_of: Column, w: Weights = Weights()) -> Column:
    asked = tokens(query)
    overlap = lambda other, weight: F.when(F.arrays_overlap(asked, tokens(other)), weight).otherwise(0.0)
    stable = wiki_status == "stable"
    day = T.parse_rank_date(date)
    total = (
        F.when(stable & (wiki_kind == "topic"), w.stable_topic).when(stable & (wiki_kind == "source"), w.stable_source).otherwise(0.0)
        - F.when(wiki_status == "conflicting", w.conflicting_penalty).otherwise(0.0)
        + overlap(section, w.section_match) + overlap(doc_type, w.doc_type_match)
        + F.when(day.isNotNull(), w.effective_date_recency * recency(day, as_of)).otherwise(0.0)
    )
    return F.round(total, 6)


def by_position(hits: DataFrame, replies: DataFrame) -> DataFrame:
    """``hits`` with ``model_score`` from ``replies(query_id, results array<struct<index, score>>)``.

    An index is a hit's place, from 0, among its query's by rank. Indexes out of
    range, and hits that no index names, are dropped; of an index named twice
    the first counts.
    """
    placed = hits.withColumn("__at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
    each = replies.select("query_id", F.posexplode("results").alias("__nth", "r")).filter("r.index IS NOT NULL AND r.score IS NOT NULL")
    once = each.groupBy("query_id", F.col("r.index").cast("int").alias("__at")).agg(F.min_by("r.score", "__nth").cast("double").alias("model_score"))
    return placed.join(once, ["query_id", "__at"]).drop("__at")


def rerank(hits: DataFrame, k: int, adjust: Column, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``model`` adds ``model_score`` to its own choice of ``hits``; what it leaves out is dropped. Best ``k`` by sum."""
    scored = (model or (lambda df: df.withColumn("model_score", F.col("score"))))(hits)
    own = Window.partitionBy("query_id")
    cut = scored.withColumn("__m", F.row_number().over(own.orderBy(F.col("model_score").desc(), "rank"))).filter(F.col("__m") <= k)
    summed = cut.withColumn("score", F.col("model_score") + adjust)
    return summed.withColumn("rank", F.row_number().over(own.orderBy(F.round("score", 9).desc(), "__m"))).drop("__m", "model_score")
