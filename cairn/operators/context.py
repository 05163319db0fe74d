"""Context packing: de-duplicated hits, quotas by bucket, query coverage, evidence order and labels, per query."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.python import ship

BUCKETS = ("topic", "raw", "source", "index")
ROLES = ("primary", "supporting", "conflicting")


def is_truncated(value: Column) -> Column:
    return F.coalesce(T.rstrip(value).endswith("..."), F.lit(False))


def with_parents(hits: DataFrame) -> DataFrame:
    """Of ``hits(query_id, rank, chunk_id, text, parent_chunk_id, parent_text)`` the first of each parent, with the parent's text if it is whole."""
    whole = (F.coalesce(F.col("parent_text"), F.lit("")) != "") & ~is_truncated(F.col("parent_text"))
    keyed = hits.withColumns({"dedupe_key": F.when(whole, F.coalesce(T.blank_to_null(F.col("parent_chunk_id")), F.col("chunk_id"))).otherwise(F.col("chunk_id")), "text": F.when(whole, F.col("parent_text")).otherwise(F.col("text"))})
    first = Window.partitionBy("query_id", "dedupe_key").orderBy("rank", "chunk_id")
    return keyed.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def bucket(wiki_kind: Column) -> Column:
    return F.when(wiki_kind.isin("topic", "source", "index"), wiki_kind).otherwise("raw")


def evidence_role(wiki_kind: Column, wiki_status: Column, freshness_tier: Column) -> Column:
    return F.when(wiki_status == "conflicting", "conflicting").when(freshness_tier == "primary", "primary").when((wiki_kind == "topic") & (wiki_status == "stable"), "primary").otherwise("supporting")


def quota_pick(contexts: DataFrame, limit: int, quotas: dict[str, int] | None = None, order: tuple[str, ...] = BUCKETS) -> DataFrame:
    """``limit`` contexts of each query, with ``position``.

    Buckets take turns up to their quotas; what is left of the limit is filled
    in the order of hits, quotas aside. In closed form: the r-th of a bucket
    comes in turn r if r is within its quota, else behind all turns by rank.
    """
    own = Window.partitionBy("query_id")
    if quotas is None:
        return contexts.withColumn("position", F.row_number().over(own.orderBy("rank", "chunk_id"))).filter(F.col("position") <= limit)
    kind = bucket(F.col("wiki_kind")) if "bucket" not in contexts.columns else F.col("bucket")
    number = F.lit(len(order))
    most = F.lit(0)
    for i, name in enumerate(order):
        number = F.when(kind == name, i).otherwise(number)
        most = F.when(kind == name, quotas.get(name, limit)).otherwise(most)
    nth = F.row_number().over(Window.partitionBy("query_id", "__bucket").orderBy("rank", "chunk_id"))
    rows = contexts.withColumns({"__bucket": number, "__most": most}).withColumn("__nth", nth)
    turn = F.col("__nth") <= F.col("__most")
    keys = (F.when(turn, 0).otherwise(1), F.when(turn, F.col("__nth")).otherwise(F.col("rank")), F.when(turn, F.col("__bucket")).otherwise(0), F.col("chunk_id"))
    return rows.withColumn("position", F.row_number().over(own.orderBy(*keys))).filter(F.col("position") <= limit).drop("__bucket", "__most", "__nth")


def search_text(text: Column, title: Column, source: Column, source_key: Column, section_path: Column) -> Column:
    some = F.filter(F.concat(F.array(text, title, source, source_key), F.coalesce(section_path, F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(some, " ")


def covered(terms: Column, text: Column) -> Column:
    return T.once(F.lower(text), lambda lowered: F.filter(terms, lambda t: F.contains(lowered, F.lower(t))))


def promote_coverage(contexts: DataFrame) -> DataFrame:
    """Swaps contexts in that hold query terms which the picked ones miss.

    ``contexts(query_id, rank, dedupe_key, score, covered array, position)``:
    all contexts, ``position`` null for those not picked. Greedy over a query's
    few contexts: in order of rank, one with a missing term takes the place of
    the picked one with the fewest terms of its own, then the least score, then
    the last place. Returns the picked ones.
    """

    def one_query(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "dedupe_key"], kind="stable").reset_index(drop=True)
        holds = [set(c) if c is not None else set() for c in frame["covered"]]
        picked = frame[frame["position"].notna()].sort_values("position").index.tolist()
        reachable = set().union(*holds)
        union = lambda rows: set().union(*(holds[i] for i in rows)) if rows else set()
        missing = reachable - union(picked)
        for candidate in frame.index:
            if not missing or not picked:
                break
            if candidate in picked or not holds[candidate] & missing:
                continue
            worth = [(len(holds[i] - union([j for j in picked if j != i])), float(frame.at[i, "score"] or 0.0), -place) for place, i in enumerate(picked)]
            picked[worth.index(min(worth))] = candidate
            missing = reachable - union(picked)
        out = frame.loc[picked].copy()
        out["position"] = range(1, len(picked) + 1)
        return out

    ship(contexts.sparkSession)
    return contexts.groupBy("query_id").applyInPandas(one_query, contexts.schema)


def label(contexts: DataFrame) -> DataFrame:
    """By evidence (primary, supporting, conflicting), labelled C1 and on."""
    role = F.lit(len(ROLES))
    for i, name in enumerate(ROLES):
        role = F.when(F.col("evidence_role") == name, i).otherwise(role)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(role, "position"))
    return contexts.withColumn("citation_label", F.concat(F.lit("C"), number.cast("string")))


def build(hits: DataFrame, queries: DataFrame, limit: int, quotas: dict[str, int] | None = None, order: tuple[str, ...] = BUCKETS) -> DataFrame:
    """All of it, for ``hits`` with a chunk's columns and ``queries(query_id, query)``."""
    rows = with_parents(hits).withColumns({"score": F.round("score", 6), "title": F.coalesce(T.blank_to_null(F.array_join("section_path", " > ")), F.col("title")), "evidence_role": evidence_role(F.col("wiki_kind"), F.col("wiki_status"), F.col("freshness_tier"))})
    terms = queries.select("query_id", T.query_terms("query").alias("__terms"))
    rows = rows.join(terms, "query_id").withColumn("covered", covered(F.col("__terms"), search_text(F.col("text"), F.col("title"), F.col("source_path"), F.col("source_key"), F.col("section_path")))).drop("__terms")
    picked = quota_pick(rows, limit, quotas, order).select("query_id", "dedupe_key", "position")
    return label(promote_coverage(rows.join(picked, ["query_id", "dedupe_key"], "left")))


