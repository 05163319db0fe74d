"""The latest version of each source and section, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T


def group_key(wiki_kind: Column, source_key: Column, section: Column, chunk_kind: Column, child_index: Column, chunk_id: Column) -> Column:
    """What versions of one passage share; null for topics and for hits without a source."""
    base = F.concat_ws("|", F.coalesce(T.blank_to_null(wiki_kind), F.lit("raw")), T.strip(source_key), F.lower(T.strip(F.coalesce(section, F.lit("")))))
    child = (chunk_kind == "child") & (F.coalesce(wiki_kind, F.lit("")) == "")
    tail = F.when(child_index.isNotNull(), F.concat(F.lit("|child:"), child_index.cast("string"))).otherwise(F.concat(F.lit("|chunk:"), chunk_id.cast("string")))
    keyed = F.when(F.coalesce(child, F.lit(False)), F.concat(base, tail)).otherwise(base)
    return F.when((F.coalesce(wiki_kind, F.lit("")) != "topic") & (F.coalesce(T.strip(source_key), F.lit("")) != ""), keyed)


def latest(hits: DataFrame, key: Column, date: Column, version: Column, stale: bool = False) -> DataFrame:
    """Of ``hits(query_id, rank, score, ...)`` the freshest of each group and those without one, with
    ``freshness_tier, is_latest_version, freshness_rank``; ``stale`` keeps the others too.

    Later dates first, then higher versions, then scores, then the order of hits.
    """
    marked = hits.withColumns({"__key": key, "__date": T.parse_date(date), "__version": T.version_key(version)})
    # hits without a group get one each, so none of them meet in a task
    order = Window.partitionBy("query_id", F.coalesce("__key", F.concat(F.lit("\x00"), F.col("rank").cast("string")))).orderBy(F.col("__date").desc_nulls_last(), F.col("__version").desc(), F.col("score").desc(), "rank")
    nth = marked.withColumn("__nth", F.row_number().over(order) - 1)
    has = F.col("__key").isNotNull()
    out = nth.withColumns({
        "freshness_tier": F.when(has, F.when(F.col("__nth") == 0, "primary").otherwise("supplemental")),
        "is_latest_version": F.when(has, F.col("__nth") == 0),
        "freshness_rank": F.when(has, F.col("__nth")),
    })
    if not stale:
        out = out.filter(~has | (F.col("__nth") == 0))
    return out.drop("__key", "__date", "__version", "__nth")
