"""Retrieval, end to end, for a table of queries: variants, lists, fusion, rerank, freshness, contexts, traces."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bm25, context, filters, freshness, fusion, rerank, stores, text_index, vectors, wiki
from cairn.plans import ingest
from cairn.sources import sinks


@dataclass(frozen=True)
class Settings:
    # Default sizes of the lists and quotas of the contexts.
    top_k: int = 20
    rerank_top_k: int = 10
    final_contexts: int = 6
    quotas: dict = field(default_factory=lambda: {"topic": 2, "raw": 6, "source": 1, "index": 1})
    fusion: fusion.Fusion = fusion.Fusion()


WIKI_COLUMNS = ("wiki_kind", "wiki_status")


def expand(queries: DataFrame, rewritten: str | None = None, replies: str | None = None, passage: str | None = None) -> DataFrame:
    """Variants of ``queries``: the query, its rewriting, lines of a reply, a made-up passage (columns that models filled)."""
    base = F.col("query") if rewritten is None else F.coalesce(T.blank_to_null(T.strip(rewritten)), F.col("query"))
    texts = F.array(F.col("query"), base)
    if replies is not None:
        texts = F.concat(texts, stores.parse_variants(F.coalesce(F.col(replies), F.lit("")), base))
    if passage is not None:
        texts = F.concat(texts, F.array(F.col(passage)))
    rows = queries.select(*queries.columns, F.posexplode(texts).alias("variant", "text"))
    kept = stores.distinct_variants(rows.filter("text IS NOT NULL"))
    return kept.withColumn("query", F.col("text")).drop("text")


def in_scope(rows: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Those of ``rows(query_id, key, ...)`` whose chunk is of the query's knowledge base and passes its filters, explicit and inferred."""
    wanted = filters.merge(F.col("filters"), filters.infer("query")) if "filters" in queries.columns else filters.infer("query")
    asked = queries.select("query_id", F.coalesce("kb_id", F.lit("default")).alias("__kb"), wanted.alias("__f")).dropDuplicates(["query_id"])
    held = chunks.select(F.col("chunk_id").alias("key"), F.coalesce("kb_id", F.lit("default")).alias("__own"), F.col("doc_type").alias("__type"), F.col("version").alias("__v"), F.col("effective_date").alias("__day"))
    met = rows.join(asked, "query_id").join(held, "key").filter(F.col("__own") == F.col("__kb"))
    return met.filter(filters.matches(F.col("__f"), F.col("__type"), F.col("__v"), F.col("__day"))).select(*rows.columns)


def lists(queries: DataFrame, chunks: DataFrame, how: Settings = Settings(), index: text_index.Index | None = None) -> DataFrame:
    """Hybrid hits of ``queries(query_id, query, kb_id, vector)`` in ``chunks`` with vectors; texts by the stored ``index``, if there is one."""
    within = lambda scored: in_scope(scored, queries, chunks)
    if index is None:
        sparse = bm25.search(bm25.eligible(chunks), queries, 2 * how.top_k, "chunk_id", "text", within=within)
    else:
        sparse = text_index.search(index, queries, 2 * how.top_k, within=within)
    asked = queries.filter("vector IS NOT NULL")
    if "kb_id" in queries.columns:
        inside = _scoped_vectors(asked, chunks, 2 * how.top_k)
    else:
        inside = vectors.search(chunks.filter("vector IS NOT NULL"), asked, 2 * how.top_k, "chunk_id", "vector")
    return fusion.hybrid(inside, sparse, how.top_k, how.fusion).select("query_id", "key", "score", "rank")


def _scoped_vectors(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Exact search among the chunks that each query may see.

    Queries of one knowledge base and one filter share a scope. A chunk gets the
    scopes that it is in, and the search masks the others: vectors are never
    joined with queries.
    """
    wanted = filters.merge(F.col("filters"), filters.infer("query")) if "filters" in queries.columns else filters.infer("query")
    asked = queries.select("query_id", "vector", F.coalesce("kb_id", F.lit("default")).alias("kb_id"), wanted.alias("__f"))
    asked = asked.withColumn("scope", F.xxhash64("kb_id", F.to_json("__f")))
    scopes = asked.groupBy("scope").agg(F.first(F.struct("kb_id", "__f")).alias("s")).select(F.col("scope").alias("__scope"), F.col("s.kb_id").alias("__kb"), F.col("s.__f").alias("__f"))
    held = chunks.filter("vector IS NOT NULL").withColumn("__own", F.coalesce("kb_id", F.lit("default")))
    met = held.join(scopes, F.col("__own") == F.col("__kb")).filter(filters.matches(F.col("__f"), F.col("doc_type"), F.col("version"), F.col("effective_date")))
    seen = met.groupBy("chunk_id").agg(F.collect_set("__scope").alias("scopes"))  # at most as many as there are scopes
    return vectors.search(held.select("chunk_id", "vector").join(seen, "chunk_id"), asked, k, "chunk_id", "vector", scoped=True)


def hits(
    queries: DataFrame, chunks: DataFrame, pages: DataFrame | None = None, how: Settings = Settings(),
    index: text_index.Index | None = None, page_index: text_index.Index | None = None,
) -> DataFrame:
    """Best ``top_k`` over a query's variants (``variant``, one if absent), knowledge pages first."""
    variants = queries if "variant" in queries.columns else queries.withColumn("variant", F.lit(0))
    number = F.struct("query_id", "variant")
    keyed = variants.withColumn("__q", F.xxhash64(number)).select(F.col("__q").alias("query_id"), *[c for c in variants.columns if c not in ("query_id", "variant")])
    found = lists(keyed, chunks, how, index)
    if pages is not None:
        found = fusion.priority_merge(wiki.search(pages, keyed, how.top_k, page_index).select("query_id", "key", "score", "rank"), found, how.top_k)
    back = variants.select(F.xxhash64(number).alias("__q"), "query_id", "variant")
    return fusion.variants(found.withColumnRenamed("query_id", "__q").join(back, "__q").drop("__q"), how.top_k)


def with_chunks(found: DataFrame, chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Hits with what ranking and packing read of their chunks or pages."""
    null = F.lit(None).cast("string")
    kept = ["text", "title", "source_path", "source_key", "doc_type", "effective_date", "version", "section_path_text", "parent_chunk_id", "parent_text", "chunk_kind", "child_chunk_index"]
    own = chunks.select("chunk_id", *[F.col(c) if c in chunks.columns else null.alias(c) for c in kept], (F.col("section_path") if "section_path" in chunks.columns else F.array().cast("array<string>")).alias("section_path"), null.alias("wiki_kind"), null.alias("wiki_status"))
    if pages is not None:
        made = pages.select(F.col("key").alias("chunk_id"), T.limit_body("body").alias("text"), "title", F.col("key").alias("source_path"), "source_key", "doc_type", "effective_date", "version", *[null.alias(c) for c in kept[7:11]], F.lit(None).cast("int").alias("child_chunk_index"), F.array().cast("array<string>").alias("section_path"), F.col("kind").alias("wiki_kind"), F.col("status").alias("wiki_status"))
        own = own.withColumn("child_chunk_index", F.col("child_chunk_index").cast("int")).unionByName(made)
    return found.withColumnRenamed("key", "chunk_id").join(own, "chunk_id")


def run(
    queries: DataFrame, chunks: DataFrame, pages: DataFrame | None = None, how: Settings = Settings(), model=None, as_of: Column | None = None,
    index: text_index.Index | None = None, page_index: text_index.Index | None = None,
) -> dict[str, DataFrame]:
    """``retrieved``, ``reranked`` and ``contexts`` of each query; ``model`` scores hits for reranking; the stored indexes are used where given."""
    asked = queries.select("query_id", "query").dropDuplicates(["query_id"])
    retrieved = with_chunks(hits(queries, chunks, pages, how, index, page_index), chunks, pages).join(asked, "query_id")
    day = F.current_date() if as_of is None else as_of
    section = F.coalesce(F.array_join("section_path", " "), F.lit(""))
    adjust = rerank.adjustment(F.col("query"), F.col("wiki_kind"), F.col("wiki_status"), section, F.col("doc_type"), F.col("effective_date"), day)
    reranked = rerank.rerank(retrieved, how.rerank_top_k, adjust, model)
    key = freshness.group_key(F.col("wiki_kind"), F.col("source_key"), F.coalesce(T.blank_to_null(F.col("section_path_text")), F.col("title")), F.col("chunk_kind"), F.col("child_chunk_index"), F.col("chunk_id"))
    fresh = freshness.latest(reranked, key, F.col("effective_date"), F.col("version")).drop("query")
    return {"retrieved": retrieved, "reranked": reranked, "contexts": context.build(fresh, asked, how.final_contexts, how.quotas)}


def from_store(spark: SparkSession, store: str, queries: DataFrame, how: Settings = Settings(), model=None, as_of: Column | None = None) -> dict[str, DataFrame]:
    """``run`` on what a store has published: its chunks, pages and both indexes."""
    chunks, pages = sinks.read(spark, f"{store}/chunks"), sinks.read(spark, f"{store}/pages")
    if "vector" not in chunks.columns:
        chunks = chunks.withColumn("vector", F.lit(None).cast("array<float>"))
    if "vector" not in queries.columns:
        queries = queries.withColumn("vector", F.lit(None).cast("array<float>"))
    return run(queries, chunks, pages, how, model, as_of, ingest.read_index(spark, store), ingest.read_index(spark, store, ingest.PAGES))


def traces(queries: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """A row for each query: ids of its lists, and its contexts."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(name))
    packed = parts["contexts"].groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text", "evidence_role", "citation_label", "wiki_kind", "wiki_status", "score"))).alias("contexts"))
    return queries.dropDuplicates(["query_id"]).join(ids(parts["retrieved"], "retrieved_chunk_ids"), "query_id", "left").join(ids(parts["reranked"], "reranked_chunk_ids"), "query_id", "left").join(packed, "query_id", "left").withColumn("created_at", F.current_timestamp())
