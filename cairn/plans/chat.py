"""Answers to retrieved contexts: prompts, a model's replies, formatted answers with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import answers

SYSTEM = "Answer from the given context only, cite the labels that support each conclusion, such as [C1], and say so where the context is not enough."
WARNING = "Some of the evidence is marked as conflicting: describe the conflict and avoid a conclusion that is too certain.\n\n"
SHAPE = "Answer in this form:\nFinal Answer:\n<answer with labels>\n\nSupporting Claims:\n- [factual|conditional|conflict|insufficiency] <claim> [C#]\nWrite `- None` if no claim is well supported."


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """``query_id, system, user``: the question, its contexts by evidence, a warning where they conflict."""
    kept = [c for c in ("position", "citation_label", "chunk_id", "text", "evidence_role", "modality", "media_uri", "mime_type", "wiki_kind", "wiki_status", "section_path_text", "doc_type", "effective_date", "version", "freshness_tier", "score") if c in contexts.columns]
    null = [F.lit(None).cast("string").alias(c) for c in ("modality", "media_uri", "mime_type") if c not in contexts.columns]
    packed = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*kept, *null))).alias("contexts"))
    rows = queries.select("query_id", "query").join(packed, "query_id", "left")
    odd = F.coalesce(F.exists("contexts", lambda c: c["wiki_status"] == "conflicting"), F.lit(False))
    user = F.concat(F.lit("Question: "), "query", F.lit("\n\n"), F.when(odd, WARNING).otherwise(""), F.lit("Available context:\n"), F.coalesce(answers.evidence_sections(F.col("contexts")), F.lit("")), F.lit("\n\n" + SHAPE))
    return rows.select("query_id", "query", "contexts", F.lit(SYSTEM).alias("system"), user.alias("user"))


def with_media(rows: DataFrame, media: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """``prompts`` with ``parts``: the user's text, and each image of the contexts, in their order, as a data address.

    ``media(media_uri, data)`` has the bytes, as base64, of images small enough
    (``files.read_media_bytes``). A relative address is looked up as it is, then
    below each of ``roots``; an image without bytes is left out.
    """
    each = rows.select("query_id", F.posexplode("contexts").alias("__nth", "c"))
    images = each.filter((F.col("c.modality") == "image") & F.startswith("c.mime_type", F.lit("image/")) & (F.col("c.media_uri") != ""))
    uri = F.col("c.media_uri")
    below = [F.when(~F.startswith(uri, F.lit("/")) & ~F.contains(uri, F.lit("://")), F.concat(F.lit(r.rstrip("/") + "/"), uri)) for r in roots]
    places = images.select("query_id", "__nth", F.col("c.mime_type").alias("__mime"), F.posexplode(F.array(uri, *below)).alias("__try", "__uri")).filter("__uri IS NOT NULL")
    held = media.groupBy(F.col("media_uri").alias("__uri")).agg(F.first("data").alias("__data"))
    found = places.join(held, "__uri").groupBy("query_id", "__nth", "__mime").agg(F.min_by("__data", "__try").alias("__data"))
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("url"))
    address = F.concat(F.lit("data:"), "__mime", F.lit(";base64,"), "__data")
    seen = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__nth", address.alias("a")))), lambda x: part("image_url", F.lit(None), x["a"])).alias("__images"))
    none = F.array().cast("array<struct<type: string, text: string, url: string>>")
    parts = F.concat(F.array(part("text", F.col("user"), F.lit(None))), F.coalesce("__images", none))
    return rows.join(seen, "query_id", "left").withColumn("parts", parts).drop("__images")


def format_answers(rows: DataFrame) -> DataFrame:
    """``query_id, answer, citations, supporting_claims`` of ``rows(query_id, reply, contexts)``."""
    base = rows.withColumns({"__body": answers.final_answer(F.col("reply")), "supporting_claims": answers.supporting_claims(F.col("reply")), "contexts": answers.order_contexts(F.coalesce(F.col("contexts"), F.expr("filter(contexts, c -> false)")))})
    noted = base.withColumn("__noted", answers.conflict_notice(F.col("__body"), F.col("contexts")))
    labelled = noted.withColumn("__labels", answers.supported_labels(F.col("__noted"), answers.cited_labels(F.col("__noted")), F.col("contexts")))
    tidy = labelled.withColumn("__tidy", answers.rewrite_markers(F.col("__noted"), F.col("__labels")))
    cited = tidy.withColumn("__cited", answers.cited_labels(F.col("__tidy"))).withColumn("citations", answers.ordered_citations(F.col("contexts"), F.col("__cited")))
    first = F.coalesce(F.try_element_at("citations", F.lit(1))["citation_label"], F.try_element_at("citations", F.lit(1))["chunk_id"])
    answer = F.when((F.size("__cited") == 0) & (F.size("citations") > 0), F.concat("__tidy", F.lit(" ["), first, F.lit("]"))).otherwise(F.col("__tidy"))
    return cited.withColumn("answer", answer).select(*[c for c in rows.columns if c not in ("reply", "contexts")], "answer", "citations", "supporting_claims")


def spans(formatted: DataFrame) -> DataFrame:
    """Citations as rows, each with the span that supports the answer."""
    rows = formatted.select("query_id", "answer", F.posexplode("citations").alias("position", "c"))
    return rows.select("query_id", "position", "c.citation_label", "c.chunk_id", "c.evidence_role", answers.citation_span(F.col("answer"), F.col("c.text")).alias("s")).select("query_id", "position", "citation_label", "chunk_id", "evidence_role", "s.*")


def run(queries: DataFrame, contexts: DataFrame, generate, media: DataFrame | None = None, roots: tuple[str, ...] = ()) -> DataFrame:
    """``generate(df)`` adds ``reply`` to prompts; with ``media`` these have ``parts`` too."""
    asked = prompts(queries, contexts)
    replied = generate(asked if media is None else with_media(asked, media, roots))
    return format_answers(replied.drop("parts"))
