"""Stores as tables: keyed replacement, deletion, retention, catalogs, listings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T

ID_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in place of those with equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def delete_source(table: DataFrame, source_path: str, kb_id: str) -> DataFrame:
    """Without the rows of a source in a knowledge base; a row without one is of the default."""
    gone = (F.col("source_path") == source_path) & (F.coalesce(F.col("kb_id"), F.lit("default")) == kb_id)
    return table.filter(~F.coalesce(gone, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def newest(table: DataFrame, most: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The last ``most`` rows (of each group); without groups a sorted limit, which keeps ``most`` rows a task."""
    if not by:
        return table.orderBy(*[F.col(c).desc() for c in order]).limit(most)
    own = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return table.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= most).drop("__n")


def latest_by_key(table: DataFrame, key: str, seq: str) -> DataFrame:
    """Updates win over what they update, by sequence number."""
    return table.groupBy(key).agg(F.max_by(F.struct(*table.columns), seq).alias("r")).select("r.*")


def page(table: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page's rows, with ``total`` and ``total_pages``."""
    if number < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and not empty")
    counts = table.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    return table.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(counts)


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ID_SHAPE), F.lit(False))


def clean_name(value: Column) -> Column:
    return F.left(T.strip(value), F.lit(160))


def create_entries(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """The catalog with new entries; an invalid or taken id, or a blank name, is an error."""
    taken = catalog.select(F.col("kb_id").alias("__taken")).distinct()
    judged = entries.join(taken, F.col("kb_id") == F.col("__taken"), "left")
    wrong = F.when(~valid_id(F.col("kb_id")), F.lit("invalid kb_id")).when(F.col("__taken").isNotNull(), F.lit("kb_id exists")).when(T.strip("name") == "", F.lit("blank name"))
    checked = judged.withColumn("kb_id", F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", wrong, "kb_id"))).otherwise(F.col("kb_id"))).withColumn("name", clean_name(F.col("name")))
    return catalog.unionByName(checked.drop("__taken"))


def seed(catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """The catalog with those seeds that it lacks."""
    return catalog.unionByName(seeds.join(catalog.select("kb_id"), "kb_id", "left_anti"))


def list_catalog(catalog: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    rows = catalog if allowed is None else catalog.filter(F.col("kb_id").isin(allowed))
    return rows.orderBy(F.lower("name"), "kb_id")


def document_list(docs: DataFrame, chunks: DataFrame, kb_id: str | None = None) -> DataFrame:
    """Documents with their chunk counts, newest first, then by title."""
    rows = docs if kb_id is None else docs.filter(F.coalesce(F.col("kb_id"), F.lit("default")) == kb_id)
    sizes = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return rows.join(sizes, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy(F.col("updated_at").desc(), F.lower("title"), "doc_id")


def kb_summary(catalog: DataFrame, docs: DataFrame, chunks: DataFrame, traces: DataFrame, newest_traces: int = 100) -> DataFrame:
    """Documents, chunks, traces (of the newest ones only) and last activity of each knowledge base."""
    by_doc = docs.groupBy("kb_id").agg(F.count(F.lit(1)).alias("document_count"), F.max("updated_at").alias("__docs_at"))
    by_chunk = chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    by_trace = newest(traces, newest_traces, ["seq"]).groupBy("kb_id").agg(F.count(F.lit(1)).alias("trace_count"), F.max("updated_at").alias("__traces_at"))
    both = catalog.join(by_doc, "kb_id", "left").join(by_chunk, "kb_id", "left").join(by_trace, "kb_id", "left")
    return both.fillna(0, ["document_count", "chunk_count", "trace_count"]).withColumn("last_activity", F.greatest("__docs_at", "__traces_at")).drop("__docs_at", "__traces_at").orderBy(F.col("last_activity").desc_nulls_last(), "kb_id")


def accept_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Feedback on known traces of the same knowledge base and session, with a valid rating and bounded tags and comment."""
    known = traces.select("trace_id", F.coalesce("kb_id", F.lit("default")).alias("__kb"), F.col("session_id").alias("__session"))
    fits = (F.col("rating").isin("up", "down")) & (F.coalesce(F.size("tags"), F.lit(0)) <= 20) & (F.coalesce(F.length("comment"), F.lit(0)) <= 2000)
    in_scope = (F.col("__kb") == F.coalesce("kb_id", F.lit("default"))) & (F.col("__session").isNull() | F.col("__session").eqNullSafe(F.col("session_id")))
    return feedback.join(known, "trace_id").filter(fits & in_scope).drop("__kb", "__session")


def distinct_variants(variants: DataFrame) -> DataFrame:
    """Query variants, the first of those equal but for case and blanks, renumbered."""
    bare = variants.withColumn("text", T.strip("text")).filter("text != ''")
    first = Window.partitionBy("query_id", F.lower("text")).orderBy("variant")
    once = bare.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return once.withColumn("variant", F.row_number().over(Window.partitionBy("query_id").orderBy("variant")) - 1).drop("__n")


def parse_variants(reply: Column, query: Column, most: int = 3) -> Column:
    """A model's lines as query variants behind the query itself: over five characters, one list mark taken off."""
    bare = F.filter(F.transform(F.split(reply, "\n"), T.strip), lambda x: F.length(x) > 5)
    clean = F.transform(bare, lambda x: T.strip(F.regexp_replace(x, r"^(?:[1-5]\.|[-*])\s*", "")))
    kept = F.filter(clean, lambda x: (x != "") & (F.lower(x) != F.lower(query)))
    return F.slice(F.concat(F.array(query), kept), 1, most + 1)


def latest_bad_case(reports: DataFrame, results: DataFrame, traces: DataFrame) -> DataFrame:
    """The first bad case among the newest report's first ten results, else the newest trace: ``kind, key``."""
    newest_report = newest(reports.select("report_id", "updated_at"), 1, ["updated_at"])
    bad = results.join(newest_report, "report_id").filter((F.col("result_index") < 10) & ((F.col("answer_exact_match") < 1) | (F.col("reference_context_recall") < 1)))
    one = bad.orderBy("result_index").limit(1).select(F.lit("eval_result").alias("kind"), F.col("result_index").cast("string").alias("key"))
    other = newest(traces.select("trace_id", "seq"), 1, ["seq"]).select(F.lit("trace").alias("kind"), F.col("trace_id").cast("string").alias("key"))
    return one.unionByName(other).orderBy("kind").limit(1)
