"""Stored reports, and what of them a caller may see.

A report is a JSON object with ``results``, a list of objects whose fields no
schema fixes. Results stay variants: a report is a row, its results are rows of
one plan, and their numbers are averaged field by field whatever the fields are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, nth, result``: the results of stored reports as variants; a report that is no object, or has no list of results, has none."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("report"))
    results = F.try_variant_get("report", "$.results", "array<variant>")
    each = rows.select("path", F.posexplode(results).alias("nth", "result"))
    return each.filter(F.startswith(F.schema_of_variant("result"), F.lit("OBJECT")))


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, has_counts``: the stored reports, and whether they count diagnoses."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("report"))
    return rows.select("path", F.try_variant_get("report", "$.diagnosis_counts", "variant").isNotNull().alias("has_counts"))


def as_variants(results: DataFrame) -> DataFrame:
    """A table's rows as ``path, nth, result``, as if a report had them; null fields are left out."""
    return results.select(F.lit("").alias("path"), F.monotonically_increasing_id().alias("nth"), F.try_parse_json(F.to_json(F.struct(*results.columns))).alias("result"))


def _text(path: str) -> Column:
    """A field as text; null where it is absent, null or empty."""
    value = F.try_variant_get("result", path, "string")
    return F.when(value != "", value)


def with_base(results: DataFrame, traces: DataFrame) -> DataFrame:
    """``results`` with ``kb_id``: their own, else that of their trace (``traces(trace_id, kb_id)``, the default one where it has none), else null.

    Results that name a base are not joined; one trace has one row at least, of
    which any base that is not null counts.
    """
    rows = results.withColumns({"kb_id": _text("$.kb_id"), "__trace": _text("$.trace_id")})
    known = traces.groupBy(F.col("trace_id").cast("string").alias("__trace")).agg(F.coalesce(F.max(F.when(F.col("kb_id") != "", F.col("kb_id"))), F.lit("default")).alias("__kb"))
    asked = F.col("kb_id").isNull() & F.col("__trace").isNotNull()
    traced = rows.filter(asked).join(known, "__trace", "left").withColumn("kb_id", F.col("__kb")).drop("__kb")
    return rows.filter(~asked).unionByName(traced).drop("__trace")


def scoped(results: DataFrame, traces: DataFrame, allowed: DataFrame) -> DataFrame:
    """The results of ``allowed(kb_id)`` only; those of no known base are dropped."""
    return with_base(results, traces).join(allowed.select("kb_id").distinct(), "kb_id", "left_semi")


def _fields(results: DataFrame) -> DataFrame:
    """``path, field, value``: each number of each result; flags and texts are none."""
    spark = results.sparkSession
    each = results.lateralJoin(spark.tvf.variant_explode(F.col("result").outer())).select("path", F.col("key").alias("field"), F.col("value"))
    number = F.regexp_like(F.schema_of_variant("value"), F.lit(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"))
    return each.filter(number).select("path", "field", F.try_variant_get("value", "$", "double").alias("value"))


def summaries(results: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """``path, records, aggregate, diagnosis_counts``, a row for each report.

    ``aggregate``: each numeric field's mean over the results that have it, to
    four places. ``diagnosis_counts``: findings by category, null for reports
    that do not count them. ``reports(path, has_counts)``: also those of which
    nothing is left; without it, all reports that have results count findings.
    """
    counted = results.groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    means = _fields(results).groupBy("path", "field").agg(F.round(F.avg("value"), 4).alias("mean"))
    entries = lambda rows, key, value, name: rows.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    aggregate = entries(means, "field", "mean", "aggregate")
    findings = results.select("path", F.explode(F.try_variant_get("result", "$.diagnosis.findings", "array<variant>")).alias("f"))
    categories = findings.select("path", F.try_variant_get("f", "$.category", "string").alias("category")).filter("category <> ''")
    counts = entries(categories.groupBy("path", "category").agg(F.count(F.lit(1)).alias("n")), "category", "n", "diagnosis_counts")
    base = counted.withColumn("has_counts", F.lit(True)) if reports is None else reports.join(counted, "path", "left")
    joined = base.join(aggregate, "path", "left").join(counts, "path", "left")
    none = F.create_map().cast("map<string, double>")
    held = F.when(F.col("has_counts"), F.coalesce("diagnosis_counts", F.create_map().cast("map<string, bigint>")))
    return joined.select("path", F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("aggregate", none).alias("aggregate"), held.alias("diagnosis_counts"))


def scoped_reports(spark: SparkSession, paths: str | list[str], traces: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """``summaries`` of stored reports over the results of ``allowed`` bases, or of all where that is None."""
    results = read_results(spark, paths)
    return summaries(results if allowed is None else scoped(results, traces, allowed), read_reports(spark, paths))
