"""Metadata predicates: inferred from a query's text, merged with explicit ones, matched against chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T

# Fixed value: a word that is a number and nothing else.
NUMBER = r"^\d+(?:_\d+)*(?:\.\d*)?(?:[eE][+-]?\d+)?$"
KIND = "struct<doc_types: array<string>, version: string, date_from: string, date_to: string, soft: boolean>"


def infer(query: str | Column) -> Column:
    """``doc_types`` (soft), ``version``, and dates: a full date is an upper bound, else a year its range."""
    text = T.col(query)
    lowered = F.lower(text)
    types = F.array_compact(F.array(*[F.when(T.any_marker(lowered, markers), F.lit(name)) for name, markers in T.DOC_TYPES.items()]))
    day = T.effective_date(text)
    year = T.blank_to_null(F.regexp_extract(text, r"(?U)\b((?:19|20)\d{2})\b", 1))
    to = F.when(day.isNotNull(), T.normalize_date(day)).otherwise(F.concat(year, F.lit("-12-31")))
    return F.struct(
        F.when(F.size(types) > 0, types).alias("doc_types"), T.normalize_version(T.version(text)).alias("version"),
        F.when(day.isNull(), F.concat(year, F.lit("-01-01"))).alias("date_from"), to.alias("date_to"), (F.size(types) > 0).alias("soft"),
    ).cast(KIND)


def merge(explicit: Column, inferred: Column) -> Column:
    """Explicit fields win; empty ones do not count; explicit types are never soft."""
    own = F.when(F.size(explicit["doc_types"]) > 0, explicit["doc_types"])
    pick = lambda f: F.coalesce(T.blank_to_null(explicit[f]), T.blank_to_null(inferred[f])).alias(f)
    soft = F.when(own.isNotNull(), F.lit(False)).otherwise(F.coalesce(explicit["soft"], inferred["soft"], F.lit(False)))
    return F.struct(F.coalesce(own, F.when(F.size(inferred["doc_types"]) > 0, inferred["doc_types"])).alias("doc_types"), pick("version"), pick("date_from"), pick("date_to"), soft.alias("soft")).cast(KIND)


def matches(filters: Column, doc_type: Column, version: Column, effective_date: Column, doc_types: Column | None = None) -> Column:
    """Whether a chunk's metadata pass; without a filter all do."""
    wanted = F.transform(filters["doc_types"], F.lower)
    single = F.when(F.coalesce(doc_type, F.lit("")) != "", F.array(F.lower(doc_type))).otherwise(F.array().cast("array<string>"))
    have = single if doc_types is None else F.when(doc_types.isNotNull(), F.transform(F.filter(doc_types, lambda x: T.strip(x) != ""), F.lower)).otherwise(single)
    by_type = (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | (F.coalesce(filters["soft"], F.lit(False)) & (F.size(have) == 0)) | F.arrays_overlap(have, wanted)
    by_version = F.coalesce(filters["version"], F.lit("")).eqNullSafe("") | T.normalize_version(version).eqNullSafe(T.normalize_version(filters["version"]))
    low, high, day = T.parse_date(filters["date_from"]), T.parse_date(filters["date_to"]), T.parse_date(effective_date)
    by_date = (low.isNull() & high.isNull()) | (day.isNotNull() & (low.isNull() | (day >= low)) & (high.isNull() | (day <= high)))
    return F.coalesce(filters.isNull() | (F.coalesce(by_type, F.lit(False)) & by_version & F.coalesce(by_date, F.lit(False))), F.lit(False))


def display(filters: Column) -> Column:
    """Without how types match."""
    return filters.dropFields("soft")


def relevance_score(reply: str | Column) -> Column:
    """A judge's reply as a score: the first word that is a number, of words that begin a line with a digit, between 0 and 1; 0.5 if there is none."""
    words = F.transform(F.split(T.col(reply), "\n"), lambda x: F.regexp_extract(T.strip(x), r"(?U)^\d\S*", 0))
    number = F.try_element_at(F.filter(words, lambda x: x.rlike(NUMBER)), F.lit(1)).try_cast("double")
    return F.least(F.greatest(F.coalesce(number, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def relevant(rows: DataFrame, k: int, least: float = 0.5, text: str = "text", score: str = "relevance") -> DataFrame:
    """Rows scored ``least`` or more, the best ``k`` of each query; texts under ten characters score 0."""
    from cairn.operators.bm25 import top

    judged = rows.withColumn(score, F.when(F.length(T.strip(F.coalesce(F.col(text), F.lit("")))) < 10, 0.0).otherwise(F.col(score)))
    return top(judged.filter(F.col(score) >= least), k, score)


def allowed(rows: DataFrame, kbs: DataFrame, column: str = "kb_id") -> DataFrame:
    """Rows of the allowed knowledge bases; one without any is of the default one."""
    own = kbs.select(F.col("kb_id").alias("__kb")).distinct()
    return rows.join(own, F.coalesce(F.col(column), F.lit("default")) == F.col("__kb"), "left_semi")


def trace_in_scope(kb: Column, session: Column, asked_kb: Column, asked_session: Column) -> Column:
    return (F.coalesce(kb, F.lit("default")) == asked_kb) & (session.isNull() | session.eqNullSafe(asked_session))


def clean_session(session: str | Column) -> Column:
    """Blank and placeholder session ids as null."""
    bare = T.strip(session)
    return F.when(~F.lower(bare).isin("", "null", "none", "__shared__"), bare)
