"""Evaluation: metrics of answered records, aggregates, benchmark reports, diagnosis and replay."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.python import text_udf

LEAST_REFERENCE = 20

# What an answer says when it refuses, or mentions a conflict.
REFUSALS = ("cannot confirm", "insufficient information", "insufficient evidence", "no available context", "please provide", "无法确认", "信息不足", "证据不足", "没有可用上下文", "请提供")
CONFLICTS = ("存在冲突", "说法不一致", "来源不一致", "无法确定", "不能确定", "inconsistent", "conflict")

# Fixed value: characters, of a regular expression's class, that NFKC leaves as they are in any order; ASCII, Latin, Greek, Cyrillic, dashes and quotes, kana, ideographs.
UNCHANGED = (
    r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03cf"
    r"\u0400-\u0482\u048a-\u052f\u2010\u2012-\u2016\u2018-\u2023\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
)

METRICS = ("answer_exact_match", "reference_context_recall", "retrieved_context_count", "conflicting_context_count", "conflict_claim_count", "insufficiency_claim_count")


def _nfkc(text: str) -> str:
    return normalize("NFKC", text)


def comparable(value: Column) -> Column:
    """NFKC, word characters only, lower-cased; texts of ``UNCHANGED`` characters are not handed to Python."""
    folded = F.coalesce(text_udf(_nfkc)(F.when(value.rlike(f"[^{UNCHANGED}]"), value)), value)
    return F.lower(F.regexp_replace(folded, r"[^\p{L}\p{N}_]", ""))


def exact_match(answer: Column, reference: Column, ascii_only: bool = False) -> Column:
    fold = (lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_]", ""))) if ascii_only else comparable
    one, other = fold(T.eval_normalize(answer)), fold(T.eval_normalize(reference))
    return F.when((one != "") & (one == other), 1.0).otherwise(0.0)


def context_recall(references: Column, contexts: Column) -> Column:
    """Share of references, those under 20 characters never counting, found in the joined contexts."""
    merged = F.array_join(F.coalesce(contexts, F.array().cast("array<string>")), "\n")
    long = F.filter(F.transform(references, T.strip), lambda r: F.length(r) >= LEAST_REFERENCE)
    hits = T.once(merged, lambda text: F.size(F.filter(long, lambda r: F.contains(text, r))))
    return F.when(F.coalesce(F.size(references), F.lit(0)) > 0, F.round(hits / F.size(references), 4)).otherwise(0.0)


def metrics(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``records`` (answer, reference_answer, reference_contexts, retrieved_contexts, counts) with the built-in metrics."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int") if c in records.columns else F.lit(0)
    return records.withColumns({
        "answer_exact_match": exact_match(F.col("answer"), F.col("reference_answer"), ascii_only),
        "reference_context_recall": context_recall(F.col("reference_contexts"), F.col("retrieved_contexts")),
        "retrieved_context_count": F.coalesce(F.greatest(F.size("retrieved_contexts"), F.lit(0)), F.lit(0)),
        **{c: count(c) for c in METRICS[3:]},
    })


def aggregate(results: DataFrame) -> DataFrame:
    """One row: means and hit rates, to four places; zeros for no results."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    rate = lambda c: mean(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
    return results.agg(
        F.count(F.lit(1)).alias("records"), mean("answer_exact_match").alias("answer_exact_match"), mean("reference_context_recall").alias("reference_context_recall"), mean("retrieved_context_count").alias("retrieved_context_count_avg"),
        mean("conflicting_context_count").alias("conflicting_context_count_avg"), rate("conflicting_context_count").alias("conflicting_hit_rate"), mean("conflict_claim_count").alias("conflict_claim_count_avg"),
        rate("conflict_claim_count").alias("conflict_claim_hit_rate"), mean("insufficiency_claim_count").alias("insufficiency_claim_count_avg"), rate("insufficiency_claim_count").alias("insufficiency_claim_hit_rate"),
    )


def finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def numeric_means(results: DataFrame) -> DataFrame:
    """The mean of each numeric column, over the rows that have it."""
    names = [f.name for f in results.schema if f.dataType.typeName() in ("integer", "long", "short", "byte", "float", "double") or f.dataType.typeName().startswith("decimal")]
    return results.agg(*[F.round(F.avg(finite(F.col(c))), 4).alias(c) for c in names])


def external_means(results: DataFrame, columns: list[str]) -> DataFrame:
    """Library metrics: finite values, averaged over all records."""
    return results.agg(*[F.round(F.sum(F.coalesce(finite(F.col(c)), F.lit(0.0))) / F.count(F.lit(1)), 4).alias(c) for c in columns])


def nearest_rank(rows: DataFrame, value: str, share: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Per group: count, mean, and the value at index ``min(floor(n * share), n - 1)``.

    Counts by distinct value and their running sums place the rank, so no
    group's values meet in one cell.
    """
    by = by or []
    per = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    if not by:
        return _nearest_rank_of_all(per, value, share)
    edges = Window.partitionBy(*by)
    running = per.withColumns({"__upto": F.sum("__n").over(edges.orderBy(value)), "__all": F.sum("__n").over(edges)})
    at = F.least(F.floor(F.col("__all") * share), F.col("__all") - 1) + 1
    hit = running.groupBy(*by).agg(F.min(F.when(F.col("__upto") >= at, F.col(value))).alias("p"), F.sum("__n").alias("n"), (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"))
    return hit.select(*by, "n", F.round("mean", 4).alias("latency_seconds_avg"), F.round("p", 4).alias("latency_seconds_p95"))


def _nearest_rank_of_all(per: DataFrame, value: str, share: float) -> DataFrame:
    """Of ``per(value, __n)`` in one group: ranges of values are counted first, then only the one that holds the rank is ordered."""
    ranged = per.repartitionByRange(value).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(F.sum("__n").alias("n"), F.sum(F.col(value) * F.col("__n")).alias("s"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("low").collect()  # a row for each range
    n = sum(r["n"] for r in sizes)
    at, before = min(int(n * share), n - 1) + 1, 0
    found = per.sparkSession.range(1).select(F.lit(None).cast("double").alias("p"))
    for r in sizes:
        if before < at <= before + r["n"]:
            own = per.filter(F.col(value).between(r["low"], r["high"])).withColumn("__upto", F.sum("__n").over(Window.orderBy(value)) + before)
            found = own.filter(F.col("__upto") >= at).agg(F.min(value).cast("double").alias("p"))
        before += r["n"]
    if not n:
        return found.select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("latency_seconds_avg"), F.col("p").alias("latency_seconds_p95"))
    mean = sum(r["s"] for r in sizes) / n
    return found.select(F.lit(n).cast("long").alias("n"), F.lit(round(mean, 4)).alias("latency_seconds_avg"), F.round("p", 4).alias("latency_seconds_p95"))


def mentions(answer: Column, markers: tuple[str, ...]) -> Column:
    return T.any_marker(answer, markers) | T.any_marker(F.lower(answer), markers)


def claim_count(claims: Column, kind: str) -> Column:
    """Of ``array<struct<claim_type, ...>>``."""
    return F.coalesce(F.size(F.filter(claims, lambda c: F.lower(T.strip(c["claim_type"])) == kind)), F.lit(0))


def conflicting_contexts(contexts: Column) -> Column:
    return F.coalesce(F.greatest(F.size(F.filter(contexts, lambda c: c["wiki_status"] == "conflicting")), F.lit(0)), F.lit(0))


# Severities of the diagnosis categories.
SEVERITY = {
    "wiki_conflict_detected": "medium", "conflict_claim_missing": "medium", "conflict_not_reflected_in_answer": "high", "retrieval_empty": "high", "generation_empty": "high", "generation_refusal_with_context": "medium",
    "insufficiency_claim_missing": "medium", "rerank_inconsistent": "high", "context_trimmed": "low", "retrieval_gap": "high", "generation_misalignment": "medium", "refusal_bad_case": "medium", "no_obvious_issue": "info",
}


def _findings(rules: list[tuple[str, Column]]) -> Column:
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(name).alias("category"), F.lit(SEVERITY[name]).alias("severity"))) for name, rule in rules]))
    none = F.array(F.struct(F.lit("no_obvious_issue").alias("category"), F.lit("info").alias("severity")))
    return F.when(F.size(found) > 0, found).otherwise(none)


def diagnose_traces(traces: DataFrame) -> DataFrame:
    """Findings of each trace, in rule order: ``traces`` has ``answer, n_contexts, n_conflicting, n_retrieved,
    n_conflict_claims, n_insufficiency_claims, retrieved_chunk_ids, reranked_chunk_ids``."""
    answer = F.coalesce(F.col("answer"), F.lit(""))
    odd, some, hits = F.col("n_conflicting") > 0, F.col("n_contexts") > 0, F.col("n_retrieved") > 0
    refusal = hits & some & (answer != "") & mentions(answer, REFUSALS)
    ids = (F.coalesce(F.size("reranked_chunk_ids"), F.lit(0)) > 0) & (F.coalesce(F.size("retrieved_chunk_ids"), F.lit(0)) > 0)
    rules = [
        ("wiki_conflict_detected", odd), ("conflict_claim_missing", odd & (F.col("n_conflict_claims") == 0)), ("conflict_not_reflected_in_answer", odd & (answer != "") & ~mentions(answer, CONFLICTS)),
        ("retrieval_empty", ~hits), ("generation_empty", hits & some & (answer == "")), ("generation_refusal_with_context", refusal), ("insufficiency_claim_missing", refusal & (F.col("n_insufficiency_claims") == 0)),
        ("rerank_inconsistent", hits & ids & (F.size(F.array_except("reranked_chunk_ids", "retrieved_chunk_ids")) > 0)),
        # can't hold, as contexts are not empty here; kept as the rule stands
        ("context_trimmed", some & hits & (F.col("n_contexts") < F.least(F.col("n_retrieved"), F.lit(1)))),
    ]
    return traces.select("trace_id", F.posexplode(_findings(rules)).alias("ordinal", "f")).select("trace_id", "ordinal", "f.category", "f.severity")


def diagnose_results(results: DataFrame, key: str = "sample_id") -> DataFrame:
    """Findings of each evaluated record."""
    recall, match = F.coalesce("reference_context_recall", F.lit(0.0)), F.coalesce("answer_exact_match", F.lit(0.0))
    rules = [("retrieval_gap", recall < 1.0), ("generation_misalignment", (recall >= 1.0) & (match < 1.0)), ("refusal_bad_case", (recall >= 1.0) & mentions(F.coalesce(F.col("answer"), F.lit("")), REFUSALS))]
    return results.select(key, F.posexplode(_findings(rules)).alias("ordinal", "f")).select(key, "ordinal", "f.category", "f.severity")


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def benchmark(results: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: aggregates, bad cases, conflicting ones among them, latencies. ``traces(trace_id, latency_seconds, n_conflicting)``."""
    both = results.join(traces.select("trace_id", "latency_seconds", "n_conflicting"), "trace_id", "left")
    rows = both.withColumn("conflicting_context_count", F.greatest("conflicting_context_count", F.coalesce("n_conflicting", F.lit(0))))
    bad = (T.safe_float("answer_exact_match") < 1.0) | (T.safe_float("reference_context_recall") < 1.0)
    counted = rows.agg(F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias("bad_case_count"), F.coalesce(F.sum(F.when(bad & (F.col("conflicting_context_count") > 0), 1).otherwise(0)), F.lit(0)).alias("conflicting_bad_case_count"))
    late = nearest_rank(rows, "latency_seconds").drop("n")
    return aggregate(rows).crossJoin(counted).join(late, F.lit(True), "left").fillna(0.0, ["latency_seconds_avg", "latency_seconds_p95"])  # one row each


def fill_records(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Records without an answer or contexts take those of their run (``sample_id, answer, contexts, counts``); counts take the greater."""
    own = runs.select("sample_id", F.col("answer").alias("__answer"), F.col("contexts").alias("__contexts"), *[F.col(c).alias(f"__{c}") for c in METRICS[3:]])
    both = records.join(own, "sample_id", "left")
    return both.withColumns({
        "answer": F.coalesce(T.blank_to_null(T.strip("answer")), "__answer"),
        "retrieved_contexts": F.when(F.size("retrieved_contexts") > 0, F.col("retrieved_contexts")).otherwise(F.col("__contexts")),
        **{c: F.greatest(F.coalesce(c, F.lit(0)), F.coalesce(f"__{c}", F.lit(0))) for c in METRICS[3:]},
    }).drop("__answer", "__contexts", *[f"__{c}" for c in METRICS[3:]])


def replay_diff(original: DataFrame, replayed: DataFrame) -> DataFrame:
    """``trace_id, status, diffs`` of two runs' ``trace_id, query, answer, context_ids, citation_ids``."""
    both = original.alias("o").join(replayed.alias("r"), "trace_id", "left")
    ids = lambda side, c: F.array_sort(F.array_distinct(F.coalesce(F.col(f"{side}.{c}"), F.array().cast("array<string>"))))
    changed = lambda c: F.when(ids("o", c) != ids("r", c), F.lit(c))
    one, other = T.strip("o.answer"), T.strip("r.answer")
    diffs = F.array_compact(F.array(changed("context_ids"), changed("citation_ids"), F.when((one != "") & (other != "") & (one != other), "answer")))
    state = F.when(F.coalesce(F.col("o.query"), F.lit("")) == "", "trace_missing_query").when(F.size(diffs) > 0, "diff").otherwise("identical")
    return both.select("trace_id", state.alias("status"), F.when(state == "trace_missing_query", F.array().cast("array<string>")).otherwise(diffs).alias("diffs"))


def replay_requests(traces: DataFrame, replay_compat: bool = False) -> DataFrame:
    """``trace_id, query, kb_id, session_id, top_k, filters``: what is asked again for each of ``traces``.

    ``traces`` has ``explicit_filters``, which the caller gave, and ``filters``,
    with which the search ran, inferred ones included. With ``replay_compat``
    the latter are handed in as if the caller had given them, types no longer
    soft, and ``top_k`` is forgotten. A trace without a query is not asked.
    """
    rows = traces.filter(F.coalesce(F.col("query"), F.lit("")) != "")
    kb = F.coalesce(T.blank_to_null(F.col("kb_id")), F.lit("default")).alias("kb_id")
    again = F.when(F.col("filters").isNotNull(), F.col("filters").withField("soft", F.lit(False))) if replay_compat else F.col("explicit_filters")
    top = F.lit(None).cast("int") if replay_compat else F.col("top_k").cast("int")
    return rows.select("trace_id", "query", kb, "session_id", top.alias("top_k"), again.alias("filters"))


def trace_summary(traces: DataFrame) -> DataFrame:
    """``trace_id`` and counts of ``contexts`` (all, conflicting) and ``supporting_claims`` (all, conflicts, insufficiencies)."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return traces.select(
        "trace_id", size("contexts").alias("context_count"), conflicting_contexts(F.col("contexts")).alias("conflicting_context_count"), size("supporting_claims").alias("claim_count"),
        F.greatest(claim_count(F.col("supporting_claims"), "conflict"), F.lit(0)).alias("conflict_claim_count"), F.greatest(claim_count(F.col("supporting_claims"), "insufficiency"), F.lit(0)).alias("insufficiency_claim_count"),
    )
