"""Evaluation of a dataset: fill, measure, diagnose, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import evaluation, filters


def records(dataset: DataFrame) -> DataFrame:
    """Records with ids and a knowledge base, queries stripped."""
    numbered = dataset if "sample_id" in dataset.columns else dataset.withColumn("sample_id", F.lit(None).cast("string"))
    return numbered.withColumns({"sample_id": F.coalesce("sample_id", F.concat(F.lit("sample-"), F.sha2(F.concat_ws("|", "query", "reference_answer"), 256).substr(1, 12))), "kb_id": F.coalesce("kb_id", F.lit("default")) if "kb_id" in dataset.columns else F.lit("default")})


def run(
    dataset: DataFrame, runs: DataFrame | None = None, traces: DataFrame | None = None, kbs: DataFrame | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None, judged: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """``results``, ``aggregate`` (with bad cases and latencies, given traces), ``findings`` and their ``counts``.

    ``judge`` adds the columns ``judged`` to the results, a library's or a
    model's metrics; their means over all records, of finite values, join the
    aggregate.
    """
    rows = records(dataset)
    if kbs is not None:
        rows = filters.allowed(rows, kbs)
    if runs is not None:
        rows = evaluation.fill_records(rows, runs)
    results = evaluation.metrics(rows)
    if judge is not None:
        results = judge(results)
        lacking = [c for c in judged if c not in results.columns]
        if lacking:
            raise ValueError(f"the judge left out {', '.join(lacking)}")
    findings = evaluation.diagnose_results(results.filter((F.col("answer_exact_match") < 1) | (F.col("reference_context_recall") < 1)))
    total = evaluation.aggregate(results) if traces is None else evaluation.benchmark(results, traces)
    if judged:
        total = total.crossJoin(evaluation.external_means(results, list(judged)))  # one row each
    return {"results": results, "aggregate": total, "findings": findings, "counts": evaluation.category_counts(findings)}
