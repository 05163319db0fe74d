import pytest
from pyspark.sql import functions as F

from cairn.operators import evaluation, stores
from cairn.plans import evaluate

RECORD = "sample_id string, trace_id string, query string, answer string, reference_answer string, reference_contexts array<string>, retrieved_contexts array<string>, conflicting_context_count int, conflict_claim_count int, insufficiency_claim_count int"
LONG = "a reference that is long enough to count"


def records(spark):
    rows = [
        ("s1", "t1", "q", "**Ten days** [doc:1].", "ten　days", [LONG], ["x " + LONG + " y"], 1, 0, 0),
        ("s2", "t2", "q", "Insufficient information", "yes", [LONG, "short"], [LONG, "short"], 0, 0, 1), ("s3", None, "q", None, None, [], None, 0, 0, 0),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_metrics(spark):
    rows = evaluation.metrics(records(spark)).orderBy("sample_id").collect()
    assert [(r.answer_exact_match, r.reference_context_recall, r.retrieved_context_count) for r in rows] == [(1.0, 1.0, 1), (0.0, 0.5, 2), (0.0, 0.0, 0)]
    total = evaluation.aggregate(evaluation.metrics(records(spark))).first()
    assert total.records == 3 and total.answer_exact_match == 0.3333 and total.conflicting_hit_rate == 0.3333
    empty = evaluation.aggregate(evaluation.metrics(records(spark)).limit(0)).first()
    assert empty.records == 0 and empty.answer_exact_match == 0.0


def test_judged_metrics(spark):
    marks = {"s1": 0.5, "s2": float("nan"), "s3": None}
    score = F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    judge = lambda rows: rows.withColumn("faithfulness", F.element_at(score, F.col("sample_id")))
    out = evaluate.run(records(spark), judge=judge, judged=("faithfulness",))["aggregate"].first()
    assert out.faithfulness == 0.1667 and out.records == 3
    with pytest.raises(ValueError, match="left out relevance"):
        evaluate.run(records(spark), judge=judge, judged=("relevance",))


def test_replay_requests(spark):
    from cairn.operators import filters

    kind = f"trace_id string, query string, kb_id string, session_id string, top_k int, explicit_filters {filters.KIND}, filters {filters.KIND}"
    soft, hard = (["policy"], None, None, None, True), (["policy"], None, None, None, False)
    traces = spark.createDataFrame([("a", "q", None, "s", 7, None, soft), ("b", "q", "kb", None, 3, hard, hard), ("c", "", "kb", None, 3, None, None)], kind)
    again = {r.trace_id: (r.kb_id, r.top_k, r.filters and r.filters.soft) for r in evaluation.replay_requests(traces).collect()}
    assert again == {"a": ("default", 7, None), "b": ("kb", 3, False)}
    compat = {r.trace_id: (r.kb_id, r.top_k, r.filters and r.filters.soft) for r in evaluation.replay_requests(traces, replay_compat=True).collect()}
    assert compat == {"a": ("default", None, False), "b": ("kb", None, False)}


def test_benchmark(spark):
    traces = spark.createDataFrame([("t1", 1.2, 0), ("t2", 0.8, 2)], "trace_id string, latency_seconds double, n_conflicting int")
    out = evaluate.run(records(spark).filter("trace_id IS NOT NULL"), traces=traces)
    row = out["aggregate"].first()
    assert (row.bad_case_count, row.conflicting_bad_case_count, row.latency_seconds_avg, row.latency_seconds_p95, row.conflicting_hit_rate) == (1, 1, 1.0, 1.2, 1.0)
    assert {r.category: r.n for r in out["counts"].collect()} == {"retrieval_gap": 1}


def test_trace_rules(spark):
    names = "trace_id string, answer string, n_contexts int, n_conflicting int, n_retrieved int, n_conflict_claims int, n_insufficiency_claims int, retrieved_chunk_ids array<string>, reranked_chunk_ids array<string>"
    rows = [("a", "sure", 2, 1, 2, 0, 0, ["x"], ["y"]), ("b", "", 0, 0, 0, 0, 0, None, None), ("c", None, 1, 0, 1, 0, 0, ["x"], ["x"]), ("d", "Please provide more", 1, 0, 1, 0, 0, [], []), ("e", "fine", 1, 0, 1, 0, 0, ["x"], ["x"])]
    got = {}
    for r in evaluation.diagnose_traces(spark.createDataFrame(rows, names)).orderBy("trace_id", "ordinal").collect():
        got.setdefault(r.trace_id, []).append(r.category)
    assert got == {
        "a": ["wiki_conflict_detected", "conflict_claim_missing", "conflict_not_reflected_in_answer", "rerank_inconsistent"], "b": ["retrieval_empty"], "c": ["generation_empty"],
        "d": ["generation_refusal_with_context", "insufficiency_claim_missing"], "e": ["no_obvious_issue"],
    }


def test_pages_and_retention(spark):
    rows = spark.createDataFrame([(f"t{i}", i, "a" if i % 2 else "b") for i in range(1, 6)], "trace_id string, seq long, kb_id string")
    got = stores.page(rows.filter("kb_id = 'a'"), [F.col("seq").desc()], 1, 2).collect()
    assert [(r.trace_id, r.total, r.total_pages) for r in got] == [("t5", 3, 2), ("t3", 3, 2)]
    assert {r.trace_id for r in stores.newest(rows, 2, ["seq"]).collect()} == {"t4", "t5"}
    assert stores.newest(rows, 1, ["seq"], ["kb_id"]).count() == 2
    with pytest.raises(ValueError):
        stores.page(rows, ["seq"], 0, 5)


def test_catalog(spark):
    catalog = spark.createDataFrame([("default", "Default")], "kb_id string, name string")
    new = lambda i, n="N": spark.createDataFrame([(i, n)], "kb_id string, name string")
    assert stores.create_entries(catalog, new("team-1", " x" * 200)).filter("kb_id = 'team-1' AND length(name) = 160").count() == 1
    for bad in (new("default"), new("-x"), new("ok", " ")):
        with pytest.raises(Exception):  # noqa: B017
            stores.create_entries(catalog, bad).collect()
    assert stores.seed(catalog, new("default").unionByName(new("b"))).count() == 2


def test_upsert_delete_feedback(spark):
    table = spark.createDataFrame([("c1", "s", "kb", 1), ("c2", "s", None, 1)], "chunk_id string, source_path string, kb_id string, v int")
    newer = spark.createDataFrame([("c1", "s", "kb", 2), ("c3", "s", "kb", 2)], "chunk_id string, source_path string, kb_id string, v int")
    assert sorted((r.chunk_id, r.v) for r in stores.upsert(table, newer, ["chunk_id"]).collect()) == [("c1", 2), ("c2", 1), ("c3", 2)]
    assert [r.chunk_id for r in stores.delete_source(table, "s", "default").collect()] == ["c1"]
    traces = spark.createDataFrame([("t1", "kb", None), ("t2", "kb", "s9")], "trace_id string, kb_id string, session_id string")
    feedback = spark.createDataFrame([("t1", "up", "kb", "x"), ("t2", "up", "kb", "x"), ("t9", "up", "kb", "x"), ("t1", "maybe", "kb", "x"), ("t1", "down", "other", "x")], "trace_id string, rating string, kb_id string, session_id string").withColumns({"tags": F.array(F.lit("a")), "comment": F.lit(None).cast("string")})
    assert stores.accept_feedback(feedback, traces).count() == 1


def test_variants(spark):
    reply = "1. how many days off\n- short\nhow much leave\n* Leave?\n2. how many days off"
    row = spark.createDataFrame([(reply,)], "r string").select(stores.parse_variants(F.col("r"), F.lit("how much leave")).alias("v")).first().v
    assert row == ["how much leave", "how many days off", "short", "Leave?"][: len(row)] and len(row) <= 4
    rows = spark.createDataFrame([(0, 0, "A b"), (0, 1, " a B "), (0, 2, ""), (0, 3, "c")], "query_id long, variant int, text string")
    assert [(r.variant, r.text) for r in stores.distinct_variants(rows).orderBy("variant").collect()] == [(0, "A b"), (1, "c")]


def test_replay(spark):
    names = "trace_id string, query string, answer string, context_ids array<string>, citation_ids array<string>"
    one = spark.createDataFrame([("a", "q", "x ", ["1", "2"], []), ("b", "q", "x", ["1"], ["1"]), ("c", "", "x", [], [])], names)
    two = spark.createDataFrame([("a", "q", "x", ["2", "1"], []), ("b", "q", "y", ["2"], ["1"]), ("c", "q", "x", [], [])], names)
    got = {r.trace_id: (r.status, r.diffs) for r in evaluation.replay_diff(one, two).collect()}
    assert got == {"a": ("identical", []), "b": ("diff", ["context_ids", "answer"]), "c": ("trace_missing_query", [])}


def test_nearest_rank_of_all_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("v"))
    got = evaluation.nearest_rank(rows, "v").first()
    assert (got.n, got.latency_seconds_avg, got.latency_seconds_p95) == (1000, 499.5, 950.0)
    got = evaluation.nearest_rank(rows.limit(0), "v").first()
    assert (got.n, got.latency_seconds_p95) == (0, None)
