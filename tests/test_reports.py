"""Stored reports by knowledge base."""

import json

import pytest

from cairn.operators import reports


@pytest.fixture
def stored(tmp_path):
    finding = lambda *names: {"diagnosis": {"findings": [{"category": n} for n in names] + ["no object", {"category": None}]}}
    results = [
        {"kb_id": "a", "recall": 1.0, "hits": 2, "flag": True, "note": "x"} | finding("gap"),
        {"kb_id": "b", "recall": 0.0, "hits": 10} | finding("gap", "late"),
        {"trace_id": "t1", "recall": 0.5, "only_here": 3} | finding("late"),
        {"kb_id": "", "trace_id": "t2", "recall": 0.25},
        {"trace_id": "unknown", "recall": 9.0},
        {"recall": 7.0},
        "no object", None, [1],
    ]
    (tmp_path / "one.json").write_text(json.dumps({"records": 9, "status": "ok", "results": results, "aggregate": {"recall": 99}, "diagnosis_counts": {"gap": 2}}))
    (tmp_path / "two.json").write_text(json.dumps({"records": 1, "results": [{"kb_id": "b", "recall": 0.5}]}))
    (tmp_path / "bad.json").write_text("[1")
    (tmp_path / "none.json").write_text(json.dumps({"records": 1, "results": 3}))
    return str(tmp_path)


def by_name(rows):
    return {r.path.rsplit("/", 1)[1]: (r.records, r.aggregate, r.diagnosis_counts) for r in rows.collect()}


def test_only_allowed_bases_are_aggregated_again(spark, stored):
    traces = spark.createDataFrame([("t1", "a"), ("t2", None), ("t3", "b")], "trace_id string, kb_id string")
    allowed = lambda *kbs: spark.createDataFrame([(k,) for k in kbs], "kb_id string")
    got = by_name(reports.scoped_reports(spark, stored, traces, allowed("a", "default")))
    assert got["one.json"] == (3, {"recall": 0.5833, "hits": 2.0, "only_here": 3.0}, {"gap": 1, "late": 1})
    assert got["two.json"] == (0, {}, None) and got["bad.json"] == (0, {}, None) and got["none.json"] == (0, {}, None)
    got = by_name(reports.scoped_reports(spark, stored, traces, allowed("b")))
    assert got["one.json"] == (1, {"recall": 0.0, "hits": 10.0}, {"gap": 1, "late": 1}) and got["two.json"] == (1, {"recall": 0.5}, None)
    got = by_name(reports.scoped_reports(spark, stored, traces, allowed()))
    assert got["one.json"] == (0, {}, {})
    everything = by_name(reports.scoped_reports(spark, stored, traces, None))
    assert everything["one.json"][0] == 6 and everything["one.json"][1]["recall"] == round((1 + 0 + 0.5 + 0.25 + 9 + 7) / 6, 4)


def test_tables_as_reports(spark):
    rows = spark.createDataFrame([("a", None, 1.0, True), (None, "t", 2.0, False), (None, None, 5.0, None)], "kb_id string, trace_id string, score double, flag boolean")
    traces = spark.createDataFrame([("t", "a"), ("t", None)], "trace_id string, kb_id string")
    found = reports.summaries(reports.scoped(reports.as_variants(rows), traces, spark.createDataFrame([("a",), ("a",)], "kb_id string"))).collect()
    assert [(r.records, r.aggregate, r.diagnosis_counts) for r in found] == [(2, {"score": 1.5}, {})]
