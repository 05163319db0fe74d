import json

from cairn.__main__ import main
from cairn.operators import evaluation, fusion
from cairn.sources import sinks


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.md").write_text("# Leave\n\nTen days of annual leave are granted each year.\n")
    (tmp_path / "raw" / "b.txt").write_text("Travel costs must not exceed the limit of 500 per trip.")
    store = str(tmp_path / "store")
    main(["ingest", str(tmp_path / "raw"), store, "--kb", "kb"])
    assert "2 documents, 2 chunks" in capsys.readouterr().out
    assert {r.kind for r in sinks.read(spark, f"{store}/pages").collect()} == {"topic", "source", "index"}
    main(["search", store, "annual leave"])
    assert ":0" in capsys.readouterr().out
    main(["contexts", store, "annual leave", "--kb", "kb"])
    assert "Ten days of annual leave" in capsys.readouterr().out
    (tmp_path / "raw" / "b.txt").unlink()
    main(["remove", store, "b.txt", "--kb", "kb"])
    main(["search", store, "travel"])
    assert ":0" not in capsys.readouterr().out
    main(["vacuum", store])
    assert "segments removed" in capsys.readouterr().out
    main(["search", store, "annual leave"])
    assert ":0" in capsys.readouterr().out
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "one.json").write_text(json.dumps({"results": [{"kb_id": "kb", "n": 1}, {"kb_id": "x", "n": 3}]}))
    main(["reports", str(tmp_path / "reports"), "--kbs", "kb"])
    assert "{n -> 1.0}" in capsys.readouterr().out
    (tmp_path / "d.jsonl").write_text(json.dumps({"query": "q", "answer": "yes", "reference_answer": "Yes.", "reference_contexts": []}))
    main(["evaluate", str(tmp_path / "d.jsonl"), str(tmp_path / "r.json")])
    assert json.loads((tmp_path / "r.json").read_text())["answer_exact_match"] == 1.0


def test_overfetched_lists(spark):
    names = "query_id long, key string, score double, rank int"
    dense = spark.createDataFrame([(0, "a", 1.0, 1), (0, "b", 0.5, 2)], names)
    sparse = spark.createDataFrame([(0, "b", 4.0, 1), (0, "c", 3.0, 2)], names)
    kept = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [(r.key, round(r.score, 4)) for r in fusion.overfetched(dense, sparse, kept, 5).orderBy("rank").collect()] == [("b", 1.55), ("a", 0.7)]


def test_trace_summary(spark):
    kind = "trace_id string, contexts array<struct<chunk_id: string, wiki_status: string>>, supporting_claims array<struct<claim_type: string, text: string>>"
    rows = [("t1", [("a", "conflicting"), ("b", None)], [("factual", "x"), ("conflict", "y"), ("insufficiency", "z")]), ("t2", None, None)]
    got = {r.trace_id: tuple(r)[1:] for r in evaluation.trace_summary(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"t1": (2, 1, 3, 1, 1), "t2": (0, 0, 0, 0, 0)}
