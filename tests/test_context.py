import random

from pyspark.sql import functions as F

from cairn.operators import context

ORDER = context.BUCKETS


def taking_turns(items, limit, quotas):
    """Plain model: ``items`` are (rank, id, bucket) in order."""
    queues, taken, out = {b: [i for i in items if i[2] == b] for b in ORDER}, dict.fromkeys(ORDER, 0), []
    while len(out) < limit:
        before = len(out)
        for b in ORDER:
            if len(out) < limit and taken[b] < quotas.get(b, limit) and queues[b]:
                out.append(queues[b].pop(0))
                taken[b] += 1
        if len(out) == before:
            break
    return (out + [i for i in items if i not in out])[:limit]


def test_quotas_against_a_plain_model(spark):
    rng = random.Random(3)
    for limit, quotas in ((6, {"topic": 2, "raw": 3, "source": 1, "index": 1}), (4, {"topic": 0}), (9, {"raw": 1})):
        rows = [(q, r, f"{q}-{r}", rng.choice(ORDER)) for q in range(40) for r in range(rng.randint(0, 14))]
        got = context.quota_pick(spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, bucket string"), limit, quotas).orderBy("query_id", "position").collect()
        for q in range(40):
            want = [i[1] for i in taking_turns([(r, c, b) for k, r, c, b in rows if k == q], limit, quotas)]
            assert [g.chunk_id for g in got if g.query_id == q] == want


def hits(spark, rows):
    names = "query_id long, rank int, chunk_id string, text string, score double, parent_chunk_id string, parent_text string, wiki_kind string, wiki_status string, freshness_tier string"
    return spark.createDataFrame(rows, names).withColumns({"title": F.lit("t"), "source_path": F.lit("s"), "source_key": F.lit("k"), "section_path": F.array(F.lit("Policy"), F.lit("Leave Policy"))})


def test_parents(spark):
    rows = [(0, 1, "a", "child a", 1.0, "p", "whole", None, None, None), (0, 2, "b", "child b", 0.9, "p", "whole", None, None, None), (0, 3, "c", "child c", 0.8, "q", "cut ...", None, None, None)]
    got = context.build(hits(spark, rows), spark.createDataFrame([(0, "")], "query_id long, query string"), 5).orderBy("position").collect()
    assert [(r.chunk_id, r.text, r.title, r.citation_label) for r in got] == [("a", "whole", "Policy > Leave Policy", "C1"), ("c", "child c", "Policy > Leave Policy", "C2")]


def test_coverage_swaps_in_what_is_missing(spark):
    rows = [(0, i, f"h{i}", "annual leave days", 1.0 - i / 10, None, None, None, None, None) for i in range(1, 5)] + [(0, 5, "late", "carryover limits", 0.1, None, None, None, None, None)]
    got = {r.chunk_id for r in context.build(hits(spark, rows), spark.createDataFrame([(0, "annual leave carryover")], "query_id long, query string"), 4).collect()}
    assert "late" in got and len(got) == 4 and "h4" not in got


def test_evidence_order(spark):
    rows = [(0, 1, "s", "x", 1.0, None, None, None, None, None), (0, 2, "p", "x", 0.9, None, None, None, None, "primary"), (0, 3, "c", "x", 0.8, None, None, "topic", "conflicting", "primary"), (0, 4, "t", "x", 0.7, None, None, "topic", "stable", None)]
    got = context.build(hits(spark, rows), spark.createDataFrame([(0, "q")], "query_id long, query string"), 4, {"topic": 2, "raw": 2, "source": 1, "index": 1}).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: r.citation_label)][-2:] == ["s", "c"]
    assert {r.chunk_id: r.evidence_role for r in got} == {"s": "supporting", "p": "primary", "c": "conflicting", "t": "primary"}
