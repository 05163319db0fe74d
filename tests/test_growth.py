"""What a query exchanges or holds in a worker, where the tables are large."""

import os
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn import catalog
from cairn.functions import python
from cairn.operators import evaluation, scoring
from cairn.sources import html

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unsized(spark):
    """No table is known to be small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("name", "key"), [("answer_spans", "key"), ("coverage_terms", "key"), ("context_build", "chunk_id"), ("flagship", "key")])
def test_documents_of_hits_are_not_exchanged(unsized, name, key):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    made = catalog.flagship(unsized, SF) if name == "flagship" else catalog.QUERIES[name](unsized, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert not re.search(rf"hashpartitioning\({key}#\d+L?, \d+", plan)


def test_rows_of_hits_of_many_queries(unsized, monkeypatch):
    rows = unsized.range(50).select(F.col("id").alias("key"), (F.col("id") * 7).alias("x"))
    queries = unsized.range(5).withColumnRenamed("id", "query_id")
    hits = queries.crossJoin(unsized.createDataFrame([(3,), (49,), (60,)], "key long"))
    want = sorted((q, k, 7 * k) for q in range(5) for k in (3, 49))
    for most in (5, 4):
        monkeypatch.setattr(scoring, "MOST_QUERIES", most)
        made = scoring.with_rows(hits, queries, rows)
        assert ("BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()) == (most == 5)
        assert sorted(map(tuple, made.select("query_id", "key", "x").collect())) == want


@pytest.fixture
def batches(spark):
    """Nothing says how large batches are."""
    held = spark.conf.get(python.BATCH, None)
    spark.conf.unset(python.BATCH)
    yield spark
    spark.conf.unset(python.BATCH) if held is None else spark.conf.set(python.BATCH, held)


def test_workers_are_handed_bounded_batches(batches):
    def batch_bytes(texts: pd.Series) -> pd.Series:
        n = sum(len(x.encode()) for x in texts)
        return texts.map(lambda _: n)

    page = F.concat(F.lit("<p>"), F.repeat(F.lit("h\u00e9llo "), 2000), F.col("id").cast("string"))
    pages = batches.range(0, 2000, 1, 1).select("id", page.alias("html"))
    whole = 2000 * len("h\u00e9llo ".encode() * 2000)
    html.html_to_text(F.col("html"))
    assert whole > 4 * python.MOST_BYTES
    assert pages.select(F.pandas_udf(batch_bytes, "long")("html").alias("n")).agg(F.max("n")).first()[0] < 1.1 * python.MOST_BYTES
    batches.conf.set(python.BATCH, "64m")
    html.html_to_text(F.col("html"))
    assert batches.conf.get(python.BATCH) == "64m"
    texts = pages.filter("id < 2").withColumn("html", F.when(F.col("id") == 1, F.col("html")))
    assert [r[0] for r in texts.orderBy("id").select(html.html_to_text(F.col("html"))).collect()] == [None, "h\u00e9llo " * 2000 + "1"]


def test_metrics_hand_over_only_what_changes(spark):
    rows = [("ﬁn １２", "fin 12"), ("naïve — „Straße“ Ω Жук かな 漢字", "naïve Straße Ω Жук かな 漢字"), ("e\u0301a", "éa"), ("ﬁ", "fo"), (None, None), ("plain", "Plain!"), ("か\u3099", "が")]
    records = spark.createDataFrame([(a, b, [], []) for a, b in rows], "answer string, reference_answer string, reference_contexts array<string>, retrieved_contexts array<string>")
    made = evaluation.metrics(records)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # both texts of a row go to one worker
    assert [r.answer_exact_match for r in made.collect()] == [1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0]
    held = spark.range(1).select(*[F.lit(x).rlike(f"[^{evaluation.UNCHANGED}]").alias(str(n)) for n, (x, _) in enumerate(rows)]).first()
    assert list(held) == [True, False, True, True, None, False, True]


def test_unchanged_characters():
    own = re.compile(f"[{evaluation.UNCHANGED}]")
    joined = {int(d.split()[1], 16) for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<" and " " in d}
    for x in filter(own.fullmatch, map(chr, range(0x110000))):
        assert unicodedata.normalize("NFKC", x) == x and not unicodedata.combining(x) and ord(x) not in joined
        assert not 0x1100 <= ord(x) <= 0x11FF
