"""The pipeline against its operators one by one, where the test tables are at hand."""

import os

import pytest

import corpus_pipeline
from cairn.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from cairn.llm._store import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns_and_act(spark, docs):
    held = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, held, SF), name)
        if name != "packing":
            assert after.schema == docs.schema
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in held.select("doc_id").collect()}
        sizes.append(after.select("doc_id").distinct().count())
        held = after
    assert sizes == sorted(sizes, reverse=True)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, held.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_against_their_rules(spark, docs):
    model = toxicity.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    one = materialise(corpus_pipeline.drop_toxic(spark, docs, SF), "one")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - bad
    two = materialise(corpus_pipeline.drop_recurring_lines(spark, one, SF), "two")
    assert {(r.doc_id, r.text) for r in two.collect()} == {(r.doc_id, r.text) for r in line_dedup.dedup_lines(one).collect()} and two.filter("n_chars <> length(text)").count() == 0
    three = materialise(corpus_pipeline.drop_near_copies(spark, two, SF), "three")
    assert {r.doc_id for r in three.collect()} == {r.class_id for r in jaccard_join.join(two).collect()}
    leaky = {r.doc_id for r in decontaminate.leaks(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    four = materialise(corpus_pipeline.drop_benchmark_leaks(spark, three, SF), "four")
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - leaky
    assert packing.pack_documents(four).select("doc_id").distinct().count() == four.count()


def test_line_dedup_and_warc_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    from cairn.llm import catalog

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in catalog.ORACLES.items():
        found, want = catalog.QUERIES[name](spark, SF), con.sql(sql)
        assert sorted(map(tuple, found.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
