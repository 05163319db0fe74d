"""Searches for many queries: bounded pieces, one pass, queries of the same words as one."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import bm25, scoring, text_index, vectors, wiki


def test_blocks_of_vectors_are_one_pass(spark):
    rng = random.Random(3)
    vector = lambda: [rng.random() for _ in range(4)]
    chunks = spark.createDataFrame([(n, vector()) for n in range(60)], "key long, vector array<float>")
    asked = spark.createDataFrame([(n, vector()) for n in range(40)], "query_id long, vector array<float>")
    found = vectors.search(chunks, asked, 5, most=8)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert set(found.collect()) == set(vectors.search(chunks, asked, 5).collect())


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_pieces_of_documents(monkeypatch, most):
    monkeypatch.setattr(scoring, "MOST_PAIRS", most)
    rng = np.random.default_rng(5)
    bags = [[(int(t), float(rng.integers(1, 4))) for t in rng.choice(12, 4, False)] for _ in range(9)]
    block = scoring.Weights.of(pa.array(range(100, 109)), bags, [f"t{n}" for n in range(12)], np.arange(9) % 2)
    matrix = rng.integers(0, 3, (70, 12)).astype(float)
    best, every = scoring.Best(block, 3), scoring.Best(block, None)
    pairs = []
    for low in range(0, 70, 20):
        here = matrix[low : low + 20]
        document, term = np.nonzero(here)
        keys = pa.array([f"k{n:02d}" for n in range(low, low + len(here))])
        seen = {s: np.arange(low, low + len(here)) % 3 != s for s in (0, 1)}
        assert not list(best.add(keys, document, term, here[document, term], seen))
        pairs += [r for b in every.add(keys, document, term, here[document, term], seen) for r in b.to_pylist()]
    want = []
    for q, bag in enumerate(bags):
        scores = [(-sum(matrix[d, t] * w for t, w in bag), f"k{d:02d}", 100 + q) for d in range(70) if d % 3 != q % 2]
        want.append(sorted(s for s in scores if s[0] < 0))
    rows = lambda found: sorted((-r["score"], r["key"], r["query_id"]) for r in found)
    assert rows(pairs) == sorted(s for x in want for s in x)
    assert rows(r for b in best.rest() for r in b.to_pylist()) == sorted(s for x in want for s in x[:3])


def test_queries_of_the_same_words(spark):
    words = "alpha beta gamma delta epsilon zeta".split()
    rng = random.Random(9)
    docs = spark.createDataFrame([(n, " ".join(rng.choices(words, k=rng.randint(1, 9))), [n % 3]) for n in range(80)], "doc_id long, text string, scopes array<long>").repartition(4)
    texts = ["alpha beta", "beta alpha", "gamma", "zeta alpha alpha"]
    asked = spark.createDataFrame([(n, texts[n % 4], n % 3) for n in range(48)], "query_id long, query string, scope long")
    one, members = bm25.bags(asked, False)
    assert one.count() == 3 and members.count() == 48
    rows = lambda found: {(r.query_id, r.key, round(r.score, 9), r["rank"]) for r in found.collect()}
    every = asked.crossJoin(docs.select(F.col("doc_id").alias("key"))).select("query_id", "key", "scope")
    apart = rows(bm25.search(docs, asked, 5, allowed=every))
    assert rows(bm25.search(docs, asked, 5)) == apart and {q for q, *_ in apart} == set(range(48))
    scoped = bm25.search(docs, asked, 5, scoped=True)
    assert rows(scoped) == rows(bm25.search(docs, asked, 5, allowed=every.filter("key % 3 = scope")))
    kept = docs.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("owner"), F.lit("kb").alias("kb_id"), "text")
    assert rows(text_index.search(text_index.rows_of(kept, 16, 1), asked, 5)) == apart


def test_postings_and_terms_leave_documents_counted(spark):
    texts = ["one two two", "", "two three", None, "规定 规定"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = bm25.tokenized(docs)
    found = bm25.postings(tokens)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(r.key, r.dl, t, n) for r in tokens.collect() for t, n in Counter(r.tokens).items()}
    assert {(r.key, r.dl, r.term, r.tf) for r in found.collect()} == want
    counted = {(r.term, r.occurrences, r.df) for r in bm25.terms(tokens).collect()}
    assert counted == {(t, sum(w[3] for w in want if w[2] == t), sum(w[2] == t for w in want)) for t in {w[2] for w in want}}


def test_source_pages_read_chunks_once(spark):
    docs = spark.createDataFrame([(n, "kb", f"t{n}", f"{n}.md", "Body of a page. " * n, "document") for n in range(3)], "doc_id long, kb_id string, title string, source_path string, text string, doc_type string")
    chunks = spark.createDataFrame([(1, n, f"chunk {n}") for n in range(10)] + [(2, 9, "late")], "doc_id long, chunk_index int, text string")
    pages = wiki.source_pages(docs, chunks)
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    found = {r.doc_id: (r.key_passages, r.chunk_count) for r in pages.collect()}
    assert found == {0: (None, 0), 1: ([f"chunk {n}" for n in range(8)], 10), 2: (None, 1)}


def test_texts_are_split_alike_in_tasks(spark):
    texts = ["", None, "One two TWO _ 1 22 a1", "É à_1 ¼ ½½ x² ª µ ß ÿ Ÿ", "İstanbul I ı", "Ωμέγα ΣΑΣ", "规定 leave 年假a", "naïve café\nＡＢＣ", "soft­hyphen a×b", "𝒜𝒷 😀 a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    rows = lambda found: sorted((r.key, r.dl, r.term, r.tf) for r in found.collect())
    assert rows(bm25.text_postings(docs)) == rows(bm25.postings(bm25.tokenized(docs, "key")))


def test_postings_are_written_where_texts_are_read(spark, tmp_path):
    from cairn.sources import sinks

    texts = spark.createDataFrame([(n, n, f"kb{n % 2}", " ".join(f"w{(n * k) % 9}" for k in range(n))) for n in range(40)], "key long, owner long, kb_id string, text string").repartition(4)
    index = text_index.rows_of(texts, 16, 1)
    tables = text_index.laid_out(index)
    plan = tables["postings"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Repartition" not in plan.split("MapInArrow")[0]
    assert isinstance(tables["terms"], sinks.Derived) and isinstance(tables["stats"], sinks.Derived)
    at = {f"{tmp_path}/store/{name}": rows for name, rows in tables.items()}
    sinks.publish(at, {f"{tmp_path}/store/{name}": parts for name, parts in text_index.PARTITIONS.items()})
    for name in text_index.NAMES:
        assert sorted(map(str, sinks.read(spark, f"{tmp_path}/store/{name}").select(*getattr(index, name).columns).collect())) == sorted(map(str, getattr(index, name).collect())), name
    gone = texts.filter("key % 4 = 0")
    change = text_index.change(texts.filter("key % 4 = 1"), gone, gone, 16, 2)
    sinks.publish({}, add={f"{tmp_path}/store/{name}": rows for name, rows in text_index.laid_out(change).items()})
    summed = sinks.read(spark, f"{tmp_path}/store/stats").groupBy("kb_id").agg(F.sum("n").alias("n")).collect()
    assert {r.kb_id: r.n for r in summed} == {"kb0": 10, "kb1": 30}
