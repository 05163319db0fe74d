"""Ranked search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import numpy as np

from cairn.llm import lexical_search

DOCS = "doc_id long, text string, item_id long, rank int, score string, ids int, terms string"
ITEMS = "item_id long, text string, doc_id long, score int, number int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly(docs, items, k=20):
    """``(item, rank, id, score)`` by the definition."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            scores += [(score, i)] if score > 0 else []
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, parts=7, **how):
    table = spark.createDataFrame([(i, t, 1, 2, "s", 3, "t") for i, t in docs], DOCS).repartition(parts)
    asked = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], ITEMS)
    blocks = {"block_bytes": how.pop("block_bytes")} if "block_bytes" in how else {}
    got = lexical_search.search(lexical_search.build(table, **how), asked, k, **blocks).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "delta1", "épsilon", "zeta_eta", "theta-iota", "中文", "a", "the", "the", "the", str(rng.randint(0, 50))])
    texts = [" ".join(word() for _ in range(rng.choice([1, 5, 40, 200]))) for _ in range(n)]
    texts += [texts[0]] * 30 + ["", None, "--- !!", "the " * 40_000, "alpha\x00beta\tgamma"]
    return [(3 * k - 20, t) for k, t in enumerate(texts)]


def test_hits_equal_the_definition(spark):
    docs = corpus() + [(None, "alpha alpha"), (None, "alpha alpha"), (-20, "another text of one id alpha"), (5, "alpha alpha"), (4, "alpha alpha")]
    items = [(1, "Alpha the THE beta"), (2, "nothing-known xyzzy"), (3, None), (4, ""), (5, docs[0][1]), (5, docs[0][1]), (None, "中文 delta1"), (6, "theta iota iota iota"), (7, "alpha")]
    assert found(spark, docs, items) == plainly(docs, items)
    # small shards and one item a pass
    assert found(spark, docs, items, k=3, shard_bytes=500, block_bytes=10) == plainly(docs, items, 3)


def test_ties_are_settled_by_id_across_shards(spark):
    docs = [(k, "same words here") for k in range(400)] + [(1000, "same words here and more")]
    items = [(1, "words same")]
    got = found(spark, docs, items, parts=9, shard_bytes=300)
    assert got == plainly(docs, items)
    assert sorted(r[2] for r in got) == list(range(20))


def test_few_rows(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, ""), (2, None)], [(1, "a")]) == []
    assert found(spark, [(1, "a b")], [(1, "b c")]) == plainly([(1, "a b")], [(1, "b c")])


def test_selection_keeps_ties():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = rng.integers(1, 60), int(rng.integers(1, 25))
        score, ids, null = rng.integers(1, 6, n), rng.permutation(100)[:n], rng.random(n) < 0.1
        want = sorted(range(n), key=lambda i: (-score[i], null[i], ids[i]))[:k]
        assert lexical_search.best(score, ids, null, k).tolist() == want
