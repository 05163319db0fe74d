"""SuperMinHash near copies against all pairs, and the signatures against the plain algorithm."""

import random
import re

import numpy as np
import pytest

from cairn.llm import minhash_dedup
from cairn.llm._words import mix

DOCS = "doc_id long, text string, key string, n int, bands string, comp string, kept int"


def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {(w[0],)} if len(w) == 1 else set(zip(w, w[1:], strict=False))


def by_all_pairs(docs):
    """``(id, size, component, kept)`` of each row, by comparing all pairs."""
    sets = [runs(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        low = min(ids) if ids and sets[i] else doc
        out.append((doc, len(sets[i]), low, doc == low))
    return sorted(out, key=repr)


def found(spark, docs, **how):
    rows = [(i, t, "k", 1, "b", "c", 0) for i, t in docs]
    got = minhash_dedup.groups(spark.createDataFrame(rows, DOCS), **how).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)


def edited(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{rng.randint(0, 10**9)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    docs = [" ".join(text(rng.randint(1, 200))) for _ in range(60)]
    for size in (20, 60, 150):  # chains: neighbours are near, ends are not
        held = text(size)
        for _ in range(12):
            held = edited(rng, held, max(1, size // 25))
            docs.append(" ".join(held))
    base = text(120)
    docs += [" ".join(edited(rng, base, rng.choice([1, 2, 3, 8, 12]))) for _ in range(70)]  # a large bucket, not all within reach of one leader
    docs += [docs[3]] * 5 + [docs[4].upper(), "  " + docs[4] + "\n", "one", "ONE", "one two", "two one", "", None, " \t\n ", "🙂 🙂 🙂", "the " * 50_000, "the " * 50_001]
    rng.shuffle(docs)
    return [(7 * k - 40, t) for k, t in enumerate(docs)]


def test_components_equal_all_pairs(spark, corpus):
    docs = corpus + [(None, corpus[0][1]), (None, "only here, without an id"), (None, None), (-40, "one id with another text"), corpus[1], corpus[1]]
    assert found(spark, docs) == by_all_pairs(docs)


def test_hot_sets_are_salted_and_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr("cairn.llm._store.HOT_ROWS", 4)
    monkeypatch.setattr(minhash_dedup, "PER_SALT", 3)
    assert found(spark, corpus) == by_all_pairs(corpus)


def test_buckets_of_unlike_members(spark):
    """Bands of one place: nearly all texts share buckets, so most of each bucket is left after its leader."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(edited(rng, base, rng.choice([2, 6, 10, 14])))) for k in range(80)]
    assert found(spark, docs, bands=30, band_rows=1) == by_all_pairs(docs)


def test_empty_table_and_table_without_words(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, ""), (2, None), (None, " ")]) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=repr)


def plainly(elements, places):
    """The algorithm element by element, with a whole permutation each."""
    h = [None] * places
    for e in elements:
        order = list(range(places))
        for j in range(places):
            drawn = int(mix(np.array([e], np.uint64), j + 1)[0])
            k = j + ((drawn & 0xFFFFFFFF) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            offer = j << 32 | drawn >> 32
            h[order[j]] = offer if h[order[j]] is None else min(h[order[j]], offer)
    return h


def test_signatures_equal_the_plain_algorithm(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "WALKING", 100)
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 5, 0, 40, 70, 300, 3]
    elements = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = minhash_dedup.signatures(elements, bounds, 33)
    for k, size in enumerate(sizes):
        want = plainly(elements[bounds[k] : bounds[k + 1]].tolist(), 33) if size else [int(minhash_dedup.EMPTY)] * 33
        assert got[k].tolist() == want


def test_signatures_estimate_similarity():
    """Unbiased, and less spread than independent hashes would be on small sets."""
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
        one, two = minhash_dedup.signatures(np.concatenate([pool[:20], pool[5:]]), np.array([0, 20, 40]), 64)
        errors.append((one == two).mean() - 15 / 25)
    independent = (0.6 * 0.4 / 64) ** 0.5
    assert abs(np.mean(errors)) < 3 * independent / 300**0.5 and np.std(errors) < 0.9 * independent
