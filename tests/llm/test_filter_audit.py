"""The filter audit against a simulation of every order, document by document."""

import random
import re
from itertools import permutations

from cairn.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, hash string, A int, good string, copies int"


def simulated(docs, labels):
    """``(part, order, step)`` to the counts, by walking the documents through each order."""
    texts = [(i, t or "", s or "") for i, t, s in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        return out | ({"E"} if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts) else set())

    known = [(i, s, fails(i, t)) for i, t, s in texts]
    out, total = {}, {}
    for part in {s for _, s, _ in known}:
        own = [(i, f) for i, s, f in known if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                total[part, name] = total.get((part, name), 0) + len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels):
    rows = [(*d, "p", "h", 1, "g", 2) for d in docs]
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}, len(got)


def test_every_order_equals_its_simulation(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["one", "Two", "THREE", "four", "five$", "été", "ü", "seven"])
    plain = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    texts = [" ".join(word() for _ in range(rng.choice([3, 30, 250]))) for _ in range(30)] + [plain(n) for n in (199, 200, 201, 250, 260)]
    texts += [plain(205) + " A" * rng.randint(10, 60) for _ in range(5)] + ["", None, " \t\n", "\x1f  ", "x " * 100_000]
    docs = [(k, t, rng.choice(["a", "b", "", None])) for k, t in enumerate(texts)]
    docs += [(100 + k, rng.choice(texts), rng.choice(["a", "c"])) for k in range(40)]
    # repeated rows, an id with two texts, ids that are null, many copies
    docs += [docs[0], docs[0], (5, "another", "a"), (None, texts[1], "b"), (None, texts[1], "b"), (-7, texts[2], "c")] + [(1000 + k, "same $ text", "hot") for k in range(60)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(120)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    got, rows = found(spark, docs, labels)
    want = simulated(docs, labels)
    assert got == want and rows == len(want) == 600 * 5
    assert all(v[0] + v[1] <= sum((d[2] or "") == k[0] for d in docs) for k, v in got.items())


def test_hot_text_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr("cairn.llm._store.HOT_ROWS", 3)
    docs = [(k, "the same" if k % 3 else f"text {k}", "s") for k in range(40)]
    got, _ = found(spark, docs, [])
    assert got == simulated(docs, [])


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 1)]) == ({}, 0)
    got, rows = found(spark, [(1, "a", None)], [])
    assert rows == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
