"""The corpus operators against brute force, round trips and their defined cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import _store, decontaminate, fingerprint, jaccard_join, line_dedup, packing, secret_scan, sharding, toxicity, training_order, warc
from cairn.llm._tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, rank int, own string, key string, n int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1, "o", "k", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["th", "on", "er", "ea", "ti", "é", "ß", "in"], k=rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(line(rng.randint(0, 25)) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    shared = "  This line is long enough and recurs in very many documents\t"
    texts = [t + "\n" + shared.upper() if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[5]] * 4 + ["", None, " \t\n ", "one two", "🙂 " * 30, "the " * 30_000]
    near = line(120).split(" ")
    texts += [" ".join([*near[:k], "changed", *near[k + 1 :]]) for k in (10, 40, 41, 80)]
    return texts


# --- fingerprints


def test_fingerprints(spark, corpus):
    ids = [7 * i - 50 for i in range(len(corpus))]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(docs(spark, corpus, ids), block_bytes=20_000).collect()}
    assert len(got) == len(corpus)
    texts = [t or "" for t in corpus]
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        following, half = texts[k - 1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = (fingerprint.chunk_set(x) for x in (t, edited, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.as_hex(a), fingerprint.as_hex(b))
        assert (r.near_edited, r.near_next) == (fingerprint.containment(a, b), fingerprint.containment(a, c))
    assert (fingerprint.from_hex(got[ids[0]].fingerprint) == fingerprint.chunk_set(texts[0])).all()


def plain_set(text):
    """The chunks' lengths and digests, byte by byte."""
    data, ends, h, start = text.encode("utf-8"), [], 0, 0
    for at, byte in enumerate(data, 1):
        h = ((h << 1) + int(fingerprint.GEAR[byte])) & 0xFFFFFFFF
        length = at - start
        loose, strict = not h >> 28, not h >> 26
        if (length >= 32 and loose) or (length >= 12 and strict) or length == 128:
            ends.append(at)
            start = at
    if start < len(data):
        ends.append(len(data))
    return {(xxhash.xxh3_64_intdigest(data[a:b]) >> 16, b - a) for a, b in zip([0, *ends], ends, strict=False)}


def test_fingerprints_equal_a_plain_gear_loop(corpus):
    rng = random.Random(13)
    texts = [t or "" for t in corpus] + ["".join(rng.choices("abé🙂 \n", k=n)) for n in (0, 1, 11, 12, 13, 31, 32, 33, 127, 128, 129, 5000)] + ["a" * 1000]
    for one, other in zip(texts, texts[1:] + texts[:1], strict=True):
        a, b = plain_set(one), plain_set(other)
        assert {(int(x) >> 16, int(x) & 0xFFFF) for x in fingerprint.chunk_set(one)} == a
        want = sum(n for d, n in a & b) / sum(n for _, n in a) if a else float(not b)
        assert fingerprint.containment(fingerprint.chunk_set(one), fingerprint.chunk_set(other)) == pytest.approx(want)


def test_chunks_follow_content():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefgh ", k=5000))
    ends = fingerprint.boundaries(text.encode())
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= fingerprint.GREATEST and sizes[:-1].min() >= fingerprint.LEAST
    assert fingerprint.containment(fingerprint.chunk_set(text), fingerprint.chunk_set("shifted by some words " + text)) > 0.95
    assert fingerprint.containment(fingerprint.chunk_set(""), fingerprint.chunk_set("")) == 1.0
    assert fingerprint.containment(fingerprint.chunk_set(""), fingerprint.chunk_set("a")) == 0.0


def test_fingerprints_of_few_rows(spark):
    assert fingerprint.edited_pairs(docs(spark, ["a"]).limit(0)).count() == 0
    (row,) = fingerprint.edited_pairs(docs(spark, ["abcdef"])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fingerprint.edited_pairs(docs(spark, ["a", "b", "c"], [1, 1, None])).count() == 3


# --- sharding


def test_sharding_is_even_and_whole(spark, corpus):
    got = sharding.shard(docs(spark, corpus), 8).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(corpus))) and {r.law for r in got} == {"bytes"}
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 1 for t in corpus)
    assert max(size.values()) - min(size.values()) <= 2 * largest


@pytest.mark.parametrize("parts", (64 << 20, 5_000))
def test_splitters_are_those_of_the_sorted_sizes(spark, corpus, parts):
    texts = corpus + ["copy " * 30] * 60
    ids = [None if k % 40 == 7 else 3 * k for k in range(len(texts))]
    got = sharding.shard(docs(spark, texts, ids), 8, part_bytes=parts).withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    rows = sorted(got, key=lambda r: (r.h, -(2**63) if r.doc_id is None else r.doc_id))
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)  # shards are stretches of the order
    for own in range(8):
        assert [r.slot for r in rows if r.shard == own] == list(range(sum(r.shard == own for r in rows)))
    sizes = [len((r.text or "").encode()) + 1 for r in rows]
    total, upto = sum(sizes), np.cumsum(sizes)
    for t in range(1, 8):
        last = sum(r.shard < t for r in rows)  # rows below the splitter
        below, target = (int(upto[last - 1]) if last else 0), total * t / 8
        nearest = min((abs(x - target) for x in [0, *upto.tolist()]))
        # within tolerance, or as near as rows, of which equal ones stay together, can be
        assert abs(below - target) <= max(0.0005 * total / 8, nearest) + max(sizes)


def test_a_group_of_copies_is_split(spark):
    got = sharding.shard(docs(spark, ["copy " * 50] * 400 + [f"text {i} " * 20 for i in range(400)]), 16).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    sizes = [r.bytes for r in got]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 300


def test_sharding_edges(spark):
    assert sharding.shard(docs(spark, ["a"]).limit(0)).count() == 0
    assert sharding.shard(docs(spark, ["a", "a", None, None], [3, 3, None, None]), 4).count() == 4


# --- line dedup


def thinned(texts):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    held = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(spark, corpus):
    long = "\n".join(["a line that is repeated within one document only, many times"] * 200 + [str(i) for i in range(200)])
    texts = [*corpus, long]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    want = thinned(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[2] for w in want) > 30
    assert line_dedup.dedup_lines(docs(spark, texts)).columns[:2] == ["doc_id", "text"] and "rank" in line_dedup.dedup_lines(docs(spark, texts)).columns


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, ["a"]).limit(0)).count() == 0
    line = "x" * 45
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [f"{line}\n{i}" for i in range(70)])).collect()}
    assert rows[69] == f"{line}\n69" and all(rows[i] == str(i) for i in range(69))


def test_line_dedup_counts_ids_once(spark):
    line = "a line that is shared by rows of few ids, and long enough"
    rows = lambda ids: {r.text for r in line_dedup.dedup_lines(docs(spark, [f"{line}\n{i}" for i in range(len(ids))], ids)).collect()}
    assert rows([1, 1, 1, 2, 2, None, None]) == {f"{line}\n{i}" for i in range(7)}
    assert rows([1, 1, 2, 3, 4, 5]) == {"0", "1", "2", "3", "4", f"{line}\n5"}


# --- tokens and packing


def test_tokens_are_the_tokenizers_own():
    encoder = Encoder(packing.tokenizer_path())
    rng = random.Random(2)
    parts = ["a", "s", "re", "ll", "'", " ", "  ", "\n", "\t", "1", ",", "é", "ß", "中", "한", "😀", "́", "<|endoftext|>", "'s", "I'm", "　", "½", "\x1c", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + ["x" * 300_000]
    got = [ids[b[i] : b[i + 1]].tolist() for ids, b in encoder.encode(texts) for i in range(len(b) - 1)]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, corpus):
    got = packing.pack_documents(docs(spark, corpus), capacity=64).collect()
    encoder = Encoder(packing.tokenizer_path())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(corpus):
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *[r.length for r in rows[:-1]]]).tolist() and sum(r.length for r in rows) <= 64
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 64) * 1.02 + 1
    assert packing.pack_documents(docs(spark, ["a"]).limit(0)).count() == 0
    assert packing.pack_documents(docs(spark, ["a"] * 6, [1, 1, 1, None, None, 2]), 8).count() == 6


def one_by_one(lengths, capacity):
    """Sequences opened by the rounds of best fit, document by document; and by best-fit decreasing."""
    left, gaps, used = sorted(lengths, reverse=True), [], 0
    while left:
        beyond = [x for x in left if x > max(gaps, default=0)]
        if beyond:
            opened = max(-(-sum(beyond) // capacity), sum(2 * x > capacity for x in beyond))
            gaps += [capacity] * opened
            used += opened
        free, fresh, rest = sorted(gaps), [], []
        for x in left:
            fits = [g for g in free if g >= x] if 2 * x >= left[0] or 16 * left[0] <= capacity else []
            if fits:
                free.remove(min(fits))
                fresh.append(min(fits) - x)
            else:
                rest.append(x)
        left, gaps = rest, free + fresh
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
        gaps.append(min(fits, default=capacity) - x)
    return used, len(gaps)


@pytest.mark.parametrize("seed", (0, 2))
def test_rounds_are_best_fit(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, (50, 50, 20, 6)[seed]) for _ in range((120, 40, 200, 150)[seed])] + [50] * seed
    counts = collections.Counter(lengths)
    placed, used = packing.plan(spark.createDataFrame(list(counts.items()), "length int, n long"), 50)
    spans = collections.defaultdict(list)
    for length, lo, some, last, at in placed.collect():
        counts.subtract({length: some})
        for i in range(some):
            spans[last - i].append((at, length))
    assert not any(counts.values()) and set(spans) == set(range(used))
    for own in spans.values():
        own.sort()
        assert [at for at, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 50
    rounds, decreasing = one_by_one(lengths, 50)
    assert used == rounds <= decreasing + 1
    ranks = collections.defaultdict(list)
    for r in placed.collect():
        ranks[r.length] += range(r.lo, r.lo + r.some)
    assert all(sorted(own) == list(range(len(own))) for own in ranks.values())


# --- decontamination


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, score string")


def test_retrieval_equals_brute_force(corpus):
    rng = random.Random(6)
    pool = [w for t in corpus if t and len(t) < 5000 for w in t.split()]
    tests = [(i, " ".join(rng.choices(pool, k=rng.randint(10, 30)))) for i in range(40)]
    how = decontaminate.Search(least_score=0.3)
    lists = decontaminate._term_lists([t for _, t in tests])
    df = collections.Counter(t for own in lists for t in set(own.tolist()))
    index = decontaminate.build(tests, how, df, len(tests), float(np.mean([len(x) for x in lists])))
    texts = [t or "" for t in corpus] + ["noise " * 20 + tests[3][1] + " noise" * 20]
    weights = collections.defaultdict(dict)
    for t, a, b in zip(index.terms.tolist(), index.starts, index.starts[1:], strict=False):
        for i, w in zip(index.items[a:b].tolist(), index.impacts[a:b].tolist(), strict=True):
            weights[i][t] = w
    for found in decontaminate.words(pa.array(texts), decontaminate.ALNUM):
        got = {(d, w, i): s for d, w, i, s in zip(*(x.tolist() for x in decontaminate.retrieve(found, index, how)), strict=True)}
        want = {}
        for d in range(len(found)):
            a, b = found.bounds[d], found.bounds[d + 1]
            for w in range(a, max(a + 1, b - index.window + index.stride), index.stride) if b > a else []:
                query = set(found.hashes[w : min(b, w + index.window)].tolist())
                for i, own in weights.items():
                    score = sum(own[t] for t in query & own.keys())
                    if score >= how.least_score:
                        want[d, w, i] = score
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_leaks(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    tests = [words(20) for _ in range(10)] + [words(200), None, "", "too short"]
    clean = [words(150) for _ in range(30)]
    edited = tests[2].split()
    edited[4] = "other"
    rows = [*clean, clean[0] + " " + tests[0].upper() + ".", clean[1] + " " + " ".join(edited), words(10) + " " + tests[10], " ".join(tests[5].split()[:9]) + " " + clean[3], None, ""]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), items(spark, tests)).collect()}
    assert got == {(30, 0), (31, 2), (32, 10)}
    nameless = items(spark, tests).withColumn("item_id", F.when(F.col("item_id") != 1, F.col("item_id")))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), nameless).collect()} == got - {(31, 1)} | {(31, 2)}
    again = decontaminate.leaks(docs(spark, [rows[30], rows[30], rows[0]], [None, None, 7]), items(spark, tests)).collect()
    assert [(r.doc_id, r.item_id) for r in again] == [(None, 0)] * 2
    assert decontaminate.without_leaks(docs(spark, [rows[30], rows[30], rows[0]], [None, None, 7]), items(spark, tests)).count() == 1
    small = decontaminate.Search(group_bytes=300)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), items(spark, tests), small).collect()} == got
    kept = decontaminate.without_leaks(docs(spark, rows), items(spark, tests))
    assert {r.doc_id for r in kept.collect()} == set(range(len(rows))) - {30, 31, 32} and kept.columns == docs(spark, rows).columns
    assert decontaminate.leaks(docs(spark, rows), items(spark, tests).limit(0)).count() == 0
    assert decontaminate.leaks(docs(spark, rows).limit(0), items(spark, tests)).count() == 0


def test_short_and_unspaced_items(spark):
    question = "水的沸点在标准大气压下是多少度？答案是一百摄氏度。"
    tests = ["What is two plus two", "你好世界", question, "Yes", "", "..."]
    rows = ["before WHAT is, two plus two? after", "what is two plus", "two", "他说你好世界吗", "你好，世界", f"前文甲乙丙{question}后文丁戊己", "yesterday", "what is two", "plus two", "on, yes.", "水的沸点"]
    found = decontaminate.leaks(docs(spark, rows), items(spark, tests)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (3, 1), (5, 2), (9, 3)} and len(found) == 4
    assert {r.item_id: r.score is None for r in found} == {0: True, 1: True, 2: False, 3: True}


def test_a_common_short_item_drops_nothing(spark):
    rows = [f"Paris is document {k}" for k in range(50)] + ["something else", "before What is two plus two? after", None]
    tests = items(spark, ["Paris", "What is two plus two", "document 7"])
    found = decontaminate.leaks(docs(spark, rows), tests).collect()
    assert sum(r.item_id == 0 for r in found) == 50
    bits = {r.item_id: r.content for r in found}
    assert bits[0] == pytest.approx(np.log2(54 / 50)) and bits[1] == pytest.approx(np.log2(54) + 16) and bits[2] == pytest.approx(np.log2(54) + 4)
    kept = [r.doc_id for r in decontaminate.without_leaks(docs(spark, rows), tests).collect()]
    assert sorted(kept) == [k for k in range(53) if k != 51]


# --- WARC


def test_warc(spark):
    big = "<p>é" + "payload " * 200
    rows = [(1, "http://a/b c\r\nX: y", big), (2, None, big), (5, "http://x", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", big + "z"), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 100 + "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    held = warc.chunk_table(pages, 1 << 12)
    assert max(len(r.data) for r in held.collect()) <= 1 << 12
    manifest = warc.write_archives(held, warc.plan_records(held))
    table = warc.read_archives(manifest, 1 << 12).collect()
    by = collections.defaultdict(list)
    number = lambda name: int(name.split(":")[2] or -1)
    for r in table:
        by[number(r.record_id)].append(r)
    for page_id, _, html in rows:
        own = sorted(by[-1 if page_id is None else page_id], key=lambda r: r.chunk)
        raw = (html or "").encode()
        assert own[-1].last and own[-1].payload_bytes == len(raw) and own[-1].payload_digest == hashlib.sha1(raw).hexdigest()
        assert own[0].record_type == ("revisit" if page_id in (1, 2) else "response")
        if own[0].record_type == "response":
            assert b"".join(r.data for r in own) == raw and max(len(r.data) for r in own) <= 1 << 12
        else:
            assert own[0].refers_to == by[5][0].record_id
    assert by[1][0].target == "http://a/b%20c%0D%0AX:%20y" and by[2][0].target == "urn:page:2"
    empty = warc.chunk_table(pages.limit(0))
    assert warc.read_archives(warc.write_archives(empty, warc.plan_records(empty))).count() == 0


def archived(spark, rows, least=1000):
    held = warc.chunk_table(spark.createDataFrame(rows, "page_id long, url string, html string"), 256)
    return [r for r in warc.read_archives(warc.write_archives(held, warc.plan_records(held, least)), 256).collect() if r.last]


def test_warc_of_repeated_and_missing_ids(spark, monkeypatch):
    big = "shared payload " * 100
    rows = [(1, "u", big), (1, "u", big), (1, "u", "other " * 300), (None, "u", big), (None, "u", big), (None, None, None), (1, "u", "")]
    for hot in (1_000, 1):
        monkeypatch.setattr(_store, "HOT_ROWS", hot)
        ends = archived(spark, rows)
        assert len({r.record_id for r in ends}) == len(rows) == len(ends)
        assert collections.Counter((r.record_type, r.refers_to and r.refers_to.split(":")[2], r.payload_bytes) for r in ends) == collections.Counter(
            [("response", None, 1500), ("response", None, 1500), ("response", None, 1800), ("revisit", "1", 1500), ("revisit", "1", 1500), ("response", None, 0), ("response", None, 0)]
        )


# --- secrets


def test_secrets(spark):
    aws, key = "AKIA" + "A1B2C3D4E5F6G7H8", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = [
        "héllo PassWord = \"abcdefghijkl\" token=token: abcdefghijklmnop " + "deadbeef" * 2, f"{aws} then {key}", key, f"{key}{' .' * 400}https://db.example.com/x", f"https://db.example.com/x {key}",
        "AKIASHORT123 alone", None, "", "api_key: 'short' secret==================x", "é" * 50 + " apikey:abcdefabcdefabcdef",
    ]
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, texts)).collect()}
    patterns = [(re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 12), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns) for m in p.finditer(t or "") if ok(m))
        assert [tuple(s) for s in got[i].base] == want
    named = lambda i: {(secret_scan.KINDS[s.kind], texts[i][s.start : s.end]) for s in got[i]["all"]}
    assert ("weak_secret", key) in named(1) and ("access", aws) in named(1)
    assert named(2) == set() and named(3) == set() and named(5) == set()
    assert named(4) == {("weak_secret", key), ("endpoint", "https://db.example.com/x")}
    assert secret_scan.scan(docs(spark, ["a"]).limit(0)).count() == 0
    assert secret_scan.scan(docs(spark, [f"{aws} {key}"] * 3, [1, 1, None])).count() == 3


def test_many_matches(spark):
    text = " ".join(f"{i % 7:x}" * 16 + ("é" if i % 3 else " token: abcdefghijklmn") for i in range(900))
    (row,) = secret_scan.scan(docs(spark, [text])).collect()
    assert [(s.start, s.end) for s in row.base if s.kind == 2] == [m.span() for m in re.finditer("[0-9a-f]{16,}", text)]
    assert [(s.start, s.end) for s in row.base if s.kind == 0] == [m.span() for m in re.finditer("token: [a-z]+", text)]


def test_time_is_linear_in_the_matches(spark):
    url = "https://db.example.com/Path/To/Article2024Index"
    took = {}
    for n in (200, 20_000):
        table = docs(spark, ["\n".join(f"{url}{i} {i % 7:x}{'deadbeef' * 2} AKIA{'Q' * 14}{i:06d}" for i in range(n // 3))])
        began = time.perf_counter()
        (row,) = secret_scan.scan(table).collect()
        took[n] = time.perf_counter() - began
        assert len(row.base) > n // 2
    assert took[20_000] < took[200] + 3


def test_an_address_alone_is_no_credential(spark):
    texts = ["see https://example.com/Path/To/Article2024Index for more", "https://host.io/Repo/MyProject12/Readme", "https://example.com/Path/To/Article2024Index https://example.com/Path/To/Article2025Index", f"https://db.example.com/x {'aB3' * 8}"]
    got = {r.doc_id: [secret_scan.KINDS[x.kind] for x in r["all"]] for r in secret_scan.scan(docs(spark, texts)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["endpoint", "weak_secret"]}


def nearby(spans, scope):
    """Weak parts with a complementary part of other text within ``scope``, pair by pair; not those that overlap an endpoint."""
    role = lambda s: secret_scan.ROLES[secret_scan.KINDS[s[1]]]
    gap = lambda s, t: max(s[0] - t[2], t[0] - s[2])
    own = [s for s in spans if s[1] not in (3, 4) or not any(t[1] == 5 and gap(s, t) < 0 for t in spans)]
    return sorted(s for s in own if s[1] >= 3 and any(role(s) != role(t) and 0 <= gap(s, t) <= scope for t in own))


def test_links_equal_all_pairs(spark):
    rng = random.Random(21)
    parts = ["ASIA" + "Q1W2E3R4T5", "aB3" * 8, "https://db.example.com/x", "AKIA" + "Z9Y8X7W6V5U4T3", "deadbeef" * 3, "word", "secret=abcdefghijklmnop"]
    parts += ["https://example.com/Path/To/Article2024Index", "secret=Abcdefghijklmnopqrst12", "x/Zz9/Zz9/Zz9/Zz9/Zz9/https://h.io/abcd", "AKIA" + "aB3" * 9]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " . " * rng.randint(1, 40)]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    weak = [("weak_access", secret_scan.WEAK_ACCESS), ("weak_secret", secret_scan.WEAK_SECRET), ("endpoint", secret_scan.ENDPOINT)]
    found = 0
    for r in secret_scan.scan(docs(spark, texts), 60).collect():
        base = [tuple(s) for s in r.base]
        every = base + [(m.start(), secret_scan.KINDS.index(k), m.end()) for k, p in weak for m in re.finditer(p, texts[r.doc_id])]
        assert sorted(tuple(s) for s in r["all"]) == sorted(base + nearby(every, 60))
        found += len(r["all"]) - len(base)
    assert found > 40


def test_long_weak_parts_are_linked(spark):
    key, access, url = "aB3" * 60, "ASIA" + "A1B2C3D4" * 6, "https://db.example.com/x"
    whole = "Zz9/" * 5000
    got = {r.doc_id: r["all"] for r in secret_scan.scan(docs(spark, [f"{url} {access} {key}", f"{whole} {url}", key])).collect()}
    found = lambda i, t: {(secret_scan.KINDS[s.kind], t[s.start : s.end]) for s in got[i]}
    assert found(0, f"{url} {access} {key}") >= {("weak_access", access), ("weak_secret", key), ("endpoint", url)}
    assert ("weak_secret", whole) in found(1, f"{whole} {url}") and not got[2]


# --- training order


def shards(spark, rows, **how):
    manifest, held = training_order.write_shards(training_order.encoded(rows), 64, **how)
    read = {slot: own.tolist() for r in manifest.collect() for slot, own in training_order.read_shard(r.path)}
    return manifest, held, read


def test_training_order(spark, corpus):
    """Against one long stream, cut and permuted by hand; the same for any partitioning."""
    ids = [(7 * i) % len(corpus) for i in range(len(corpus))]
    manifest, held, read = shards(spark, docs(spark, corpus, ids).repartition(3), shard_rows=50, seed=5, waves=3)
    tokenizer = Encoder(packing.tokenizer_path()).tokenizer
    stream, owners = [], []
    for i in sorted(ids):
        own = [*tokenizer.encode(corpus[ids.index(i)] or "", add_special_tokens=False).ids, 2]
        stream += own
        owners += [i] * len(own)
    count = -(-len(stream) // 64)
    slots = training_order.permuted(np.arange(count), count, 5).tolist()
    assert read == {s: stream[64 * n : 64 * n + 64] for n, s in enumerate(slots)}
    got = collections.defaultdict(list)
    for r in held.orderBy("slot", "from").collect():
        got[r.slot].append(r.doc_id)
    assert got == {s: list(dict.fromkeys(owners[64 * n : 64 * n + 64])) for n, s in enumerate(slots)}
    first = manifest.orderBy("shard").first()
    assert [s for s, _ in training_order.read_shard(first.path, 10, 5)] == [10, 11, 12, 13, 14]
    assert training_order.read_shards(manifest).count() == count
    raw = lambda m: [open(r.path, "rb").read() for r in m.orderBy("shard").collect()]
    assert raw(shards(spark, docs(spark, corpus, ids).repartition(7, "text"), shard_rows=50, seed=5, waves=1)[0]) == raw(manifest)
    other = training_order.permuted(np.arange(count), count, 6)
    assert sorted(other) == list(range(count)) and other.tolist() != slots


def test_training_order_edges(spark):
    manifest, held, read = shards(spark, docs(spark, ["a"]).limit(0))
    assert read == {} and held.count() == 0 and training_order.read_shards(manifest).count() == 0
    _, _, read = shards(spark, docs(spark, ["same", "same", None, "", "x"], [1, 1, None, None, 0]))
    assert len(read) == 1 and collections.Counter(read[0])[2] == 5


def test_permutations():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        assert sorted(training_order.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


# --- toxicity


def test_toxicity(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices(["th", "on", "er", "ea", "ti"], k=3)) for _ in range(n))
    rows, label = [], []
    for _ in range(600):
        bad = rng.random() < 0.2
        parts = [words(12) + "." for _ in range(rng.randint(1, 8))]
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), words(3) + " you " + rng.choice(["jerkface", "dumbhead", "rotter"]) + " " + words(3) + "!")
        rows.append(" ".join(parts))
        label.append(int(bad))
    rows += ["", None, words(30_000), "jerkface dumbhead rotter"]
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(label)] + [(3, 0, None)], "doc_id long, quality int, toxic int")
    own = docs(spark, rows)
    model = toxicity.train(spark, own, labels)
    got = {r.doc_id: r for r in toxicity.score(own, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == label[i] for i in held]) > 0.97 and len(held) > 50
    assert [got[i].predicted for i in (600, 601, 602, 603)] == [0, 0, 0, 1]
    for i, y in enumerate(label):
        for s in got[i].offending:
            assert y == 1 and re.search("jerkface|dumbhead|rotter", rows[i][s.start : s.end])
    assert sum(bool(got[i].offending) for i in range(600)) > 0.9 * sum(label)
    kept = {r.doc_id for r in toxicity.without_toxic(own, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    nothing = toxicity.train(spark, own, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(own, nothing).collect()} == {0.0}
    assert toxicity.score(own.limit(0), model).count() == 0
    always = toxicity.train(spark, own, labels.filter("toxic = 1"))
    assert {round(r.score, 6) for r in toxicity.score(own, always).collect()} == {1.0}
    twice = toxicity.score(docs(spark, ["jerkface dumbhead rotter"] * 2 + [""], [None, None, 1]), model).select("doc_id", "score", toxicity.held_out("doc_id").alias("out")).collect()
    assert len({r.score for r in twice[:2]}) == 1 and [r.out for r in twice[:2]] == [True, True] and None not in {r.out for r in twice}


# --- Jaccard join


def brute(texts):
    fold = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    split = [re.findall(r"[^ \t-\r]+", (t or "").translate(fold)) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in split]
    parent, links = list(range(len(texts))), collections.defaultdict(set)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
                if texts[i] != texts[j]:
                    links[i].add(texts[j])
                    links[j].add(texts[i])
    return [root(i) for i in range(len(texts))], [len(links[i]) for i in range(len(texts))]


def test_jaccard_join(spark, corpus):
    rng = random.Random(12)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    group = []
    for _ in range(60):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(150)] = f"e{rng.randrange(9999)}"
        group.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(30))
    mixed = [" ".join(f"m{rng.randrange(10**6)}" for _ in range(60)) + " " + passage for _ in range(60)]
    texts = [t for t in corpus if len(t or "") < 5000] + group + mixed + ["ONE  two\nthree", "one two three", None]
    got = {r.doc_id: r for r in jaccard_join.join(docs(spark, texts)).select("doc_id", "class_id", "n_links").collect()}
    classes, links = brute(texts)
    assert [got[i].class_id for i in range(len(texts))] == classes
    assert [got[i].n_links for i in range(len(texts))] == links
    kept = jaccard_join.one_of_each(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes)) and kept.columns == docs(spark, texts).columns


def test_jaccard_edges(spark):
    assert jaccard_join.join(docs(spark, ["a"]).limit(0)).count() == 0
    rows = jaccard_join.join(docs(spark, ["a b c", "a b c", "x y", None], [4, 4, None, None])).collect()
    assert len(rows) == 4 and {r.class_id for r in rows if r.doc_id == 4} == {4} and {r.n_links for r in rows} == {0}
    assert jaccard_join.one_of_each(docs(spark, ["a b c", "a b c", "x y"], [4, 4, 5])).count() == 2


def test_blocks_count_like_one(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base[:k], f"e{rng.randrange(99999)}", *base[k + 1 :]]) for k in range(70)]
    whole = {r.doc_id: r.n_links for r in jaccard_join.join(docs(spark, texts)).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    assert {r.doc_id: r.n_links for r in jaccard_join.join(docs(spark, texts)).collect()} == whole


def test_one_of_each_goes_by_text(spark):
    near = [f"w{i}" for i in range(80)]
    texts = ["one text of its own here", "another text that is unlike", " ".join(near), " ".join([*near[:79], "x"]), " ".join(near), "no id and no copy either", "", ""]
    ids = [1, 1, None, None, 9, None, None, None]
    kept = jaccard_join.one_of_each(docs(spark, texts, ids)).collect()
    assert sorted(r.text for r in kept) == sorted([texts[0], texts[1], texts[4], texts[5], "", ""])
    assert {r.doc_id for r in kept if r.text == texts[4]} == {9}
    kept = jaccard_join.one_of_each(docs(spark, texts[2:4] * 2, [None] * 4)).collect()
    assert len(kept) == 1


def test_columns_of_any_name_are_carried(spark, monkeypatch):
    """Names that the operators use inside; with every recurring line hot as well."""
    names = ["id", "row", "words", "gone", "lines", "dense", "hash", "own_hash", "every", "key_hash", "key_id", "part", "__id", "__row", "copy"]
    line = "a line that recurs in many documents and is long enough"
    rows = spark.createDataFrame([(i, f"{line}\n{i} unlike the other texts of this table", *[7] * len(names)) for i in range(8)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    whole = lambda df: all(tuple(r[n] for n in names) == (7,) * len(names) for r in df.collect())
    for hot in (1_000, 1):
        monkeypatch.setattr(_store, "HOT_ROWS", hot)
        thinned = line_dedup.dedup_lines(rows)
        assert whole(thinned) and {r.doc_id: r.n_dropped for r in thinned.collect()} == {i: int(i < 7) for i in range(8)}
    parts = sharding.shard(rows, 2, part_bytes=100)
    assert whole(parts) and all(sorted(r.slot for r in parts.collect() if r.shard == s) == list(range(sum(r.shard == s for r in parts.collect()))) for s in (0, 1))
    kept = decontaminate.without_leaks(rows, items(spark, [line]))
    assert kept.columns == rows.columns and kept.count() == 0 and whole(decontaminate.without_leaks(rows, items(spark, ["absent words"])))
    once = jaccard_join.one_of_each(rows)
    assert once.columns == rows.columns and whole(once) and once.count() > 0
