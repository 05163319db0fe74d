"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap.

Items are the indexed documents, passages of training text the queries. Terms
are runs of letters and digits, A-Z as a-z; in scripts written without spaces
each character is a term. A term's weight in an item is its
BM25 impact, divided by the item's score for its own text, so one threshold
holds for all items: an item's own passage scores 1.

Every passage (``window`` terms or, if more, those of the longest item of its
index; a new one each third of that) is a query of its distinct terms. Items
much longer than others have an index of their own, four times as long each. Retrieval returns all items at or above ``least_score`` and no
top-k: terms are ordered by their greatest impact, and the terms whose greatest
impacts together stay below what is missing to the threshold cannot carry an
item over it alone, so only the others open candidates. Items lie in blocks;
for each (passage, block) that an essential term opens, the sum of the terms'
block maxima bounds all its items, and only blocks whose bound reaches the
threshold are scored in full. All of it runs over whole Arrow batches at a
time, with the same result as scoring every pair.

A retrieved pair is verified on the whole document: an item's first part is its
question and the rest its answer, and both must share enough pairs of
neighbouring terms with the stretch of the document that scored.

Document frequencies of all items' terms are counted as a table. The indexes are
built on the driver from at most ``group_bytes`` of items at a time, with the
frequencies of those items' terms, and broadcast together, so a group scans the
documents once; a larger benchmark is worked through in groups of items. That
never depends on the number of documents.

Defined cases: null texts and empty items match nothing; an item of fewer than
``least_terms`` terms has no score (null) and is found where a document holds
all its terms in a row. Such a find says little if the item is short and
common, so it has a ``content`` in bits, ``log2((documents + 1) / documents that
hold it)`` and ``WORD_BITS`` for each term after the first, and
``without_leaks`` acts on those of ``least_bits`` or more only: items of four
terms or more always, one of a single term if it is in fewer than one of 4,096
documents. An item without terms (only punctuation) matches nothing; a null ``item_id`` or
``doc_id`` is reported as null; rows that share an id are judged each, equal
ones alike; without items or documents there are no rows; other columns are
ignored, but kept by ``without_leaks``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._store import documents, fresh_names, materialise, small_batches, text_of
from cairn.llm._words import Words, alphabet, mix, words

ALNUM = alphabet("alnum", unspaced=True)


#: What a term in a row with others is taken to say at least.
WORD_BITS = 4


@dataclass
class Search:
    window: int = 48
    k1: float = 1.2
    b: float = 0.75
    least_score: float = 0.4
    least_terms: int = 8
    least_bits: float = 12
    question_share: float = 0.7
    least_question: float = 0.5
    least_answer: float = 0.5
    block_items: int = 8
    group_bytes: int = 32 << 20


@dataclass
class Index:
    """Postings of a group of items, by term and, for the bounds, by term and block."""

    item_ids: list[int | None]
    terms: np.ndarray
    greatest: np.ndarray
    essential: np.ndarray
    slack: float
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_impacts: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    lengths: np.ndarray
    seen: np.ndarray
    window: int
    stride: int


@dataclass
class Exact:
    """Items too short for a score: by number of terms, the sorted hashes of whole items and their ids."""

    items: dict[int, tuple[np.ndarray, list[int]]]


def pairs_of(terms: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring terms."""
    return mix(terms[:-1] * np.uint64(3) + terms[1:], 5)


def _term_lists(texts: list[str]) -> list[np.ndarray]:
    out = []
    for found in words(pa.array(texts, pa.string()), ALNUM):
        out += [found.hashes[a:b] for a, b in zip(found.bounds, found.bounds[1:], strict=False)]
    return out


def build(items: list[tuple[int, str]], how: Search, documents_with: dict[int, int], n_items: int, mean_terms: float) -> Index | None:
    """The index of some items, given statistics over all of them."""
    lists = _term_lists([text or "" for _, text in items])
    keep = [i for i, t in enumerate(lists) if len(t) >= how.least_terms]
    if not keep:
        return None
    rows = []
    for number, i in enumerate(keep):
        terms, tf = np.unique(lists[i], return_counts=True)
        df = np.array([documents_with[int(t)] for t in terms])
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        weight = idf * tf * (how.k1 + 1) / (tf + how.k1 * (1 - how.b + how.b * len(lists[i]) / mean_terms))
        rows.append((np.full(len(terms), number), terms, (weight / weight.sum()).astype(np.float32)))
    item, term, impact = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((item, term))
    item, term, impact = item[order], term[order], impact[order]
    terms, starts = np.unique(term, return_index=True)
    greatest = np.maximum.reduceat(impact, starts)
    starts = np.append(starts, len(term))
    # the least essential terms: for each item its own sum of them must stay below the threshold
    by_reach = np.argsort(greatest, kind="stable")
    essential, sums = np.ones(len(terms), bool), np.zeros(len(keep))
    for t in by_reach.tolist():
        a, b = starts[t], starts[t + 1]
        if (sums[item[a:b]] + impact[a:b]).max() >= 0.5 * how.least_score:
            break
        sums[item[a:b]] += impact[a:b]
        essential[t] = False
    block = item // how.block_items
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
    seen = np.zeros(1 << 18, bool)
    seen[(terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    window = max(how.window, max(len(lists[i]) for i in keep))
    split = [max(2, round(how.question_share * len(lists[i]))) for i in keep]
    return Index(
        [items[i][0] for i in keep], terms, greatest, essential, float(sums.max()), starts, item, impact, np.searchsorted(first, starts), block[first], np.maximum.reduceat(impact, first),
        [np.unique(pairs_of(lists[i][:s])) for i, s in zip(keep, split, strict=True)], [np.unique(pairs_of(lists[i][s - 1 :])) for i, s in zip(keep, split, strict=True)], np.array([len(lists[i]) for i in keep]), seen, window, max(1, window // 3),
    )


def _whole(terms: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` neighbouring terms."""
    h = np.zeros(max(0, len(terms) - n + 1), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(31) + terms[k : k + len(h)], 7)
    return h


def build_exact(items: list[tuple[int, str]], how: Search) -> Exact | None:
    """Of the items with at least one term but fewer than ``least_terms``."""
    by_size: dict[int, list] = {}
    for (item, _), own in zip(items, _term_lists([text or "" for _, text in items]), strict=True):
        if 0 < len(own) < how.least_terms:
            by_size.setdefault(len(own), []).append((int(_whole(own, len(own))[0]), item))
    for own in by_size.values():
        own.sort(key=lambda x: x[0])
    return Exact({n: (np.array([h for h, _ in own], np.uint64), [i for _, i in own]) for n, own in by_size.items()}) if by_size else None


def holds(found: Words, index: Exact) -> Iterator[tuple]:
    """``(text, item, no score, 1, 1, terms, hash of the item)`` where a text holds all terms of an item in a row."""
    out = set()
    for n, (hashes, ids) in index.items.items():
        here = _whole(found.hashes, n)
        low, high = np.searchsorted(hashes, here), np.searchsorted(hashes, here, "right")
        at = np.flatnonzero(high > low)
        text = np.searchsorted(found.bounds, at, "right") - 1
        inside = at + n <= found.bounds[text + 1]
        for d, a, b in set(zip(text[inside].tolist(), low[at][inside].tolist(), high[at][inside].tolist(), strict=True)):
            out.update((d, i) for i in range(a, b))
        yield from ((d, ids[i], None, 1.0, 1.0, n, int(hashes[i].view(np.int64))) for d, i in sorted(out))
        out.clear()


def _expand(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and posting number of all postings of the terms ``which``."""
    size = starts[which + 1] - starts[which]
    total = np.cumsum(size)
    rows = np.repeat(np.arange(len(which)), size)
    return rows, np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size - starts[which], size)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, values, len(distinct))


def retrieve(found: Words, index: Index, how: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ``(text, first word, item, score)`` at or above the threshold among a slice's passages."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    maybe = np.flatnonzero(index.seen[(found.hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.terms, found.hashes[maybe]), len(index.terms) - 1)
    ok = index.terms[place] == found.hashes[maybe]
    word, term = maybe[ok], place[ok]
    if not len(word):
        return none
    # passages by number: each text has its own, at strides; a word lies in window / stride of them
    counts = np.diff(found.bounds)
    passages = np.where(counts > 0, np.maximum(0, -(-(counts - index.window) // index.stride)) + 1, 0)
    base = np.concatenate([[0], np.cumsum(passages)])
    text = np.searchsorted(found.bounds, word, "right") - 1
    inside = word - found.bounds[text]
    reach = -(-index.window // index.stride)
    last = np.minimum(inside // index.stride, passages[text] - 1)
    spread = (last[:, None] - np.arange(reach)[None, :]).ravel()
    at, what, owner = np.repeat(inside, reach), np.repeat(term, reach), np.repeat(text, reach)
    in_it = (spread >= 0) & (at < spread * index.stride + index.window)
    query = np.unique((base[owner[in_it]] + spread[in_it]) * np.int64(len(index.terms)) + what[in_it])  # distinct terms of each passage
    passage, term = query // len(index.terms), query % len(index.terms)
    # WAND: what the passage could reach at all, then what its essential terms could add to the rest
    ceiling = np.bincount(passage, index.greatest[term], int(base[-1]))
    live = ceiling[passage] >= how.least_score
    passage, term = passage[live], term[live]
    lead = index.essential[term]
    rows, posting = _expand(index.block_starts, term[lead])
    blocks = int(index.blocks.max()) + 1
    opened, bound = _sum_by(passage[lead][rows] * blocks + index.blocks[posting], index.block_impacts[posting])
    opened = opened[bound + index.slack >= how.least_score]
    if not len(opened):
        return none
    # the full bound of the blocks that are left, then the full scores in those that reach the threshold
    close = np.isin(passage, opened // blocks)
    passage, term = passage[close], term[close]
    rows, posting = _expand(index.block_starts, term)
    key = passage[rows] * blocks + index.blocks[posting]
    kept = np.isin(key, opened)
    alive, bound = _sum_by(key[kept], index.block_impacts[posting[kept]])
    alive = alive[bound >= how.least_score - 1e-6]
    close = np.isin(passage, alive // blocks)
    passage, term = passage[close], term[close]
    rows, posting = _expand(index.starts, term)
    key = passage[rows] * blocks + index.items[posting] // how.block_items
    kept = np.isin(key, alive)
    n = len(index.item_ids)
    scored, score = _sum_by(passage[rows][kept] * n + index.items[posting[kept]], index.impacts[posting[kept]])
    over = score >= how.least_score - 1e-6
    scored, score = scored[over], score[over]
    owner = np.searchsorted(base, scored // n, "right") - 1
    return owner, found.bounds[owner] + (scored // n - base[owner]) * index.stride, scored % n, score


def verify(found: Words, index: Index, how: Search, owner: np.ndarray, first: np.ndarray, item: np.ndarray, score: np.ndarray) -> list[tuple]:
    """``(text, item, score, question overlap, answer overlap)`` of the pairs that both parts confirm."""
    best: dict[tuple[int, int], tuple] = {}
    for d, w, i, s in zip(owner.tolist(), first.tolist(), item.tolist(), score.tolist(), strict=True):
        margin = int(index.lengths[i])
        low, high = max(found.bounds[d], w - margin), min(found.bounds[d + 1], w + index.window + margin)
        here = pairs_of(found.hashes[low:high])
        question, answer = (float(np.isin(part, here).mean()) for part in (index.question[i], index.answer[i]))
        if question >= how.least_question and answer >= how.least_answer and (s, question, answer) > best.get((d, i), (-1,)):
            best[d, i] = (s, question, answer)
    return [(*k, *v) for k, v in best.items()]


FOUND = "doc_id long, text_hash long, item_id long, score double, question_overlap double, answer_overlap double, terms int, item_hash long"
FOUND_ARROW = pa.schema([
    *((c, pa.int64()) for c in ("doc_id", "text_hash", "item_id")), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap")), ("terms", pa.int32()), ("item_hash", pa.int64()),
])


def item_terms(items: DataFrame, how: Search) -> DataFrame:
    """``group, size, terms`` of items: their distinct terms, and how many terms they have in all."""
    small_batches(items.sparkSession)
    schema = pa.schema([("group", pa.int64()), ("size", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _term_lists(batch.column(1).to_pylist())
            own = [np.unique(x).view(np.int64).tolist() if len(x) >= how.least_terms else [] for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array(own, pa.list_(pa.int64()))], schema=schema)

    return items.select("group", "text").mapInArrow(run, "group long, size long, terms array<long>")


def indexes(items: DataFrame, how: Search) -> Iterator[list[Index | Exact]]:
    """For each group of items, whose texts are bounded, its indexes."""
    known = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // how.group_bytes))
    numbered = known.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    terms = materialise(item_terms(numbered, how), "item-terms")
    scored = F.col("size") >= how.least_terms
    n, mean = terms.filter(scored).agg(F.count(F.lit(1)), F.avg("size")).first()
    each = terms.filter(scored).select("group", F.explode("terms").alias("term"))
    held_by = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for g in range(groups):
        rows = sorted(((r["item_id"], r["text"]) for r in numbered.filter(F.col("group") == g).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        own = held_by.join(each.filter(F.col("group") == g).select("term").distinct(), "term", "left_semi").toArrow()
        df = dict(zip(own.column("term").to_numpy().view(np.uint64).tolist(), own.column("n").to_pylist(), strict=True))
        classes: dict[int, list] = {}
        for row, found in zip(rows, _term_lists([text for _, text in rows]), strict=True):
            classes.setdefault(max(0, math.ceil(math.log(max(1, len(found)) / how.window, 4))), []).append(row)
        yield [x for x in (*(build(own, how, df, n, mean or 1.0) for own in classes.values()), build_exact(rows, how)) if x is not None]


def leaks(docs: DataFrame, items: DataFrame, how: Search | None = None) -> DataFrame:
    """``doc_id, text_hash, item_id, score, question_overlap, answer_overlap, content``: a row for each document and item that it leaks."""
    how = how or Search()
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("text_hash"), "text")
    found, short = None, False
    for own in indexes(items, how):
        short |= any(isinstance(index, Exact) for index in own)
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, hashes, out = batch.column(0), batch.column(1), []
                for slice_ in words(batch.column(2), ALNUM):
                    for index in shared.value:
                        if isinstance(index, Exact):
                            met = holds(slice_, index)
                        else:
                            hits = retrieve(slice_, index, how)
                            met = [(d, index.item_ids[i], s, q, a, None, None) for d, i, s, q, a in (verify(slice_, index, how, *hits) if len(hits[0]) else [])]
                        out += [(ids[slice_.first + d].as_py(), hashes[slice_.first + d].as_py(), *rest) for d, *rest in met]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND_ARROW, strict=True)], schema=FOUND_ARROW)

        part = rows.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    found = found if found is not None else spark.createDataFrame([], FOUND)
    if not short:
        return found.drop("terms", "item_hash").withColumn("content", F.lit(None).cast("double"))
    found = materialise(found, "leaks")
    key = ["item_id", "terms", "item_hash"]
    known = found.filter("score IS NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    bits = F.log2(F.lit(docs.count() + 1) / F.col("held")) + WORD_BITS * (F.col("terms") - 1)
    known = known.select(*(F.col(c).alias(f"own_{c}") for c in key), bits.alias("content"))
    same = F.col("item_id").eqNullSafe(F.col("own_item_id")) & (F.col("terms") == F.col("own_terms")) & (F.col("item_hash") == F.col("own_item_hash"))
    scored = found.filter("score IS NOT NULL").withColumn("content", F.lit(None).cast("double"))
    # a row for each short item, of which a group's text is bounded
    return scored.unionByName(found.filter("score IS NULL").join(known, same).drop(*(f"own_{c}" for c in key))).drop("terms", "item_hash")


def without_leaks(docs: DataFrame, items: DataFrame, how: Search | None = None) -> DataFrame:
    """``docs`` without the rows that leak an item; a short item counts where its find says enough."""
    how = how or Search()
    id_, hash_ = fresh_names(docs, "id", "hash")
    hit = leaks(docs, items, how).filter(F.col("score").isNotNull() | (F.col("content") >= how.least_bits)).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit[id_]) & (F.xxhash64(text_of(docs["text"])) == hit[hash_]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
