"""Ranked lexical search over document shards, in whole numbers.

The index is a table of shards, each some documents of one task of the scan:
postings by term in compressed sparse rows (``terms`` as sorted 64-bit hashes,
``starts``, ``places`` of documents within the shard). A first pass writes them
with occurrences; two sums over the shards give the corpus statistics; a second
pass replaces occurrences by integer impacts, which is all that a search reads.

A search ships a block of items of bounded size to every task. There each item
adds its terms' weighted impacts, term at a time, to a dense array of the
shard's documents. The best ``k`` are found by a partition around the k-th
score; all documents tied with it take part, so that ids decide and not places.
A task keeps only its best over all its shards; the shards' lists are merged by
rank, in two levels, so that no task sees more than some lists of an item.

Documents are never exchanged, nor are postings. Memory follows a shard (some
8 MB of text, or one longer document) and the block of items.

A term's weight is ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; its impact on a
document ``(1e9 tf) div (1000 tf + 12 m)``, ``m = 75 + (25 n N) div L``: ``N``
documents with terms, ``L`` all their terms, ``n`` the document's own.

Defined cases: a null text has no terms; documents without terms count nowhere;
rows that share an id are documents each, null ids come last among ties; equal
items are one, an item without a known term has no hits; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._store import documents, materialise, small_batches, text_of
from cairn.llm._words import Words, alphabet, words

TERMS = alphabet("alnum")
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Text of the items that one pass over the index answers.
BLOCK_BYTES = 8 << 20
#: Lists of one item that one task of the first merge sees are those of a share of all tasks.
MERGE_PARTS = 64

SHARD = "ids array<long>, n_docs long, n_terms long, lengths binary, terms binary, starts binary, places binary, counts binary"
SHARD_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("lengths", "terms", "starts", "places", "counts"))])
HITS = "number int, item_id long, doc_id long, score long"
HITS_ARROW = pa.schema([("number", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Index:
    """``shards``: a written table, with ``impacts`` for occurrences. ``n_docs, n_terms``: of the corpus."""

    shards: DataFrame
    n_docs: int
    n_terms: int


@dataclass
class Items:
    """A block of items. ``terms``: all their distinct terms, sorted. ``wanted``: of each item, places in ``terms`` and repeats."""

    ids: list[int | None]
    terms: np.ndarray
    wanted: list[tuple[np.ndarray, np.ndarray]]


class _Shard:
    """Documents on their way to a row of the index."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, found: Words, ids: list[int | None]) -> None:
        """The documents of a slice that have terms."""
        n = np.diff(found.bounds)
        kept = np.flatnonzero(n)
        place = np.cumsum(n > 0) - 1 + len(self.ids)
        owner = np.repeat(place, n)
        by_term = np.argsort(found.hashes, kind="stable")  # words come document by document, so a term's documents ascend
        term, owner = found.hashes[by_term], owner[by_term]
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.postings.append((term[first], owner[first], np.diff(np.append(first, len(term)))))
        self.lengths.append(n[kept])
        self.ids += [ids[k] for k in kept.tolist()]
        self.bytes += len(found.data)

    def row(self) -> pa.RecordBatch:
        term, place, count = (np.concatenate(c) for c in zip(*self.postings, strict=True))
        by_term = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[by_term], return_index=True)
        lengths = np.concatenate(self.lengths)
        raw = [lengths.astype("<i8"), terms.astype("<u8"), np.append(starts, len(term)).astype("<i8"), place[by_term].astype("<u4"), count[by_term].astype("<u4")]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([self.ids, len(self.ids), int(lengths.sum()), *(x.tobytes() for x in raw)], SHARD_ARROW, strict=True)], schema=SHARD_ARROW)


def term_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first pass: shards with occurrences, as ``SHARD``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Shard()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for found in words(batch.column(1), TERMS):
                own.add(found, ids[found.first : found.first + len(found)])
                if own.bytes >= shard_bytes or len(own.ids) >= SHARD_DOCS:
                    if own.ids:
                        yield own.row()
                    own = _Shard()
        if own.ids:
            yield own.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SHARD)


def _array(batch: pa.RecordBatch, column: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What occurrences ``tf`` count in documents of ``n`` terms; below a million."""
    m = 75 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    counted = materialise(term_shards(docs, shard_bytes), "term-shards")
    n_docs, n_terms = (int(x or 0) for x in counted.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    schema = SHARD_ARROW.remove(SHARD_ARROW.get_field_index("counts")).remove(SHARD_ARROW.get_field_index("lengths")).append(pa.field("impacts", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                n = _array(batch, "lengths", i, "<i8")[_array(batch, "places", i, "<u4")]
                found.append(impact(_array(batch, "counts", i, "<u4").astype(np.int64), n, n_docs, n_terms).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(found, pa.binary())], schema=schema)

    kept = ", ".join(c for c in SHARD.split(", ") if c.split(" ")[0] not in ("counts", "lengths"))
    return Index(materialise(counted.mapInArrow(run, f"{kept}, impacts binary"), "impact-shards"), n_docs, n_terms)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items, in blocks of about ``block_bytes`` of text."""
    known = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    numbered = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = sorted(((r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        lists = []
        for found in words(pa.array([text for _, text in rows], pa.string()), TERMS):
            lists += [found.hashes[x:y] for x, y in zip(found.bounds, found.bounds[1:], strict=False)]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]))
        own = [np.unique(x, return_counts=True) for x in lists]
        yield Items([i for i, _ in rows], terms, [(np.searchsorted(terms, t), n) for t, n in own])


def _found(terms: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted ``terms``, those that a shard's sorted ``own`` has, and their places in it."""
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
    met = np.flatnonzero(own[at] == terms)
    return met, at[met]


def document_frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted ``terms`` occurs; a row for each term and task leaves the shards."""
    shared = index.shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                met, at = _found(shared.value, _array(batch, "terms", i, "<u8"))
                starts = _array(batch, "starts", i, "<i8")
                total[met] += starts[at + 1] - starts[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])

    sums = index.shards.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by id, null ids last."""
    at = np.arange(len(score))
    if len(score) > k:
        kth = score[np.argpartition(score, len(score) - k)[len(score) - k]]
        at = np.flatnonzero(score >= kth)  # all that tie with the last place
    return at[np.lexsort((ids[at], null[at], -score[at]))[:k]]


def shard_hits(items: Items, weight: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's best documents of each item over all its shards."""
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            known = batch.column("ids")[i].values
            null = known.is_null().to_numpy(zero_copy_only=False)
            ids = known.fill_null(0).to_numpy()
            places, impacts, starts = _array(batch, "places", i, "<u4"), _array(batch, "impacts", i, "<u4"), _array(batch, "starts", i, "<i8")
            met, at = _found(items.terms, _array(batch, "terms", i, "<u8"))
            where = np.full(len(items.terms), -1)
            where[met] = at
            for number, (own, repeats) in enumerate(items.wanted):
                sums = np.zeros(len(ids), np.int64)
                for t, times in zip(own.tolist(), repeats.tolist(), strict=True):
                    if where[t] >= 0:
                        low, high = starts[where[t]], starts[where[t] + 1]
                        sums[places[low:high]] += weight[t] * times * impacts[low:high].astype(np.int64)
                hit = np.flatnonzero(sums > 0)
                if len(hit):
                    parts = zip(held.get(number, (sums[:0], ids[:0], null[:0])), (sums[hit], ids[hit], null[hit]), strict=True)
                    score, who, no = (np.concatenate(p) for p in parts)
                    kept = best(score, who, no, k)
                    held[number] = score[kept], who[kept], no[kept]
    for number, (score, who, no) in held.items():
        n = len(score)
        yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array([items.ids[number]] * n, pa.int64()), pa.array(who, pa.int64(), mask=no), pa.array(score, pa.int64())], schema=HITS_ARROW)


def search(index: Index, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, all if fewer score above 0."""
    spark = index.shards.sparkSession
    small_batches(spark)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, block_bytes):
        if not len(block.terms):
            continue
        shared = spark.sparkContext.broadcast((block, weights(document_frequencies(index, block.terms), index.n_docs)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from shard_hits(*shared.value, k, batches)

        lists = index.shards.mapInArrow(run, HITS).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
        some = lists.withColumn("rank", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).filter(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k)
        found = found.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return found


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), posting AS (
  SELECT doc_id, term, count(*) AS tf FROM word GROUP BY doc_id, term
), long AS (
  SELECT doc_id, sum(tf)::BIGINT AS own FROM posting GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, sum(own)::BIGINT AS terms FROM long
), scaled AS (
  SELECT doc_id, 100 - 25 + ((25 * own * docs) // terms) AS m FROM long, corpus
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posting, corpus GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY item_id, term
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term) JOIN scaled USING (doc_id)
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
