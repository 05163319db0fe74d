"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's ids end with an end mark. Only longer ones are cut, into full
pieces behind a first one that may be shorter; full pieces fill a sequence, and
each document leaves at most one piece to place.

Placing is bulk-synchronous best fit. Lengths are whole numbers up to the
capacity, so documents are held as runs of ranks of equal length and gaps as
runs of sequences of equal room: a few thousand rows, whatever the number of
documents. In a round, runs are sorted by size from the largest and swept: a gap
is put on a stack and a document takes the gap on top, which is its successor
among those not taken, the smallest that it fits in. Ranks resolve conflicts, as
the longer document and then the lower rank is first. Ranges of sizes are swept
by a task each; a pair within a range is one of the whole sweep, as brackets that
match within a stretch do, and what the ranges pass on is swept after them. Then
gaps are updated, and the round is written and repeats with the documents left.

A round takes documents of at least half the longest one left; shorter ones wait,
or they would take room that best-fit decreasing gives to longer ones. Once none
is longer than a sixteenth of the capacity, all are taken. Documents
longer than every gap open sequences, no more than they need in any packing.
The result is within a few of best-fit decreasing done one by one.

Rounds hand out ranges of ranks; which document has which rank is settled by
the executors. Ranks come from counts by length and block of ids, so a length
that a third of all documents share is counted in many tasks.

Defined cases: a null or empty text has only the end mark; rows that share an
id are packed each, told apart by a hash of the text and, if that is equal too,
interchangeable; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._store import documents, materialise, small_batches, text_of
from cairn.llm._tokens import Encoder

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document's pieces; ``with_ids`` adds ``ids``, little-endian unsigned 32-bit."""
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    schema = PIECES_ARROW.append(pa.field("ids", pa.binary())) if with_ids else PIECES_ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            keys, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            done, out = 0, []
            for ids, bounds in encoder.encode(batch.column(1).to_pylist()):
                for i in range(len(bounds) - 1):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    edges = [0, *range(first, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        raw = own[a:b].tobytes()
                        out.append((keys[done], copies[done], k, a, b - a, zlib.crc32(raw), raw)[: len(schema)])
                    done += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("copy", F.xxhash64("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def _is(kind: str) -> Column:
    return F.col("kind") == kind


RUNS = "kind string, size int, first long, n long, last long, at int"
RUNS_ARROW = pa.schema([("kind", pa.string()), ("size", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("at", pa.int32())])
#: Ranges of sizes that are swept apart.
RANGES = 8


def _row(kind: str, size: Column, first: Column, n: Column) -> Column:
    """A run that is not placed: ``first`` rank or sequence and how many. A placed one has the ``last`` sequence too (ranks rise as sequences fall) and the offset."""
    return F.struct(F.lit(kind).alias("kind"), size.cast("int").alias("size"), first.cast("long").alias("first"), n.cast("long").alias("n"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("int").alias("at"))


def matched(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Sweeps sorted runs: a gap goes on a stack, a document takes the gap on top.

    What this stretch of the order cannot match is passed on: documents that
    found the stack empty, then the gaps left on it. A sweep over what several
    stretches passed on, in order, ends as one over all of them would.
    """
    stack: list[tuple[int, int, int]] = []
    out: list[tuple] = []
    for batch in batches:
        for kind, size, first, n, last, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == "gap":
                stack.append((size, first, n))
            elif kind == "doc":
                while n and stack:
                    room, sequence, some = stack.pop()
                    took = min(n, some)
                    out.append(("placed", size, first, took, sequence + some - 1, capacity - room))
                    out.append(("new", room - size, sequence + some - took, took, None, None))
                    first, n = first + took, n - took
                    if some > took:
                        stack.append((room, sequence, some - took))
                if n:
                    out.append(("doc", size, first, n, None, None))
            else:
                out.append((kind, size, first, n, last, at))
    out += [("gap", *gap, None, None) for gap in stack]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RUNS_ARROW, strict=True)] if out else [pa.array([], f.type) for f in RUNS_ARROW], schema=RUNS_ARROW)


def sweep(runs: DataFrame, longest: int, capacity: int) -> DataFrame:
    """One round: what is placed, and the documents and gaps that are left.

    Ranges of sizes are swept by a task each, then what they passed on; gaps
    made in a round (``new``) are for the next one.
    """
    waits = _is("doc") & (F.col("size") * 2 < longest) & F.lit(longest * 16 > capacity)
    order = [F.desc("size"), _is("doc"), "first"]  # gaps before documents of their size
    range_ = F.least(F.lit(RANGES - 1), ((capacity - F.col("size")) * RANGES / capacity).cast("int"))
    apart = runs.filter(~waits).repartitionById(RANGES, range_).sortWithinPartitions(*order)
    passed = apart.mapInArrow(partial(matched, capacity=capacity), RUNS)
    whole = passed.repartition(1).sortWithinPartitions(*order).mapInArrow(partial(matched, capacity=capacity), RUNS)
    kept = whole.withColumn("kind", F.when(_is("new"), "gap").otherwise(F.col("kind"))).filter("size > 0")
    return kept.unionByName(runs.filter(waits))


#: For the rounds' few thousand rows: one partition, no code compiled and no long text kept of their plans.
SMALL_PLANS = {
    "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.maxPlanStringLength": "2000",
    "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1",
}


@contextmanager
def small_plans(spark: SparkSession) -> Iterator[None]:
    held = {name: spark.conf.get(name, None) for name in SMALL_PLANS}
    for name, value in SMALL_PLANS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plan(counts: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Placements ``length, lo, some, last, at`` of ``counts(length, n)``, and the number of sequences.

    Ranks ``lo + i`` (``i < some``) of a length go to sequence ``last - i``, offset ``at``.
    """
    spark = counts.sparkSession
    counts = materialise(counts, "lengths")
    with small_plans(spark):
        placed, used = _rounds(spark, counts, capacity)
        return materialise(placed, "places"), used


def _rounds(spark: SparkSession, counts: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    state = materialise(counts.select(_row("doc", F.col("length"), F.lit(0), F.col("n")).alias("r")).select("r.*"), "round")
    done, used = [state.filter("kind = 'placed'")], 0
    while True:
        most = state.groupBy("kind").agg(F.max("size").alias("size"))
        longest = {r["kind"]: r["size"] for r in most.collect()}  # two rows
        if "doc" not in longest:
            break
        if longest["doc"] > longest.get("gap", 0):
            beyond = state.filter(_is("doc") & (F.col("size") > longest.get("gap", 0)))
            halves = F.sum(F.when(F.col("size") * 2 > capacity, F.col("n")).otherwise(0))
            tokens, halves = beyond.agg(F.sum(F.col("size") * F.col("n")), halves).first()
            opened = max(-(-tokens // capacity), halves)
            state = state.unionByName(spark.range(1).select(_row("gap", F.lit(capacity), F.lit(used), F.lit(opened)).alias("r")).select("r.*"))
            used += opened
        met = materialise(sweep(state, longest["doc"], capacity), "round")
        done.append(met.filter("kind = 'placed'"))
        state = met.filter("kind <> 'placed'")
    placed = reduce(DataFrame.unionByName, done)
    return placed.select(F.col("size").alias("length"), F.col("first").alias("lo"), F.col("n").alias("some"), "last", "at"), used


def ranked(parts: DataFrame, block_rows: int = 50_000) -> DataFrame:
    """``parts`` with ``rank``, from 0 within each length."""
    rows = parts.count()
    blocks = max(1, -(-rows // block_rows))
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks)))
    sizes = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "block").orderBy("doc_id", "copy", "piece")
    return dealt.withColumn("nth", F.row_number().over(inner)).join(base, ["length", "block"]).select(*parts.columns, (F.col("base") + F.col("nth") - 1).alias("rank"))


def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """``parts`` (written before, as they are read several times) with ``sequence_id`` and ``offset``."""
    places, _ = plan(parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")), capacity)
    # a few rows for each length and round, not for each document; past a size they are joined by exchange
    places = F.broadcast(places) if places.count() <= 200_000 else places
    row = ranked(parts)
    joined = row.join(places, (row["length"] == places["length"]) & (row["rank"] >= places["lo"]) & (row["rank"] < places["lo"] + places["some"]))
    return joined.select(*[row[c] for c in parts.columns], (F.col("last") - (F.col("rank") - F.col("lo"))).alias("sequence_id"), F.col("at").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    parts = materialise(pieces(docs, capacity, end_id, tokenizer), "pieces")
    return pack(parts, capacity).drop("copy")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
