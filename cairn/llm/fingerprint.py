"""Document fingerprints: content-defined chunks, as sets weighted by length.

A text's UTF-8 bytes are cut where a gear hash over the last 32 bytes has
zeros in its top bits. Cutting is normalised: before the wanted chunk length
the stricter mask holds, after it the looser one, with a least and a greatest
length. Cuts follow content, so an insertion moves only the chunks it touches.
A fingerprint is the sorted set of ``digest48 << 16 | length`` of the chunks,
16 hex digits each; containment is the length-weighted share of one set found
in the other.

Defined cases: a null text is empty, an empty text has the empty fingerprint
(like another empty one 1.0, like any other text 0.0); null ids come last;
rows that share an id are ordered by text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._store import documents, small_batches, text_of

LEAST, WANTED, GREATEST = 12, 32, 128
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
GEAR = np.random.default_rng(20260101).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        if n > shift:
            later = h.copy()
            later[shift:] += h[:-shift] << np.uint32(shift)
            h = later
    at = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[at] & STRICT) == 0).tolist()
    ends, start = [], 0
    for end, is_strict in zip((at + 1).tolist(), strict, strict=True):
        while end - start > GREATEST:
            start += GREATEST
            ends.append(start)
        length = end - start
        if length >= WANTED or (is_strict and length >= LEAST):
            ends.append(end)
            start = end
    while n - start > GREATEST:
        start += GREATEST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> np.ndarray:
    """Sorted ``digest48 << 16 | length`` of the text's distinct chunks."""
    data = text.encode("utf-8", "surrogatepass")
    digest, view, start, found = xxhash.xxh3_64_intdigest, memoryview(data), 0, set()
    for end in boundaries(data):
        found.add(digest(view[start:end]) >> 16 << 16 | end - start)
        start = end
    return np.array(sorted(found), np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a``, by length, that ``b`` holds; two empty sets are alike."""
    if not len(a):
        return float(not len(b))
    low = np.uint64(0xFFFF)
    shared = np.intersect1d(a, b, assume_unique=True)
    return float((shared & low).sum() / (a & low).sum())


def as_hex(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([as_hex(chunk_set(t)) for t in texts], pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _blocks(docs: DataFrame, block_bytes: int, most: int) -> tuple[int, list[int], int | None]:
    """How many id ranges of about equal rows, their upper ids, and the greatest id."""
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows, size, top = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_of())), F.max(key)).first()
    wanted = min(most, max(12, -(-(size or 0) // block_bytes)), max(rows, 1))
    if wanted < 2:
        return 1, [], top
    cuts = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], max(10_000, 4 * wanted))).first()[0]
    bounds = sorted({c for c in cuts if c < top})
    return len(bounds) + 1, bounds, top


def _place(key: F.Column, bounds: list[int]) -> F.Column:
    """How many bounds lie below the key, by two short scans instead of a long one."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    coarse = below(F.array(*[F.lit(g[-1]) for g in groups]))
    fine = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.least(coarse + 1, F.lit(len(groups))))
    return F.least(coarse * step, F.lit(len(bounds))) + F.when(coarse < len(groups), below(fine)).otherwise(0)


def edited_pairs(docs: DataFrame, block_bytes: int = 8 << 20, most_blocks: int = 65_536) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is that with the next smaller id, after the smallest the
    greatest. Texts are exchanged once, to ranges of ids; only the first
    document of a range also goes to the range that precedes it.
    """
    small_batches(docs.sparkSession)
    n, bounds, top = _blocks(docs, block_bytes, most_blocks)
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    own = _place(key, bounds)
    guest = F.when(key == F.lit(top), F.lit(0)).when(own == n - 1, F.lit(None).cast("int")).otherwise(F.when(key == F.element_at(F.array(*map(F.lit, bounds or [0])), F.least(own + 1, F.lit(max(1, len(bounds))))), own + 1))
    rows = docs.select("doc_id", text_of().alias("text"), key.alias("key"), own.alias("own"), guest.cast("int").alias("guest"))
    rows = rows.select("doc_id", "text", "key", F.explode(F.array_compact(F.array(F.struct(F.col("own").alias("at"), F.lit(False).alias("visits")), F.when(F.col("guest").isNotNull(), F.struct(F.col("guest").alias("at"), F.lit(True).alias("visits")))))).alias("to"))
    dealt = rows.select("doc_id", "text", "key", "to.at", "to.visits").repartitionById(n, F.col("at").cast("int"))
    ordered = dealt.sortWithinPartitions("at", "visits", F.col("key").desc(), "text").select("doc_id", "text", "visits", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        first_visit = True
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, visits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if visits and not first_visit:
                    continue  # another row of the id that begins the next range
                first_visit = first_visit and not visits
                chunks = chunk_set(text)
                if held is not None:
                    out.append(_row(held, text, chunks))
                held = None if visits else (doc_id, text, chunks)
            if out:
                yield pa.RecordBatch.from_pylist(out, PAIRS)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


PAIRS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(held: tuple, following: str, following_chunks: np.ndarray) -> dict:
    doc_id, text, chunks = held
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_chunks = chunk_set(edited)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": as_hex(chunks), "edited_fingerprint": as_hex(edited_chunks),
        "near_edited": containment(chunks, edited_chunks), "near_next": containment(chunks, following_chunks),
    }


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
