"""Token-id output in training order: a keyed permutation, range partitions, fixed-stride shards.

All documents in order of ``(doc_id, hash of the text)``, each as its ids and an
end mark, are one stream, cut into sequences of ``length`` ids; only the last
one may be shorter. Where a document begins in the stream follows from the
lengths of those before it, so sequences and slots depend on the documents and
the key alone, not on files, partitions or reruns. Sequences are numbered along
the stream, and a Feistel network keyed by ``seed`` permutes the numbers: the
least even number of bits that holds them all, walked along its cycle until it
falls below their count. So slots have no gaps, and another key gives another
epoch's order.

Texts are encoded where they are scanned and exchanged once, as ids, to ranges
of the order, which are written. From there each document's share of each
sequence goes to the sequence's slot. Slots are range-partitioned, a shard to a
task, and written in order with a fixed stride, in ``waves`` over ranges of
shards so that only one wave's exchange is on disk at a time. A shard is a
64-byte header (magic, id bytes, length, first slot, sequences) and per slot a
4-byte count and ``length`` ids, padded with the end mark; any slot is read by
one seek, and reading on resumes an interrupted run. Files are named by attempt;
only the manifest that finished tasks return tells which are valid.

Defined cases: null and empty texts are an end mark alone; a null id sorts first
and is kept; rows that repeat are all written, equal ones in either order; an
empty table has no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._store import documents, fresh_path, materialise, small_batches, text_of
from cairn.llm._tokens import Encoder
from cairn.llm._words import mix
from cairn.llm.packing import tokenizer_path
from cairn.llm.sharding import LOW, place
from cairn.llm.warc import _file_system

MAGIC = b"CAIRNTOK"
HEADER = "<8sIIQQ32x"
HEADER_BYTES = struct.calcsize(HEADER)


def encoded(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, part_bytes: int = 16 << 20) -> DataFrame:
    """``part, at, doc_id, n, ids``, written in the stream's order: ``at`` is how many ids of its part precede the document; ``ids`` are compressed."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = Encoder.of(path), zstandard.ZstdCompressor(level=6)
        for batch in batches:
            sizes, packed = [], []
            for ids, bounds in encoder.encode(batch.column(2).to_pylist()):
                for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                    sizes.append(b - a + 1)
                    packed.append(pack.compress(np.append(ids[a:b], np.uint32(end_id)).astype(encoder.dtype).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "text_hash", "n", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = done + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes), *batch.columns], ["part", "at", "doc_id", "n", "ids"])
            done = int(ends[-1]) if len(ends) else done

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    # the ranges come from the keys alone: taking them from encoded rows would encode twice
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    keys = rows.select(F.coalesce("doc_id", F.lit(LOW)).alias("i"), F.col("text_hash").alias("h")).repartitionByRange(parts, "i", "h")
    tops = keys.groupBy(F.spark_partition_id()).agg(F.max(F.struct("i", "h")).alias("top")).select("top.*").orderBy("i", "h").collect()  # a row for each range
    at = place([tuple(t) for t in tops[:-1]], "coalesce(doc_id, (-9223372036854775807L - 1L))", "text_hash").cast("int")
    made = rows.mapInArrow(encode, "doc_id long, text_hash long, n long, ids binary")
    ranged = made.repartitionById(max(1, len(tops)), at).sortWithinPartitions("doc_id", "text_hash").select("doc_id", "n", "ids")
    return materialise(ranged.mapInArrow(count, "part int, at long, doc_id long, n long, ids binary"), "encoded", "none")


def permuted(numbers: np.ndarray, count: int, seed: int, rounds: int = 6) -> np.ndarray:
    """The slots of ``numbers`` among ``count``."""
    half = np.uint64(max(1, ((max(1, count - 1)).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    slots = numbers.astype(np.uint64)
    walking = np.arange(len(slots))
    while len(walking):
        left, right = slots[walking] >> half, slots[walking] & low
        for k in range(rounds):
            left, right = right, left ^ (mix(right, seed * rounds + k + 1) & low)
        slots[walking] = left << half | right
        walking = walking[slots[walking] >= np.uint64(count)]
    return slots.astype(np.int64)


def placed(table: DataFrame) -> tuple[DataFrame, int]:
    """``encoded()`` with ``start``, a document's place in the whole stream, and the stream's length."""
    sizes = table.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each range
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["n"]
    bases = table.sparkSession.createDataFrame(starts, "part int, base long")
    return table.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("at")).drop("base", "part", "at"), total


def shares(docs: DataFrame, count: int, length: int, seed: int) -> DataFrame:
    """``number, slot, doc_id, from`` of each document in each sequence: ``from`` is its place there."""
    ends = ((F.col("start") + F.col("n") - 1) / length).cast("long")
    rows = docs.select("start", "doc_id", F.explode(F.sequence((F.col("start") / length).cast("long"), ends)).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("slot", pa.array(permuted(batch.column("number").to_numpy(), count, seed)))

    return rows.select("number", "doc_id", F.greatest(F.lit(0), F.col("start") - F.col("number") * length).alias("from")).mapInArrow(run, "number long, doc_id long, from long, slot long")


def write_shards(table: DataFrame, length: int = 1024, shard_rows: int = 32_768, seed: int = 1, waves: int = 2, end_id: int = 2, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes ``encoded()`` in slot order; the manifest ``path, shard, first_slot, rows, stride``, and ``shares``."""
    spark = table.sparkSession
    small_batches(spark)
    docs, total = placed(table)
    count = -(-total // length)
    shards = -(-count // shard_rows)
    folder, dtype = fresh_path(spark, "shards"), np.dtype(Encoder.of(tokenizer or tokenizer_path()).dtype)
    schema = pa.schema([("path", pa.string()), ("shard", pa.int64()), ("first_slot", pa.int64()), ("rows", pa.int64()), ("stride", pa.int64())])
    pieces = pa.schema([("slot", pa.int64()), ("from", pa.int32()), ("ids", pa.binary())])

    def cut(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Documents to their shares of the sequences with slots in a range."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()
            for batch in batches:
                starts, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                first = starts // length
                many = (starts + sizes - 1) // length - first + 1
                owner = np.repeat(np.arange(len(starts)), many)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
                slot = permuted(number, count, seed)
                mine = np.flatnonzero((slot >= low) & (slot < high))
                at, held, ids, out = -1, None, batch.column(2), ([], [], [])
                for k, d, n, s in zip(mine.tolist(), owner[mine].tolist(), number[mine].tolist(), slot[mine].tolist(), strict=True):
                    if d != at:
                        at, held = d, unpack.decompress(ids[d].as_buffer())
                    a = max(0, n * length - int(starts[d]))
                    b = min(int(sizes[d]), (n + 1) * length - int(starts[d]))
                    out[0].append(s)
                    out[1].append(int(starts[d]) + a - n * length)
                    out[2].append(held[a * dtype.itemsize : b * dtype.itemsize])
                    if len(out[0]) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, pieces, strict=True)], schema=pieces)
                        out = ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, pieces, strict=True)], schema=pieces)

        return run

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stride, out, begun, slot, held = 4 + length * dtype.itemsize, None, 0, None, []

        def close() -> None:
            own = b"".join(held)
            n = len(own) // dtype.itemsize
            if n != min(length, total - length * (count - 1)) and n != length:
                raise ValueError(f"slot {slot} has {n} ids")
            out.write(struct.pack("<I", n) + own + np.full(length - n, end_id, dtype).tobytes())

        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != slot:
                    if out is None:
                        begun = at
                        fs, root = _file_system(folder)
                        fs.create_dir(root, recursive=True)
                        name = f"shard-{at // shard_rows:08d}-{task.taskAttemptId()}.bin"
                        out = fs.open_output_stream(f"{root}/{name}")
                        out.write(struct.pack(HEADER, MAGIC, dtype.itemsize, length, at, min(shard_rows, count - at)))
                    else:
                        close()
                        if at != slot + 1:
                            raise ValueError(f"slot {slot + 1} is missing before {at}")
                    slot, held = at, []
                held.append(ids)
        if out is not None:
            close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "shard": begun // shard_rows, "first_slot": begun, "rows": slot + 1 - begun, "stride": stride}], schema)

    manifest = None
    waves = max(1, min(waves, shards))
    for w in range(waves):
        low, high = shards * w // waves, shards * (w + 1) // waves
        own = docs.select("start", "n", "ids").mapInArrow(cut(low * shard_rows, high * shard_rows), "slot long, from int, ids binary")
        dealt = own.repartitionById(max(1, high - low), (F.col("slot") / shard_rows).cast("int") - low).sortWithinPartitions("slot", "from")
        part = materialise(dealt.mapInArrow(write, "path string, shard long, first_slot long, rows long, stride long"), "shard-manifest")
        manifest = part if manifest is None else manifest.unionByName(part)
    return manifest, shares(docs, count, length, seed)


def read_shard(path: str, start: int = 0, rows: int | None = None, at_once: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """``(slot, ids)`` from the ``start``-th sequence of a shard on: one seek, then sequential."""
    fs, name = _file_system(path)
    with fs.open_input_file(name) as file:
        magic, width, length, first, held = struct.unpack(HEADER, file.read(HEADER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        stride, stop = 4 + length * width, held if rows is None else min(held, start + rows)
        file.seek(HEADER_BYTES + start * stride)
        for k in range(start, stop, at_once):
            raw = memoryview(file.read(min(at_once, stop - k) * stride))
            for i in range(len(raw) // stride):
                (n,) = struct.unpack_from("<I", raw, i * stride)
                yield first + k + i, np.frombuffer(raw, f"<u{width}", n, i * stride + 4)


def read_shards(manifest: DataFrame) -> DataFrame:
    """``slot, shard, row, n_tokens, ids_crc32`` of every sequence, as read from the files."""
    small_batches(manifest.sparkSession)
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shard, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = [(slot, shard, slot - first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for slot, ids in read_shard(path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = max(1, manifest.count())
    return manifest.select("path", "shard", "first_slot").repartition(files).mapInArrow(run, "slot long, shard long, row long, n_tokens int, ids_crc32 long")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as its shard holds it, with the documents it is from."""
    manifest, held = write_shards(encoded(documents(spark, sf_dir)))
    # a sequence holds at most as many documents as ids
    owners = held.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("from", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    return read_shards(manifest).join(owners, "slot").select("slot", "shard", "row", "n_tokens", "ids_crc32", "doc_ids")
