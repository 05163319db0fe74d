"""N-gram Jaccard join by chosen paths.

A text is the set of its runs of five words (words are what white space parts,
A-Z as a-z), each run a 32-bit token. In every run of the join a set walks down
a tree: at each node it follows those of its tokens whose hash with the node
falls below ``1 / (threshold * size)``, so similar sets are likely to choose a
token that they share and dissimilar ones part. Nodes with few sets are
compared by brute force; larger ones are split a level deeper. Runs repeat
until pairs at the threshold meet with the wanted recall.

A candidate pair of a small node passes a size test and a sketch of 64 two-bit
minima (that a pair at the threshold fails once in some 10,000 times, in each
of the runs that meet it), and is then verified on the whole sets.

Sets that stay together to the last level are much alike, and more levels
would not part them. Nodes that share members are one dense group. In it every
pair of different sets is compared, exactly, as products of incidence matrices
of bounded blocks; of the links found only a spanning forest of each pair of
blocks leaves. A group's sets are exchanged once, to their blocks. A group of
many blocks writes them under ``spark.checkpoint.dir``, and a task for each
pair of blocks fetches its two: what is exchanged then is the pairs' numbers.
So rows and exchanges are linear in the sets; comparing, and fetching by
blocks, grows with the square of a group's different sets.

Verified links make components, by propagating the least label with pointer
jumping. Within each component all pairs are compared in the same way to count
the links, so those that the walk missed inside a component count too.

Nodes, labels and components that very many sets share reach their rows by
broadcast (at most 10,000 of them), so no task gathers one.

Equal sets are one class and are walked once. Texts without words are in no
class but their own. A text of one to four words is one run of all of them.

Defined cases: null text as empty; rows that share an id are judged each by
their text, equal rows are one; a null id keeps null and takes part by its text;
an empty table gives no rows; other columns are carried along by
``one_of_each``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._store import documents, fresh_names, fresh_path, materialise, small_batches, spread_join, text_of
from cairn.llm._words import alphabet, mix, shingles, words
from cairn.llm.warc import _file_system

BLACK = alphabet("black")
WIDTH = 5
SMALL_NODE = 24
DEPTH = 3
BLOCK_SETS, BLOCK_BYTES = 2048, 6 << 20
MOST_ROUNDS = 100


def runs_for(recall: float) -> int:
    """Runs in which a pair at the threshold meets with at least this chance, even if all levels are walked.

    A level keeps a pair with at least ``1 - exp(-kept below)``, as such a
    pair shares at least ``threshold`` of its larger set.
    """
    kept = 1.0
    for _ in range(DEPTH):
        kept = 1 - math.exp(-kept)
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def token_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, key, n, sketch, tokens``: a row for each document; equal sets have equal keys."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = (np.arange(64, dtype=np.uint64) << np.uint64(26)).astype(np.uint32)
        for batch in batches:
            keys, sizes, sketches, sets = [], [], [], []
            for found in words(batch.column(2), BLACK):
                hashes, bounds = shingles(found, WIDTH)
                tokens = (hashes >> np.uint64(32)).astype(np.uint32)
                for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                    own = np.unique(tokens[a:b])
                    raw = own.astype("<u4").tobytes()
                    keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                    sizes.append(len(own))
                    sets.append(raw)
                    if len(own):
                        first = own[np.minimum(np.searchsorted(own, bins), len(own) - 1)]  # a bin's least token, or that of the next bin that has one
                        two = (mix(first.astype(np.uint64)) & np.uint64(3)).astype(np.uint8).reshape(16, 4)
                        sketches.append((two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes())
                    else:
                        sketches.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "key", "n", "sketch", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, key binary, n int, sketch binary, tokens binary")


def _chosen(tokens: np.ndarray, node: int, threshold: float) -> np.ndarray:
    """The tokens that a set follows from a node."""
    mixed = (tokens ^ np.uint32(node & 0xFFFFFFFF)) * np.uint32((node >> 32 & 0xFFFFFFFF) | 1)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    mixed = (mixed ^ mixed >> np.uint32(12)) * np.uint32(0x297A2D39)
    mixed ^= mixed >> np.uint32(15)
    return tokens[mixed.astype(np.uint64) < np.uint64(min(2**32, int(2**32 / (threshold * len(tokens)))))]


def _roots(runs: int) -> list[int]:
    return mix(np.arange(1, runs + 1, dtype=np.uint64), 7).tolist()


STEP = "node long, key binary, n int, sketch binary, run int"
STEP_ARROW = pa.schema([("node", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("sketch", pa.binary()), ("run", pa.int32())])


def walk(sets: DataFrame, roots: list[int] | None, threshold: float) -> DataFrame:
    """One level: from the roots, or from each row's ``nodes array<struct<node, run>>``, to the chosen children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in ("key", "n", "sketch")}
            nodes = None if roots else batch.column("nodes").to_pylist()
            out_node, out_row, out_run = [], [], []
            for i in range(batch.num_rows):
                if not columns["n"][i]:
                    continue
                tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), "<u4")
                for number, node in enumerate(roots) if roots else ((x["run"], x["node"] & (1 << 64) - 1) for x in nodes[i]):
                    picked = _chosen(tokens, node, threshold)
                    if len(picked):
                        children = mix(picked.astype(np.uint64) ^ np.uint64(node), 11).view(np.int64)
                        out_node += children.tolist()
                        out_row += [i] * len(children)
                        out_run += [number] * len(children)
            yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), *(pa.array([columns[c][i] for i in out_row], STEP_ARROW.field(c).type) for c in ("key", "n", "sketch")), pa.array(out_run, pa.int32())], schema=STEP_ARROW)

    return sets.mapInArrow(run, STEP)


def _sketch_alike(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal two-bit minima."""
    differ = one ^ other
    odd = (differ | differ >> 1) & 0x55
    return 1 - np.unpackbits(odd, axis=-1).sum(-1) / 64


def _plausible(n1: np.ndarray, n2: np.ndarray, s1: np.ndarray, s2: np.ndarray, threshold: float) -> np.ndarray:
    """By size always; by sketch where both sets fill its bins."""
    size = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9
    chance = threshold + (1 - threshold) / 4
    return size & ((np.minimum(n1, n2) < 150) | (_sketch_alike(s1, s2) >= chance - 4 * math.sqrt(chance * (1 - chance) / 64)))


def _pairs_of_nodes(nodes: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs ``a < b`` of small nodes' members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                members = sorted({m["key"]: m for m in members}.values(), key=lambda m: m["key"])
                n = np.array([m["n"] for m in members])
                sketch = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), 16)
                i, j = np.triu_indices(len(members), 1)
                for k in np.flatnonzero(_plausible(n[i], n[j], sketch[i], sketch[j], threshold)).tolist():
                    a.append(members[i[k]]["key"])
                    b.append(members[j[k]]["key"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return nodes.mapInArrow(run, "a binary, b binary")


def _rep_sets(sets: DataFrame, keys: DataFrame, repeats: bool) -> DataFrame:
    """One row of ``sets`` for each of the written ``keys(key, rep, rep_hash, ...)``; ``repeats``: whether rows of equal id and text exist.

    Keys grow with the documents, so they are exchanged beside the sets at every
    size, never broadcast; a partition's keys are hashed, so the sets need no sort.
    """
    own = sets.filter("n > 0").select("key", "n", "sketch", "tokens", "doc_id", "text_hash")
    # the documents that stand for a set: each is one row, so no key gathers its copies
    chosen = keys.withColumnsRenamed({"key": "of", "rep": "doc_id", "rep_hash": "text_hash"})
    joined = own.join(chosen.hint("shuffle_hash"), own["doc_id"].eqNullSafe(chosen["doc_id"]) & (own["text_hash"] == chosen["text_hash"]))
    rows = joined.drop("doc_id", "text_hash", "of")
    return rows.dropDuplicates(["key"]) if repeats else rows


def candidates(sets: DataFrame, classes: DataFrame, threshold: float, recall: float, repeats: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Plausible pairs of different sets, met on some path; and for nodes that did not part, each member with one of its node."""
    runs = runs_for(recall)
    reps = classes.select("key", "rep", "rep_hash")
    found: DataFrame | None = None
    dense: DataFrame | None = None
    step = walk(sets.filter("n > 0"), _roots(runs), threshold)
    for level in range(1, DEPTH + 1):
        # copies of a set make equal rows, which are merged before the exchange
        step = materialise(step.groupBy("node", "key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("run").alias("run")), f"paths-{level}")
        sizes = materialise(step.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("weight", F.col("size")), f"sizes-{level}")
        met = materialise(spread_join(step, sizes, "node", "weight"), f"met-{level}")
        small = met.filter(F.col("size") <= SMALL_NODE).groupBy("node").agg(F.collect_list(F.struct("key", "n", "sketch")).alias("members")).select("members")
        pairs = _pairs_of_nodes(small, threshold)
        found = pairs if found is None else found.unionByName(pairs)
        large = met.filter(F.col("size") > SMALL_NODE)
        if large.isEmpty():
            break
        if level == DEPTH:
            first = materialise(large.groupBy("node").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("weight")), "firsts")
            dense = materialise(spread_join(large, first, "node", "weight").filter("key <> b").select(F.col("key").alias("a"), "b").distinct(), "dense")
            break
        open_ = large.groupBy("key").agg(F.collect_list(F.struct("node", "run")).alias("nodes")).join(reps, "key")
        step = walk(_rep_sets(sets, materialise(open_, f"open-{level}"), repeats), None, threshold)
    return materialise(found.distinct(), "candidates"), dense


def verified(pairs: DataFrame, needed: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets, whole, are as similar as asked."""
    one = needed.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    two = needed.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u4") for c in (2, 3))
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``key, comp`` for the ends of ``links(a, b)``: least labels by propagation and pointer jumping."""
    edges = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("comp"), F.count(F.lit(1)).alias("degree")), "labels")
    for _ in range(MOST_ROUNDS):
        told = labels.withColumnRenamed("key", "b")
        heard = spread_join(edges, told, "b", "degree").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("heard"))
        step = materialise(labels.join(heard, "key").select("key", "degree", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp")), "heard")
        sizes = step.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        jump = materialise(sizes.join(labels.select(F.col("key").alias("comp"), F.col("comp").alias("further")), "comp", "left"), "jumps")
        moved = materialise(spread_join(step, jump, "comp", "n").select("key", "degree", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        labels = moved.drop("old")
        if moved.filter("old != comp").isEmpty():
            return labels.drop("degree")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


MEMBERS = pa.schema([("key", pa.binary()), ("texts", pa.int64()), ("tokens", pa.binary())])


def compare_within(members: DataFrame, threshold: float, token: str = "<u4") -> DataFrame:
    """All pairs of each group of ``members(comp, key, tokens, texts)``, in blocks; ``token`` is how a token is held.

    Rows ``key, other, links``: with ``other`` null, how many texts of one other
    block the key is linked to; else a link of the pair of blocks' forest.
    """
    spark = members.sparkSession
    members = materialise(members, "members", "none")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("tokens")).alias("bytes"))
    blocks = materialise(sizes.select("comp", "m", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "blocks")
    dealt = spread_join(members, blocks, "comp", "m").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int"))
    sorted_ = dealt.select("comp", "own", "blocks", "key", "texts", "tokens").repartition("comp", "own").sortWithinPartitions("comp", "own")
    folder = fresh_path(spark, "blocks")
    schema = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("comp", pa.binary()), ("block", pa.int32()), ("path", pa.string())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block at a time: compared if it is its group's only one, else written."""
        group, held = None, []

        def done() -> pa.RecordBatch:
            if group[2] == 1:
                rows = [(*r, None, None, None) for r in _compared(held, held, True, threshold, token)]
            else:
                fs, root = _file_system(folder)
                fs.create_dir(root, recursive=True)
                name = f"{group[0].hex()}-{group[1]}-{TaskContext.get().taskAttemptId()}.arrow"
                table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), MEMBERS, strict=True)], schema=MEMBERS)
                with fs.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, MEMBERS) as writer:
                    writer.write_table(table)
                rows = [(None, None, None, group[0], group[1], f"{folder}/{name}")]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("comp", "own", "blocks", "key", "texts", "tokens")]
            for comp, own, blocks_, *member in zip(*columns, strict=True):
                if (comp, own, blocks_) != group:
                    if held:
                        yield done()
                    group, held = (comp, own, blocks_), []
                held.append(tuple(member))
        if held:
            yield done()

    met = materialise(sorted_.mapInArrow(gather, "key binary, other binary, links long, comp binary, block int, path string"), "block-links")
    found = met.filter("comp IS NULL").select("key", "other", "links")
    written = met.filter("comp IS NOT NULL").select("comp", "block", "path")
    if written.isEmpty():
        return found

    def fetch(path: str) -> list[tuple]:
        fs, name = _file_system(path)
        with fs.open_input_stream(name) as file, pa.ipc.open_stream(file) as reader:
            return list(zip(*(c.to_pylist() for c in reader.read_all().columns), strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = fetch(one)
                rows = _compared(first, first if one == other else fetch(other), one == other, threshold, token)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(3)], schema=pa.schema([schema.field(c) for c in range(3)]))

    right = written.withColumnsRenamed({"block": "other_block", "path": "other_path"})
    pairs = written.join(right, "comp").filter("block <= other_block").select("path", "other_path")  # a row for each pair of blocks
    return found.unionByName(pairs.repartition("path", "other_path").mapInArrow(compare, "key binary, other binary, links long"))


def _shared(one: list[np.ndarray], other: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over ranges of the tokens that several sets hold."""
    rows1, rows2 = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, other))
    all1, all2 = np.concatenate(one), np.concatenate(other)
    common = np.intersect1d(all1, all2)
    out = np.zeros((len(one), len(other)), np.float32)
    at1, at2 = np.searchsorted(common, all1), np.searchsorted(common, all2)
    ok1, ok2 = (common[np.minimum(at, max(0, len(common) - 1))] == x if len(common) else np.zeros(len(x), bool) for at, x in ((at1, all1), (at2, all2)))
    rows1, at1, rows2, at2 = rows1[ok1], at1[ok1], rows2[ok2], at2[ok2]
    for low in range(0, len(common), columns):
        width = min(columns, len(common) - low)
        m1, m2 = np.zeros((len(one), width), np.float32), np.zeros((len(other), width), np.float32)
        in1, in2 = (at1 >= low) & (at1 < low + width), (at2 >= low) & (at2 < low + width)
        m1[rows1[in1], at1[in1] - low] = 1
        m2[rows2[in2], at2[in2] - low] = 1
        out += m1 @ m2.T
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links, as ``(row, column)``, that connect whatever all links of a block pair connect."""
    rows, columns, out = np.zeros(len(linked), bool), np.zeros(linked.shape[1], bool), []
    for first in np.flatnonzero(linked.any(axis=1)).tolist():
        if rows[first]:
            continue
        rows[first], open_ = True, [(True, first)]
        while open_:
            is_row, at = open_.pop()
            line, seen = (linked[at], columns) if is_row else (linked[:, at], rows)
            fresh = np.flatnonzero(line & ~seen).tolist()
            seen[fresh] = True
            out += [(at, k) if is_row else (k, at) for k in fresh]
            open_ += [(not is_row, k) for k in fresh]
    return out


def _compared(first: list[tuple], second: list[tuple], same: bool, threshold: float, token: str = "<u4") -> list[tuple]:
    """Rows ``(key, other, links)`` of a pair of blocks of ``(key, texts, tokens)``."""
    one, two = ([np.frombuffer(h[2], token) for h in block] for block in (first, second))
    shared = _shared(one, two)
    n1, n2 = np.array([len(x) for x in one], np.float64)[:, None], np.array([len(x) for x in two], np.float64)[None, :]
    linked = shared >= threshold * (n1 + n2 - shared) - 1e-3
    if same:
        np.fill_diagonal(linked, False)
    weigh = lambda matrix, other: (matrix.astype(np.float32) @ np.array([h[1] for h in other], np.float64)).astype(np.int64).tolist()
    out = [(h[0], None, n) for h, n in zip(first, weigh(linked, second), strict=True)]
    if not same:
        out += [(h[0], None, n) for h, n in zip(second, weigh(linked.T, first), strict=True)]
    # a block's rows are its own columns, so there each set stands for itself on both sides
    tied = linked | np.eye(len(first), dtype=bool) & linked.any(axis=1)[:, None] if same else linked
    return out + [(first[r][0], second[c][0], None) for r, c in _forest(tied) if first[r][0] != second[c][0]]


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995, count_links: bool = True) -> DataFrame:
    """``doc_id, text_hash, class_id, copy_of, n_links`` of every row.

    ``class_id``: least id of the component. ``copy_of``: least id with an equal
    set. ``n_links``: how many different texts it is linked to.
    """
    return _classified(docs, threshold, recall, count_links).drop("comp")


def _classified(docs: DataFrame, threshold: float, recall: float, count_links: bool) -> DataFrame:
    """As ``join``, with ``comp``, the key of the component; null for texts without words."""
    sets = materialise(token_sets(docs), "token-sets", "none")
    texts = sets.filter("n > 0").groupBy("key", "text_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(texts.groupBy("key").agg(F.min("id").alias("rep"), F.min_by("text_hash", F.struct(F.coalesce("id", F.lit(2**63 - 1)), "text_hash")).alias("rep_hash"), F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies")), "classes")
    repeats = not sets.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    pairs, dense = candidates(sets, classes, threshold, recall, repeats)
    met = pairs if dense is None else pairs.unionByName(dense)
    ends = met.select(F.col("a").alias("key")).unionByName(met.select(F.col("b").alias("key"))).distinct()
    needed = materialise(_rep_sets(sets, materialise(ends.join(classes.drop("copies"), "key"), "ends"), repeats), "needed-sets", "none")
    links = verified(pairs, needed, threshold)
    if dense is not None:
        found = compare_within(components(dense).join(needed, "key").select("comp", "key", "tokens", "texts"), threshold)
        links = links.unionByName(found.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = materialise(links.distinct(), "links")
    comps = components(links)
    if count_links:
        counts = compare_within(comps.join(needed, "key").select("comp", "key", "tokens", "texts"), threshold).filter("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    else:
        counts = comps.select("key", F.lit(1).cast("long").alias("links"))
    named = materialise(comps.join(classes.select("key", "rep"), "key").join(counts, "key"), "named")
    heads = materialise(named.groupBy("comp").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("m")), "heads")
    found = materialise(spread_join(named, heads, "comp", "m").select("key", "comp", "class_id", "links"), "classes-found")
    known = materialise(classes.select("key", F.col("rep").alias("copy_of"), "texts", "copies").join(found, "key", "left"), "known")
    rows = spread_join(sets.select("doc_id", "text_hash", "key", "n"), known, "key", "copies", "left")
    alone = F.col("n") == 0
    return rows.select(
        "doc_id", "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class_id", "copy_of")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("texts") - 1).cast("long").alias("n_links"),
        F.when(~alone, F.coalesce("comp", "key")).alias("comp"),
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """``docs`` with one row of each component, that with the least id (null last) and of those the least text hash.

    Texts without words are in none: each id keeps one of each, null ids all.
    """
    found = _classified(docs, threshold, recall, count_links=False)
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    own = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(first).alias("k")).select("k.doc_id", "k.text_hash", F.lit(False).alias("all"))
    alone = found.filter("comp IS NULL").select("doc_id", "text_hash", F.col("doc_id").isNull().alias("all")).distinct()
    id_, hash_, own_hash, every = fresh_names(docs, "id", "hash", "own_hash", "every")
    kept = materialise(own.unionByName(alone), "kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("all").alias(every))
    numbered = docs.withColumn(own_hash, F.xxhash64(text_of()))
    chosen = numbered.join(kept, numbered["doc_id"].cast("long").eqNullSafe(kept[id_]) & (numbered[own_hash] == kept[hash_])).drop(id_, hash_)
    once = chosen.filter(~F.col(every)).dropDuplicates(["doc_id", own_hash])
    return once.unionByName(chosen.filter(every)).drop(own_hash, every)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_of", "n_links")
