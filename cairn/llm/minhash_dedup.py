"""Near copies by SuperMinHash signatures, banding, verification and union-find.

A text is the set of its runs of two words (words are what white space parts,
A-Z as a-z), each run a 64-bit hash. Every element walks its own random
permutation of the signature's places: in round ``j`` it offers ``j`` plus a
random fraction to the ``j``-th place of its permutation, and a place keeps its
least offer. As an element gives each place another round, offers of one
element are correlated and estimates vary less than with independent hashes. A
round can only fill places that are empty, so a text stops as soon as none is:
long texts after one or two rounds.

Signatures are cut into bands; sets that agree on a whole band share its
bucket. Pairs at the threshold miss all 25 bands of 5 with a chance of 1 in
20,000. No bucket emits its pairs:

1. each member is compared with its bucket's leader, the least key, so a
   bucket of near copies costs one comparison a member;
2. the links found make components, and a bucket within one component is done;
3. of what is left, small buckets compare members across components, and large
   ones join into dense groups that are compared in blocks, as in the n-gram
   Jaccard join. So links that no leader shows are found as well.

Every link is confirmed on the whole sets, taken from the texts. Components are
unions of links by least labels with pointer jumping. Leaders and components
that very many sets share are salted or broadcast, so no task gathers one.

Defined cases: null text as empty; a text without words is in no group but its
own; one word is one run; rows that share an id are judged each by their text; a
null id keeps null as component only if no member has an id, and is kept only
then; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._store import documents, materialise, small_batches, spread_join, text_of
from cairn.llm._words import mix, shingles, words
from cairn.llm.jaccard_join import BLACK, compare_within, components

WIDTH = 2
BANDS, BAND_ROWS = 25, 5
SMALL_BUCKET = 24
#: Comparisons with one set that are made in one task; beyond, its text goes to several.
PER_SALT = 1000
#: Elements whose permutations are held at a time.
WALKING = 1 << 16


def unique_runs(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of texts: the first one's number, the sorted different runs of all, and their bounds by text."""
    for found in words(texts, BLACK):
        runs, bounds = shingles(found, width)
        owner = np.repeat(np.arange(len(found)), np.diff(bounds))
        order = np.lexsort((runs, owner))
        runs, owner = runs[order], owner[order]
        if len(runs):
            fresh = np.append(True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1]))
            runs, owner = runs[fresh], owner[fresh]
        yield found.first, runs, np.searchsorted(owner, np.arange(len(found) + 1))


def _offers(elements: np.ndarray, j: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Of round ``j``: each element's fraction, in 32 bits, and which later position its permutation swaps in."""
    drawn = mix(elements, j + 1)
    return drawn >> np.uint64(32), (j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64))


EMPTY = np.uint64((1 << 64) - 1)


def signatures(elements: np.ndarray, bounds: np.ndarray, places: int = BANDS * BAND_ROWS) -> np.ndarray:
    """A row of ``places`` least offers, ``round << 32 | fraction``, for each set between the bounds; of an empty set nothing is offered."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((len(sizes), places), EMPTY, np.uint64)
    fraction, at = _offers(elements, 0, places)  # in the first round a permutation is still the identity
    np.minimum.at(out.reshape(-1), owner * places + at, fraction)
    open_ = np.flatnonzero((out == EMPTY).any(axis=1) & (sizes > 0))
    low = 0
    while low < len(open_):
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[open_[low:]]), WALKING, "right")))
        _walk(elements, bounds, open_[low:high], out)
        low = high
    return out


def _walk(elements: np.ndarray, bounds: np.ndarray, sets: np.ndarray, out: np.ndarray) -> None:
    """The rounds after the first, for sets with empty places, until they have none."""
    places = out.shape[1]
    sizes = bounds[sets + 1] - bounds[sets]
    own = elements[np.repeat(bounds[sets] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
    row = np.repeat(sets, sizes)
    order = np.tile(np.arange(places, dtype=np.min_scalar_type(places)), (len(own), 1))
    every = np.arange(len(own))
    first = _offers(own, 0, places)[1]
    order[every, 0], order[every, first] = first, 0
    for j in range(1, places):
        fraction, swapped = _offers(own, j, places)
        every = np.arange(len(own))
        place = order[every, swapped].astype(np.int64)
        order[every, swapped] = order[:, j]
        order[:, j] = place
        flat = row * places + place
        filled = out.reshape(-1)
        fresh = (filled[flat] >> np.uint64(32)) >= np.uint64(j)  # filled in this round, or empty
        np.minimum.at(filled, flat[fresh], np.uint64(j << 32) | fraction[fresh])
        unfinished = (out[sets] == EMPTY).any(axis=1)
        if not unfinished.all():
            sets = sets[unfinished]
            if not len(sets):
                return
            kept = np.isin(row, sets)
            own, row, order = own[kept], row[kept], order[kept]


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash of each band, and of its number, by set."""
    cut = signature.reshape(len(signature), bands, -1)
    h = mix(np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2]), 3)
    for k in range(cut.shape[2]):
        h = mix(h ^ cut[:, :, k], 5)
    return h


SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signed_sets(docs: DataFrame, bands: int = BANDS, band_rows: int = BAND_ROWS, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_hash, key, n, bands``: a row for each document; equal sets have equal keys, empty ones no bands."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, own = [], [], []
            for _, runs, bounds in unique_runs(batch.column(2), width):
                own.append(band_hashes(signatures(runs, bounds, bands * band_rows), bands).view(np.int64))
                sizes.append(np.diff(bounds))
                keys += [hashlib.blake2b(runs[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            flat = np.concatenate(own)[n > 0].reshape(-1) if own else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), lists], schema=SETS_ARROW)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, key binary, n long, bands array<long>")


def _plausible(n: Column, other: Column, threshold: float) -> Column:
    """Sets of these sizes can be as similar as asked."""
    return F.least(n, other) >= threshold * F.greatest(n, other) - 1e-9


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, n, text`` of the sets in ``wanted(key, n, rep, rep_hash)``, each by the document that stands for it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    joined = rows.join(wanted.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(wanted["rep"]) & (rows["text_hash"] == wanted["rep_hash"]))
    return joined.select("key", "n", "text").dropDuplicates(["key"])


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """The written ``pairs(a, b)`` whose whole sets are as similar as asked; many pairs of one ``b`` are dealt to several tasks."""
    counts = materialise(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("weight")).withColumn("salts", F.ceil(F.col("weight") / PER_SALT).cast("int")), "pair-counts")
    salted = spread_join(pairs, counts, "b", "weight").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts").cast("long")).cast("int")).drop("salts")
    one = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")).join(counts, "b")
    two = two.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "text_b")

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, runs, bounds in unique_runs(column, width):
            out += [runs[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = lambda x, y: len(np.intersect1d(x, y, assume_unique=True))
            ones, others = sets(batch.column(2)), sets(batch.column(3))
            near = [(s := shared(x, y)) >= threshold * (len(x) + len(y) - s) - 1e-9 for x, y in zip(ones, others, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = salted.join(one, "a").join(two, ["b", "salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def across(buckets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of plausible sizes and different components in each small bucket of ``buckets(band, key, n, comp)``."""
    pairs = F.expr(f"""
        flatten(transform(members, (x, i) -> transform(
            filter(slice(members, i + 2, {SMALL_BUCKET}), y -> y.comp <> x.comp AND least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-9),
            y -> struct(x.key AS a, y.key AS b))))
    """)
    grouped = buckets.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("key", "n", "comp"))).alias("members"))
    return grouped.select(F.inline(pairs)).distinct()


def dense_links(buckets: DataFrame, texts: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """Links of a spanning forest of each group of overlapping large buckets ``(band, key)``, compared whole in blocks."""
    firsts = materialise(buckets.groupBy("band").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("weight")), "dense-firsts")
    tied = materialise(spread_join(buckets.select("band", "key"), firsts, "band", "weight").filter("key <> b").select(F.col("key").alias("a"), "b").distinct(), "dense")
    schema = pa.schema([("comp", pa.binary()), ("key", pa.binary()), ("tokens", pa.binary()), ("texts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for _, runs, bounds in unique_runs(batch.column(2), width):
                tokens += [runs[a:b].astype("<u8").tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.binary()), pa.array([1] * len(tokens), pa.int64())], schema=schema)

    members = components(tied).join(texts, "key").select("comp", "key", "text").mapInArrow(run, "comp binary, key binary, tokens binary, texts long")
    return compare_within(members, threshold, "<u8").filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))


def near_links(docs: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """``key, comp``: components of the sets that are linked with another."""
    held = materialise(sets.select(F.explode("bands").alias("band"), "key", "n").distinct(), "bands")
    leaders = held.groupBy("band").agg(F.min(F.struct("key", "n")).alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = materialise(spread_join(held, materialise(leaders.withColumn("weight", F.col("size")), "leaders"), "band", "weight"), "met")
    wanted = met.select("key").distinct().join(classes, "key").select("key", "n", "rep", "rep_hash")
    texts = materialise(texts_of(docs, wanted), "texts")
    stars = met.filter((F.col("key") != F.col("leader.key")) & _plausible(F.col("n"), F.col("leader.n"), threshold)).select(F.col("key").alias("a"), F.col("leader.key").alias("b"))
    links = materialise(confirmed(materialise(stars.distinct(), "stars"), texts, threshold, width), "star-links")
    comps = components(links)
    placed = materialise(met.select("band", "key", "n", "size").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "placed")
    open_ = placed.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("weight")).filter("least <> most").select("band", "weight")
    rest = materialise(spread_join(placed, materialise(open_, "open"), "band", "weight"), "rest")
    small, large = rest.filter(F.col("size") <= SMALL_BUCKET), rest.filter(F.col("size") > SMALL_BUCKET)
    more = None
    if not small.isEmpty():
        more = materialise(confirmed(materialise(across(small, threshold), "across"), texts, threshold, width), "across-links")
    if not large.isEmpty():
        dense = materialise(dense_links(large, texts, threshold, width), "dense-links")
        more = dense if more is None else more.unionByName(dense)
    return comps if more is None or more.isEmpty() else components(links.unionByName(more).distinct())


def groups(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, band_rows: int = BAND_ROWS, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` of every row."""
    sets = materialise(signed_sets(docs, bands, band_rows, width), "signed-sets")
    own = sets.filter("n > 0")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "text_hash")
    classes = own.groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min_by("text_hash", order).alias("rep_hash"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    comps = near_links(docs, own, classes, threshold, width)
    named = materialise(comps.join(classes.select("key", "rep"), "key"), "named")
    heads = materialise(named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m")), "heads")
    found = materialise(spread_join(named, heads, "comp", "m").select("key", "component_id"), "found")
    known = classes.join(found.withColumnRenamed("component_id", "joined"), "key", "left")
    known = materialise(known.select("key", F.coalesce("joined", "rep").alias("component_id"), "copies"), "known")
    rows = spread_join(sets.select("doc_id", "text_hash", "key", "n"), known, "key", "copies", "left")
    # texts without words share a key that is no class
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).drop("text_hash")


#: Every pair that shares a run, and every path of links; shares no step with the plan above.
OP12_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), run AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS run
  FROM doc
), size AS (
  SELECT doc_id, count(*) AS n FROM run GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM run a JOIN run b USING (run) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)
), reach(doc_id, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.doc_id WHERE reach.low < link.b
), least AS (
  SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN least USING (doc_id)
"""
