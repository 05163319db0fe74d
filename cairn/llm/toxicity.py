"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A document is a bag of sentences. Each sentence with known evidence (words and
beginnings of words that tell labelled documents apart) has a logistic score;
the document's score is a leaky noisy-or of its sentences' scores, so one
offending sentence suffices, and sentences without evidence add nothing however
many there are. Weights are trained on document labels through the noisy-or;
the offending sentences are then those whose own score is high.

Learning reads a bounded sample: whole labelled documents in order of a hash of
their id, at most ``Training.most_docs`` of them and ``Training.most_bytes`` of
text; scoring reads all documents, whole.

Defined cases: null and empty texts have no evidence and score the leak; a null
label is no label, a null id has none and is held out, of several labels of one
id the greatest holds, of several texts the least; without both
labels in the sample every score is the share of label 1; other columns are
ignored, and rows that repeat are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm._store import documents, small_batches, text_of
from cairn.llm._words import Words, alphabet, words

ALNUM = alphabet("alnum")
PREFIXES = (5, 6, 7, 8)
STOPS = np.isin(np.arange(256), [*b".!?\n"])


@dataclass
class Training:
    most_docs: int = 4_000
    most_bytes: int = 64 << 20
    most_features: int = 4_096
    least_docs: int = 4
    least_z: float = 4.5
    decay: float = 2e-4
    rounds: int = 400


@dataclass
class Model:
    """``keys``: sorted feature hashes. ``bias``: of a sentence with evidence. ``leak``: chance of label 1 without any."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True


def features(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and feature hashes: whole words, then beginnings of longer ones."""
    yield np.arange(len(found.hashes)), found.hashes
    for size in PREFIXES:
        yield found.prefix_hashes(size)


def sentence_numbers(found: Words) -> np.ndarray:
    """For each word, how many sentence ends precede it in the slice."""
    stops = STOPS[found.data]
    stops[found.offsets[1:-1][found.offsets[1:-1] < len(found.data)] - 1] = True  # a text ends its last sentence
    return np.concatenate([[0], np.cumsum(stops)])[found.starts]


def evidence(found: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the known features that occur: text number in the slice, sentence number, feature number."""
    at, which = [], []
    for numbers, hashes in features(found):
        some = np.flatnonzero(model.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(model.keys, hashes[some])
        place[place == len(model.keys)] = 0
        ok = model.keys[place] == hashes[some] if len(model.keys) else np.zeros(len(some), bool)
        at.append(numbers[some[ok]])
        which.append(place[ok])
    at, which = np.concatenate(at), np.concatenate(which)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.searchsorted(found.bounds, at, "right") - 1, sentence_numbers(found)[at], which


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, how: Training | None = None) -> Model:
    """From labelled rows whose ``crc32(doc_id as text) % 5`` is not 0."""
    how = how or Training()
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.most_docs)
    )
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sizes = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over most_docs rows at most
    sample = sample.withColumn("bytes", F.sum(F.octet_length("text")).over(sizes)).filter(F.col("bytes") <= how.most_bytes).toArrow()
    return fit(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy(), how)


def held_out(column: str):
    """Whether the remainder is 0; a null id, which no label can name, is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(texts: pa.Array, label: np.ndarray, how: Training) -> Model:
    """Choose features by how far their documents' labels are from chance, then descend on the noisy-or's likelihood."""
    label = label.astype(np.float64)
    rate = float(label.mean()) if len(label) else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -4.0, rate)
    if rate in (0.0, 1.0):
        return none
    key_parts, count_parts, positive_parts = [], [], []
    for found in words(texts, ALNUM):
        owner = np.repeat(np.arange(len(found)), np.diff(found.bounds))
        pairs = np.unique(np.rec.fromarrays([np.concatenate([h for _, h in features(found)]), np.concatenate([owner[n] for n, _ in features(found)])], names="h,d"))
        keys, first, counts = np.unique(pairs.h, return_index=True, return_counts=True)
        key_parts.append(keys)
        count_parts.append(counts)
        positive_parts.append(np.add.reduceat(label[found.first + pairs.d], first) if len(first) else np.zeros(0))
    keys, place = np.unique(np.concatenate(key_parts), return_inverse=True)
    counts, positive = np.bincount(place, np.concatenate(count_parts)), np.bincount(place, np.concatenate(positive_parts))
    share = counts / len(label)
    z = (positive - counts * rate) / np.sqrt(np.maximum(counts * rate * (1 - rate) * (1 - np.minimum(share, 0.999)), 1e-9))
    fit_for = np.flatnonzero((counts >= how.least_docs) & (z >= how.least_z))
    fit_for = fit_for[np.argsort(-z[fit_for], kind="stable")[: how.most_features]]
    if not len(fit_for):
        return none
    model = Model(np.sort(keys[fit_for]), np.zeros(len(fit_for)), -2.0, rate / 4)
    doc, sentence, which, base = [], [], [], 0
    for found in words(texts, ALNUM):
        d, s, f = evidence(found, model)
        doc.append(d + found.first)
        sentence.append(s + base)
        which.append(f)
        base += len(found.data) + 2
    doc, sentence, which = map(np.concatenate, (doc, sentence, which))
    bags, sentence = np.unique(sentence, return_inverse=True)
    owner = np.zeros(len(bags), np.int64)
    owner[sentence] = doc
    theta = np.concatenate([np.full(len(model.keys), 0.3), [-2.0, np.log(model.leak / (1 - model.leak))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, how.rounds + 1):
        score = np.bincount(sentence, theta[which], len(bags)) + theta[-2]
        clean = np.bincount(owner, -np.logaddexp(0, score), len(label)) - np.logaddexp(0, theta[-1])
        clean = np.minimum(clean, -1e-9)
        pull = np.where(label > 0, np.exp(clean) / -np.expm1(clean), -1.0)  # slope of the loss in log P(clean)
        by_sentence = -pull[owner] * _sigmoid(score)
        grad = np.concatenate([np.bincount(which, by_sentence[sentence], len(model.keys)), [by_sentence.sum(), (-pull).sum() * _sigmoid(theta[-1])]]) / len(label)
        grad[:-2] += how.decay * theta[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(model.keys, theta[: len(model.keys)], float(theta[-2]), float(_sigmoid(theta[-1:])[0]))


SCORED = "doc_id long, score double, predicted int, offending array<struct<start: int, end: int, score: double>>"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def score_batch(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of texts, and of those at 0.5 or more the offending sentences, as code points."""
    scores, offending = [], []
    for found in words(texts, ALNUM):
        doc, sentence, which = evidence(found, model)
        bags, sentence_at = np.unique(sentence, return_inverse=True)
        logit = np.bincount(sentence_at, model.weights[which], len(bags)) + model.bias
        owner = np.zeros(len(bags), np.int64)
        owner[sentence_at] = doc
        clean = np.bincount(owner, -np.logaddexp(0, logit), len(found)) + np.log1p(-min(model.leak, 1 - 1e-12)) if len(found) else np.zeros(0)
        score = np.clip(-np.expm1(clean), 0.0, 1.0)
        spans: list[list[dict]] = [[] for _ in range(len(found))]
        chance = _sigmoid(logit)
        hot = np.flatnonzero((chance >= 0.5) & (score[owner] >= 0.5)) if len(bags) else []
        if len(hot):
            stops = np.flatnonzero(STOPS[found.data])
            numbers = sentence_numbers(found)
            for k in hot:
                d, word = owner[k], np.searchsorted(numbers, bags[k])
                low, high = found.offsets[d], found.offsets[d + 1]
                at = np.searchsorted(stops, found.starts[word])
                begin = max(low, stops[at - 1] + 1 if at else 0)
                end = min(high, stops[at] + 1 if at < len(stops) else high)
                ahead = np.count_nonzero((found.data[low:begin] & 0xC0) != 0x80)
                spans[d].append({"start": int(ahead), "end": int(ahead + np.count_nonzero((found.data[begin:end] & 0xC0) != 0x80)), "score": float(chance[k])})
        scores.append(score)
        offending += spans
    return (np.concatenate(scores) if scores else np.zeros(0)), offending


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, offending`` of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, offending = score_batch(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(offending, SCORED_ARROW.field("offending").type)], schema=SCORED_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more, judged in place: no exchange, no join."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = score_batch(batch.column(at), model)
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
