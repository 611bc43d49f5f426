"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's words are lower-cased and cut between letters and marks (``encode.Units``).  Its features are hashed units and pairs of
neighbouring units, each with the square root of its share of the text's features, so the values of a text have length one
whatever its size; one more feature says how much of the text lies in four-unit sequences that occur in it again, and one is
constant.  The score is the logistic function of the sparse dot product with the weights.

Training takes at most ``max_rows`` labelled rows (those with the least hash of their id; documented bound 20,000; of a repeated
id the text with the least hash), so the sample's ids may be broadcast.  The sample is dealt by hash into shards of about
``SHARD_ROWS`` rows.  Every shard is learned row by row in ``PASSES`` passes, and the shards' states (the gradient sums and
squared sums of each feature, bounded by the hash size) are averaged.

Inputs of a score are the text alone.  Defined cases: null, empty and blank texts have the constant feature only; null labels and
labels of null ids are left out of training, and a document with several labels is good if one of them says so; with no
labelled rows every score is 0; with one class only, scores follow the constant.  Repeated rows and null ids are scored like
any other row; an empty table gives an empty result; other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.encode import Units
from siteweave.llm.words import mix, slices

BITS = 18             # n-grams are hashed to 2**BITS features
REPEATED, CONSTANT = 1 << BITS, (1 << BITS) + 1
SIZE = (1 << BITS) + 2
SEQUENCE = 4          # units of a sequence that may occur again
MAX_ROWS = 20_000     # most labelled rows that training takes
SHARD_ROWS = 2_500    # rows of a shard, about
PASSES = 10
RATE, SHIFT, L1 = 4.0, 0.1, 0.05   # learning rate, its shift, and the penalty that keeps weak features out
THRESHOLD = 0.3
_U = np.uint64


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, offset by text) of all texts."""
    units = Units(texts, lower=True)
    n, many = len(units), units.texts
    pairs = np.flatnonzero(units.text[:-1] == units.text[1:])
    owner = np.r_[units.text, units.text[pairs]].astype(np.uint64)
    key = owner << _U(BITS) | np.r_[units.hash, units.sequence_hash(pairs, 2)] >> _U(64 - BITS)
    key, uses = np.unique(key, return_counts=True)
    text, feature = (key >> _U(BITS)).astype(np.int64), (key & _U((1 << BITS) - 1)).astype(np.int64)
    value = np.sqrt(uses / np.bincount(owner.astype(np.int64), minlength=many)[text])

    first = np.flatnonzero(units.text[:max(0, n - SEQUENCE + 1)] == units.text[SEQUENCE - 1:]) if n >= SEQUENCE else np.zeros(0, np.int64)
    sequence = mix(units.sequence_hash(first, SEQUENCE) ^ mix(units.text[first].astype(np.uint64) + _U(1)))
    _, inverse, times = np.unique(sequence, return_inverse=True, return_counts=True)
    again = np.bincount(units.text[first[times[inverse] > 1]], minlength=many) / np.maximum(1, np.bincount(units.text[first], minlength=many))

    every = np.arange(many)
    text = np.r_[text, every, every]
    feature = np.r_[feature, np.full(many, REPEATED), np.full(many, CONSTANT)]
    value = np.r_[value, np.sqrt(again), np.ones(many)]
    order = np.argsort(text, kind="stable")
    return feature[order], value[order], np.searchsorted(text[order], np.arange(many + 1))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that lead, given the gradient sums ``z`` and the squared sums ``n``."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) * RATE / (SHIFT + np.sqrt(n)))


def update(z: np.ndarray, n: np.ndarray, feature: np.ndarray, value: np.ndarray, label: float) -> None:
    """One follow-the-regularised-leader step, in place."""
    zf, nf = z[feature], n[feature]
    w = weights(zf, nf)
    error = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label
    gradient = error * value
    squared = gradient * gradient
    z[feature] = zf + gradient - (np.sqrt(nf + squared) - np.sqrt(nf)) / RATE * w
    n[feature] = nf + squared


def sampled(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, good) of at most ``max_rows`` labelled ids."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray | None:
    """Weights of all features, learned from the documents that ``labels`` (doc_id, quality) names."""
    sample = sampled(labels, max_rows)
    shards = -(-sample.count() // SHARD_ROWS)
    if not shards:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            feature, value, offset = features(texts)
            packed = [[x[a:b].tobytes() for a, b in zip(offset, offset[1:])] for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), *[pa.array(x, pa.binary()) for x in packed]], ["doc_id", "good", "feature", "value"])

    def learn(table: pa.Table) -> pa.Table:
        z, n = np.zeros(SIZE), np.zeros(SIZE)
        order = np.argsort(mix(table["doc_id"].to_numpy().astype(np.uint64)))
        good, feature, value = table["good"].to_numpy(), table["feature"].to_pylist(), table["value"].to_pylist()
        for _ in range(PASSES):
            for i in order.tolist():
                update(z, n, np.frombuffer(feature[i], np.int32), np.frombuffer(value[i], np.float32).astype(float), float(good[i]))
        used = np.flatnonzero(n)
        return pa.table({"feature": pa.array(used, pa.int32()), "z": z[used], "n": n[used]})

    shard = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(shards))
    vectors = rows.mapInArrow(sparse, "doc_id long, good int, feature binary, value binary").withColumn("shard", shard)
    learned = vectors.groupBy("shard").applyInArrow(learn, "feature int, z double, n double")  # a shard has a bounded part of a bounded sample
    state = learned.groupBy("feature").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toPandas()  # at most SIZE rows
    if not len(state):
        return None
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    at = state["feature"].to_numpy(np.int64)
    z[at], n[at] = state["z"].to_numpy(), state["n"].to_numpy()
    return weights(z, n)


def score_texts(texts: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Probability that each text is good."""
    feature, value, offset = features(texts)
    z = np.bincount(np.repeat(np.arange(len(texts)), np.diff(offset)), weight[feature] * value, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that labels may not be learned from: crc32 of the id as text divides by 5 (null ids: the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scores(docs: DataFrame, weight: np.ndarray | None) -> DataFrame:
    """(doc_id, score) of every document: one pass over whole texts, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if weight is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(weight)  # SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(texts, shared.value))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; nothing is learned from held-out rows."""
    found = scores(docs, fit(docs, labels.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
