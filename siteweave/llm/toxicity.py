"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Training takes at most ``max_rows`` labelled rows (those with the least hash of their id; documented bound 20,000), so
the sample's ids may be broadcast and no text is shuffled.  From the sample come, over Spark, the number of toxic and of
other documents that hold each hashed n-gram; these counts give the log-count ratios.  The ``max_features`` n-grams
with the strongest ratios are kept, and a regularised logistic regression is fitted on the documents' presence vectors
scaled by the ratios.  Scoring is one pass over whole texts without a shuffle.

Inputs of a score are the lower-cased bytes of the text alone.  Defined cases: null, empty and very short texts have no
n-grams and get the score of the intercept; labels that are null are left out of training, and a document with
several labels is toxic if one of them says so; with no labelled rows, or one class only, every score is the prior
(0 if there are no labels).  Repeated rows and null ids are scored like any other row; other columns are not looked at.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.words import LOWER, slices

SIZES = (3, 4, 5)       # characters (bytes) of an n-gram
BITS = 20               # n-grams are hashed to 2**BITS features
MAX_ROWS = 20_000       # most labelled rows that training takes
MAX_FEATURES = 4_096    # most n-grams that get a weight
LEAST_DOCS = 3          # an n-gram in fewer sample documents gets none


@dataclass
class Model:
    """Weight of each kept feature (already multiplied by its log-count ratio), and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams at every position, one array per size."""
    total = np.zeros(len(data), np.uint32)
    x = data.astype(np.uint32) + np.uint32(1)
    for n in range(1, max(SIZES) + 1):
        if len(x) < n:
            return
        total = total[:len(x) - n + 1] * np.uint32(0x01000193) ^ x[n - 1:] * np.uint32(0x9E3779B1)
        if n in SIZES:
            h = total ^ (total >> np.uint32(15))
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            yield h >> np.uint32(32 - BITS)


def padded(text: bytes) -> np.ndarray:
    return LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]


def present(text: bytes) -> np.ndarray:
    """Distinct features of one text."""
    parts = list(grams(padded(text))) if text else []
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def training_rows(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (doc_id, toxic)."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Train on the documents that ``labels`` (doc_id, toxic) names."""
    sample = training_rows(labels, max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, sizes = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch, texts in slices(batches):
            for text, toxic in zip(texts, batch.column("toxic").to_pylist()):
                totals[int(toxic > 0), present(text)] += 1
                sizes[int(toxic > 0)] += 1
        seen = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, seen], pa.int32()), pa.array(np.r_[sizes[0], totals[0, seen]], pa.int64()), pa.array(np.r_[sizes[1], totals[1, seen]], pa.int64())],
            ["feature", "clean", "toxic"],
        )

    counted = rows.mapInArrow(count, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = counted.filter("feature = -1").collect()
    n = np.array([sizes[0]["clean"], sizes[0]["toxic"]], float) if sizes else np.zeros(2)
    if not n.all():
        odds = -30.0 if n[1] == 0 else 30.0
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), odds)

    ratio = F.log((F.col("toxic") + 1) / (n[1] + 2)) - F.log((F.col("clean") + 1) / (n[0] + 2))
    # the ratio alone favours rare n-grams, so it is weighed with how many documents bear it out
    strength = F.abs(ratio) * F.sqrt(F.least("clean", F.lit(n[0])) / n[0] + F.col("toxic") / n[1])
    kept = counted.filter(f"feature >= 0 and clean + toxic >= {LEAST_DOCS}").select("feature", ratio.alias("ratio"), strength.alias("strength"))
    chosen = kept.orderBy(F.desc("strength"), "feature").limit(max_features).toPandas().sort_values("feature")  # at most max_features rows
    features, ratios = chosen["feature"].to_numpy(np.int64), chosen["ratio"].to_numpy(float)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[features] = np.arange(len(features))
        for batch, texts in slices(batches):
            found = [place[present(t)] for t in texts]
            packed = [f[f >= 0].astype(np.uint16).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(packed, pa.binary())], ["toxic", "features"])

    sparse = rows.mapInArrow(reduce, "toxic int, features binary").toPandas()  # at most max_rows rows of at most max_features numbers
    columns = [np.frombuffer(x, np.uint16) for x in sparse["features"]]
    weights, intercept = logistic(columns, (sparse["toxic"].to_numpy() > 0).astype(float), ratios)
    return Model(features, (weights * ratios).astype(np.float32), intercept)


def logistic(columns: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on presence vectors scaled by ``scale`` (accelerated gradient descent)."""
    order = np.lexsort((y, [len(c) for c in columns], [int(c.sum()) for c in columns]))  # arrival order must not matter
    columns, y = [columns[i] for i in order], y[order]
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    col = np.concatenate(columns).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    value = scale[col]
    n, m = len(columns), len(scale)
    norm = np.bincount(row, value * value, minlength=n)
    bound = 0.25 * (norm.mean() + norm.max()) / 2 + 0.25 + penalty / n if n else 1.0
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c, t = w.copy(), b, 1.0
    last = np.inf
    for _ in range(steps):
        z = np.bincount(row, value * v[col], minlength=n) + c
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        loss = -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-12)) + penalty * (v @ v) / (2 * n)
        if loss > last:  # momentum went too far
            t = 1.0
        last = loss
        g = np.bincount(col, value * (p - y)[row], minlength=m) / n + penalty * v / n
        w2, b2 = v - g / bound, c - float((p - y).mean()) / 0.25
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def score_texts(texts: list[bytes], weight: np.ndarray, intercept: float) -> np.ndarray:
    """Probability that each text is toxic, from the table of all features' weights."""
    # all texts at once; n-grams that span two texts are dropped
    data = LOWER[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    length = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    start = np.cumsum(np.r_[0, length])
    keys = [np.zeros(0, np.int64)]
    for n, h in zip(SIZES, grams(data)):
        at = np.flatnonzero(weight[h])
        text = np.searchsorted(start, at, "right") - 1
        inside = (at + n <= start[text + 1]) & (length[text] > 2)
        keys.append(text[inside] << BITS | h[at[inside]].astype(np.int64))
    key = np.unique(np.concatenate(keys))
    z = np.bincount(key >> BITS, weight[key & ((1 << BITS) - 1)], minlength=len(texts)) + intercept
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _shared(docs: DataFrame, model: Model):
    table = np.zeros(1 << BITS, np.float32)
    table[model.features] = model.weights
    return docs.sparkSession.sparkContext.broadcast((table, model.intercept))  # 2**BITS numbers


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            score = score_texts(texts, *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that labels may not be learned from: crc32 of the id as text divides by 5 (null ids: the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; nothing is learned from held-out rows."""
    model = fit(docs, labels.filter(~held_out()))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def documents_kept(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) that a model of ``training_docs`` and ``labels`` doesn't reject, in one pass."""
    shared = _shared(docs, fit(training_docs, labels.filter(~held_out())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(score_texts(texts, *shared.value) < 0.5))

    return docs.mapInArrow(run, docs.schema)
