import math
import random
from collections import Counter

import numpy as np
import pytest

from siteweave.llm import lattice_lm, toxicity
from tests.llm import plain


@pytest.fixture(scope="module")
def vocabulary():
    return lattice_lm.vocabulary(lattice_lm.vocabulary_path())


def all_ways(word, pieces, scores, number):
    """Log probability by adding up every segmentation."""
    ways = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in number:
                ways[j] += ways[i] * math.exp(scores[number[word[i:j]]])
    return math.log(ways[-1])


def test_forward_recursion_adds_up_all_segmentations(vocabulary, monkeypatch):
    rng = random.Random(2)
    scores = np.log(vocabulary.start / vocabulary.start.sum())
    words = [b" the", b" onthre", "é ünter".encode(), b" x", " 中文字".encode(), *(b" " + bytes(rng.choice(b"thereandon") for _ in range(rng.randrange(1, 30))) for _ in range(60))]
    want = [all_ways(w, vocabulary.pieces, scores, vocabulary.number) for w in words]
    assert vocabulary.log_probability(words, scores) == pytest.approx(want)
    counts = np.arange(1.0, len(words) + 1)
    uses = vocabulary.expected(words, counts, scores)
    monkeypatch.setattr(lattice_lm, "VECTOR", 0)  # every word as a long one
    assert vocabulary.log_probability(words, scores) == pytest.approx(want)
    assert vocabulary.expected(words, counts, scores) == pytest.approx(uses)
    # expected uses of all pieces cover every byte of every word
    assert sum(u * len(p) for u, p in zip(uses, vocabulary.pieces)) == pytest.approx(sum(c * len(w) for c, w in zip(counts, words)))


def test_token_probabilities_sum_to_one():
    """Words, whose lattice probabilities sum to one, and the end; with arcs, known words, the end and the discounted rest."""
    words = np.log(np.array([0.5, 0.3, 0.2]))
    for n, ends in [(10, 3), (0, 0), (4, 4)]:
        assert (10 ** lattice_lm.token_score(words, n, ends)).sum() + 1 - lattice_lm.word_share(n, ends) == pytest.approx(1)
    c, n = np.array([5, 3, 1, 1]), 10
    seen = 10 ** lattice_lm.arc_score(c, np.full(4, -np.inf), n, 4)
    assert seen.sum() + lattice_lm.DISCOUNT * 4 / n == pytest.approx(1)
    assert 10 ** lattice_lm.arc_score(np.array([0]), np.log(np.array([0.2])), n, 4) == pytest.approx(0.2 * lattice_lm.DISCOUNT * 4 / n)


def test_document_scores_against_brute_force(spark, vocabulary):
    """Learning and scores once more in plain Python: every segmentation of every token, over all training texts."""
    texts = ["the red Fox the", "a fox", "", None, "über the 中 hill", "a a a", "zzz the", "fox-hill a", "red"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the fox"), (-(2 ** 63), "red hill"), (3, "a"), (3, "a")]
    number, pieces = vocabulary.number, vocabulary.pieces
    train = Counter(w for i, t in rows if plain.crc(i) % 7 != 2 for w in plain.words(t))
    ends = sum(plain.crc(i) % 7 != 2 for i, _ in rows)
    scores = [math.log(p) for p in vocabulary.start / vocabulary.start.sum()]

    def ways(word):  # all segmentations as lists of piece numbers
        if not word:
            return [[]]
        return [[number[word[:j]], *rest] for j in range(1, len(word) + 1) if word[:j] in number for rest in ways(word[j:])]

    def token(word):
        return (" " + word).encode() if isinstance(word, str) else b" " + word

    for _ in range(lattice_lm.ROUNDS):
        uses = [lattice_lm.SMOOTHING] * len(pieces)
        for word, c in train.items():
            cuts = ways(token(word))
            weights = [math.exp(sum(scores[p] for p in cut)) for cut in cuts]
            for cut, weight in zip(cuts, weights):
                for p in cut:
                    uses[p] += c * weight / sum(weights)
        total = sum(uses)
        scores = [math.log(u / total) for u in uses]
    n = sum(train.values()) + ends
    want = []
    for i, t in rows:
        lattice = [math.log10(sum(math.exp(sum(scores[p] for p in cut)) for cut in ways(token(w)))) for w in plain.words(t)]
        want.append((str(i), plain.crc(i) % 7 == 2, round(sum(lattice) + len(lattice) * math.log10((n - ends) / n) + math.log10(ends / n), 6)))
    got = lattice_lm.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6)) for r in got) == sorted(want)


def test_scores(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in given.collect()] + [(1000, None), (1001, ""), (1002, "Ünseen中 " * 3), (1003, "q" * 500), (None, "the the"), (5, "the of")]
    df = lattice_lm.report(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(4)).collect()
    train = Counter(w for i, t in rows if plain.crc(i) % 7 != 2 for w in plain.words(t))
    ends = sum(plain.crc(i) % 7 != 2 for i, _ in rows)
    n, v = sum(train.values()) + ends, len(train) + 1
    want = []
    for i, t in rows:
        counts = [train[w] for w in plain.words(t)] + [ends]
        want.append((str(i), plain.crc(i) % 7 == 2, len(counts), sum(c > 0 for c in counts), n, round(sum(math.log10((c + 1) / (n + v + 1)) for c in counts), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df) == sorted(want)
    assert all(r.score < 0 for r in df)
    empty = {r.score for r in df if r.n_tokens == 1}
    assert len(empty) == 1 and -5 < empty.pop() < 0
    held = [r for r in df if r.held_out]
    untrained = lattice_lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()
    assert sum(r.score for r in held) > 0.97 * sum(r.score for r in untrained if r.held_out)  # less negative
    assert lattice_lm.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = toxicity.report(docs.withColumn("score", docs.doc_id), labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (plain.crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    area = np.mean([(t > c) + (t == c) / 2 for t in toxic for c in clean])
    assert area > 0.95
    again = toxicity.report(docs.repartition(7), labels.repartition(3)).join(labels, "doc_id").collect()
    assert sorted((r.doc_id, round(r.score, 9)) for r in out) == sorted((r.doc_id, round(r.score, 9)) for r in again)


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, toxic string, predicted int"
    rows = [(i, ("you are an idiot here " if i % 3 == 0 else "a kind word for all of you ") * (1 + i % 4), "", 0) for i in range(60)]
    odd = [(None, "what an IDIOT", "", 0), (100, None, "", 0), (101, "", "", 0), (102, "a", "", 0), (103, "kind word " * 9000, "", 0), (103, "kind word", "", 0)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (1, 0, None), (3, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.report(spark.createDataFrame(rows + odd, schema), table).collect()
    assert len(out) == 66 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 60)
    assert [r.predicted for r in out if r.doc_id is None] == [1] and {r.predicted for r in out if r.doc_id in (100, 101, 103)} == {0}
    kept = toxicity.documents_kept(spark.createDataFrame(rows + odd, schema), spark.createDataFrame(rows, schema), table)
    assert kept.columns == ["doc_id", "text", "toxic", "predicted"] and kept.count() == 45
    none = toxicity.report(spark.createDataFrame(rows, schema), table.filter("doc_id < 0")).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.report(spark.createDataFrame([], schema), table).collect() == []
