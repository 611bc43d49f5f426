import random

import pytest

from siteweave.llm import suffix_dedup
from tests.llm import plain

SCHEMA = "doc_id long, text string, row long, spans string"


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)

    def some(n):
        return "".join(rng.choice("abcdefgh é\n") for _ in range(n))

    passage, line, base = some(260), some(80), some(900)
    out = [base, base, passage, some(300) + passage + some(200), passage[40:] + some(90), base[:400] + "X" + base[401:], "ab" * 400, "a" * 333, None, "", "short", "a" * 99, "é" * 60]
    out += [some(70) + line + some(60) for _ in range(40)]
    out += [base[i:i + 150] + some(3) for i in range(0, 700, 37)] + [some(130) + base[100:199], base[100:200], base[101:200]]
    return list(enumerate(out))


def test_against_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], SCHEMA).repartition(5)
    assert found(suffix_dedup.report(docs)) == plain.removed(texts)


def test_hot_grams_are_split(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "RUN", 100)
    monkeypatch.setattr(suffix_dedup, "PARTITION", 200)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], SCHEMA).repartition(7)
    assert found(suffix_dedup.report(docs)) == plain.removed(texts)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert found(suffix_dedup.report(docs)) == plain.removed(rows)


def test_repeats_and_empty(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(150))
    one = "a" * 150
    df = suffix_dedup.report(spark.createDataFrame([(1, text, 1, ""), (1, text, 1, ""), (None, text, 1, "")], SCHEMA))
    assert sorted((str(r.doc_id), r.n_removed) for r in df.collect()) == [("1", 0), ("1", 150), ("None", 150)]
    df = suffix_dedup.report(spark.createDataFrame([(1, one, 1, ""), (2, one, 1, ""), (3, one, 1, "")], SCHEMA))
    assert found(df) == plain.removed([(1, one), (2, one), (3, one)])
    assert suffix_dedup.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_loser_tree():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(20))) for _ in range(n)]

        def common(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        shared = [[0, *map(common, run, run[1:])][:len(run)] for run in runs]
        order, prefixes = suffix_dedup.merge(runs, shared)
        at, out = [0] * n, []
        for r in order:
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(x for run in runs for x in run)
        assert prefixes[1:] == [common(a, b) for a, b in zip(out, out[1:])]
