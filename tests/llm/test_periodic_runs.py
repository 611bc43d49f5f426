import random

import numpy as np
import pytest

from siteweave.llm import periodic_runs
from tests.llm import plain

SCHEMA = "doc_id long, text string, runs string, start long, best string"


def caught(x, least, cut=None):
    catcher = periodic_runs.RunCatcher(least)
    squares, at = [], 0
    values = np.array(x, np.uint64) + np.uint64(1)
    while at < len(x):
        step = len(x) if cut is None else cut()
        squares += catcher.append(values[at:at + step])
        at += step
    return [(a, e - a, p) for a, e, p in catcher.runs()], squares, catcher


def sequences():
    rng = random.Random(8)
    for n in (0, 1, 2, 11, 12, 13, 40, 100, 300):
        for letters in (1, 2, 3, 50):
            yield [rng.randrange(letters) for _ in range(n)]
    fib = [0], [0, 1]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]
    yield [(i & -i).bit_length() % 3 for i in range(1, 300)]
    for _ in range(40):  # planted runs, nested ones too
        x = [rng.randrange(1000) for _ in range(rng.randrange(20))]
        while len(x) < 250:
            part = x[-rng.randrange(1, 30):] or [1]
            x += (part * rng.randrange(1, 6))[:rng.randrange(1, 90)] + [rng.randrange(1000) for _ in range(rng.randrange(6))]
        yield x


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_sequences(least, monkeypatch):
    rng = random.Random(9)
    for x in sequences():
        want = plain.runs(x, least)
        assert caught(x, least)[0] == want
        assert caught(x, least, lambda: rng.randrange(1, 60))[0] == want
        monkeypatch.setattr(periodic_runs, "PIECE", 37)
        assert caught(x, least)[0] == want
        monkeypatch.undo()


def test_word_by_word():
    """The runs are right after every word, and a square is reported with the word that ends it."""
    for x in list(sequences())[12:40:3]:
        x = x[:120]
        catcher, reported = periodic_runs.RunCatcher(4), []
        for i, v in enumerate(x):
            new = catcher.append(np.array([v + 1], np.uint64))
            assert all(x[end - p:end] == x[end - 2 * p:end - p] for end, p in new)
            assert all(end == i + 1 for end, p in new if all(x[end - q:end] != x[end - 2 * q:end - q] for q in range(1, p)))
            reported += new
            assert [(a, e - a, p) for a, e, p in catcher.runs()] == plain.runs(x[:i + 1], 4)
        assert {p for _, n, p in plain.runs(x, 2)} <= {p for _, p in reported}


def test_uniform_and_long():
    n = 200_000
    assert caught([7] * n, 12)[0] == [(0, n, 1)]
    rng = random.Random(1)
    x = [rng.randrange(10**9) for _ in range(30_000)]
    x += x[-7001:] * 2 + [1] + x[:50]
    assert caught(x, 12)[0] == [(30_000 - 7001, 3 * 7001, 7001)]
    assert caught(x, 12, lambda: 9_999)[0] == [(30_000 - 7001, 3 * 7001, 7001)]


def digests(df):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((str(r.doc_id), *[str(r[n]) for n in names]) for r in df.collect())


def test_query_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("a", "b", "é", "Word.", "x" + str(rng.randrange(50)))) for _ in range(rng.randrange(120))), "", 1, "") for i in range(150)]
    rows += [(i, "one two\tthree\n\nfour " * 30 + "end", "", 1, "") for i in range(200, 230)]
    rows += [(300, None, "", 1, ""), (301, "", "", 1, ""), (302, " \t\n", "", 1, ""), (None, "q " * 13, "", 1, ""), (303, "A a " * 6, "", 1, ""), (303, "A a " * 6, "", 1, "")]
    rows += [(400 + i, text, "", 1, "") for i in range(12) for text in ("", None, "w")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = digests(periodic_runs.digest(periodic_runs.report(periodic_runs.with_planted_runs(docs))))
    assert got == sorted((str(i), *map(str, plain.run_digest(i, t))) for i, t, *_ in rows)
    plants = [i for i, t, *_ in rows if t and plain.crc(i) % 10 == 0]
    assert len(plants) > 10
    empty = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.digest(periodic_runs.report(periodic_runs.with_planted_runs(empty))).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = digests(periodic_runs.digest(periodic_runs.report(periodic_runs.with_planted_runs(docs))))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    want = {str(i): (str(i), *map(str, plain.run_digest(i, t))) for i, t in rows}
    assert len(got) == docs.count() and [r for r in got if r[0] in want] == sorted(want.values())


def test_long_text(spark):
    text = "v" + " v".join(str(i) for i in range(300_000)) + " tail" * 50_000
    row = periodic_runs.report(spark.createDataFrame([(5, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(300_000, 50_000, 1)] and row.n_words == 350_000
    assert row.collapsed == text[:text.index(" tail") + 5]
