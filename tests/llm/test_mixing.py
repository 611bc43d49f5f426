from collections import defaultdict

import pytest

from siteweave.llm import mixing
from tests.llm import plain

SCHEMA = "doc_id long, text string, source string, target string"


def wanted(sizes):
    """Targets by source, from sizes by source (None last)."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = whole - sum(2 * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in names if s not in stopped)
        target = {s: 2.0 * sizes[s] if s in stopped else left * weight[s] / open_weight for s in names}
        new = {s for s in names if target[s] > 2 * sizes[s] and s not in stopped}
        if not new:
            return target
        stopped |= new


def check(df, rows, near):
    sizes, got = defaultdict(int), defaultdict(int)
    by_id = {r[0]: r for r in rows}
    for _, text, source, *_ in rows:
        sizes[source] += len(plain.words(text))
    target = wanted(sizes)
    out = df.collect()
    assert len(out) == len(rows)
    for r in out:
        source = by_id[r.doc_id][2]
        assert r["size"] == len(plain.words(by_id[r.doc_id][1])) and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        got[source] += r.taken
    for s in sizes:
        assert abs(got[s] - target[s]) <= near * max(1, target[s]), (s, got[s], target[s])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    df = mixing.report(docs)
    check(df, rows, 0.05)
    assert sorted(df.collect()) == sorted(mixing.report(docs.repartition(5)).collect())


def test_caps_nulls_and_edges(spark):
    rows = [(i, "w " * (1 + i % 9), "big", "") for i in range(3000)] + [(5000 + i, "w " * 3, "a", "") for i in range(20)]
    rows += [(6000 + i, "x y", None, "") for i in range(50)] + [(7000, "", "empty", ""), (7001, None, "empty", ""), (7002, "one", "é", ""), (7003, " \t", "big", "")]
    check(mixing.report(spark.createDataFrame(rows, SCHEMA).repartition(4)), rows, 0.01)


def test_rates_reach_targets_by_exponential_tilting(spark):
    import math

    counts = spark.createDataFrame([(0, s, n) for s, n in ((1, 400), (10, 30), (50, 9))], "_rank long, size long, n long")
    sources = spark.createDataFrame([(0, "s", 1150, 50, 439, 500.0)], "_rank long, source string, source_size long, largest long, docs long, target double")
    lam = mixing.multipliers(counts, sources).first().lam
    assert sum(n * s * min(2, math.exp(lam * s / 50)) for s, n in ((1, 400), (10, 30), (50, 9))) == pytest.approx(500.0)
    up = mixing.multipliers(counts, sources.replace(500.0, 2200.0)).first().lam
    assert sum(n * s * min(2, math.exp(up * s / 50)) for s, n in ((1, 400), (10, 30), (50, 9))) == pytest.approx(2200.0)
    assert mixing.multipliers(counts, sources.replace(500.0, 2300.0)).first().lam is None


def test_documents_repeat(spark):
    rows = [(1, "a b", "s", "t"), (1, "a b", "s", "t"), (None, "c d", "s", "t"), (2, None, "s", "t")]
    df = mixing.documents_mixed(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["doc_id", "text", "source", "target"]
    copies = sorted(str(r.doc_id) for r in df.collect())
    assert copies.count("2") == 1 and len(copies) in (5, 6)  # nine words wanted from texts of two, and the empty text once
    assert mixing.report(spark.createDataFrame([], SCHEMA)).collect() == []
