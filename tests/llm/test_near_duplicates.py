import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.llm import components, minhash
from siteweave.session import staged
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, component long"


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(minhash.report(docs)) == plain.components(rows, 3, 85)
    assert found(minhash.report(docs, k=5, percent=80)) == plain.components(rows, 5, 80)


def test_chains_and_edges(spark):
    """Neighbours of a chain are alike, its ends are not; stars alone would have to be lucky."""
    base = [f"w{i}" for i in range(60)]
    chain = []
    for i in range(12):
        base = [*base[:4 * i], f"x{i}", f"y{i}", *base[4 * i + 2:]]
        chain.append(" ".join(base))
    texts = [*chain, None, "", "  \t ", "one", "One", "one two", "one two three", "ONE TWO three", "été été", "a " * 5000, "a  " * 4000]
    rows = [(100 - i, t, "en", 7) for i, t in enumerate(texts)]
    want = plain.components([(r[0], r[1]) for r in rows], 3, 85)
    df = minhash.report(spark.createDataFrame(rows, SCHEMA))
    assert found(df) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_repeats_and_null_ids(spark):
    rows = [(1, "a b c d", "en", 1), (1, "a b c d", "en", 1), (None, "a b c d", "en", 1), (2, "other words here now", "en", 1), (None, None, "en", 1)]
    df = minhash.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df) == [
        ("1", 2, "1", False), ("1", 2, "1", True), ("2", 2, "2", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    kept = minhash.documents_kept(spark.createDataFrame(rows, SCHEMA), k=3, percent=85)
    assert kept.columns == ["doc_id", "text", "lang", "component"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]


def test_empty_table(spark):
    assert minhash.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_densified_bins_agree_like_sets():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        shared = rng.integers(0, 1 << 63, 17, dtype=np.uint64)
        a, b = np.unique(np.r_[shared, rng.integers(0, 1 << 63, 1, dtype=np.uint64)]), np.unique(np.r_[shared, rng.integers(0, 1 << 63, 2, dtype=np.uint64)])
        values = minhash.one_permutation(np.r_[a, b] * np.uint64(2), np.array([0, len(a), len(a) + len(b)]), 160)
        agree.append((values[0] == values[1]).mean())
    assert np.mean(agree) == pytest.approx(17 / 20, abs=0.03)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(160, 159), (200, 201), (201, 200)]
    labels = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 161)}, 201: 200}


def test_a_column_named_row_is_no_key(spark):
    rows = [(i, t, None if i % 2 else 7, 0) for i, t in enumerate(["one two three four", "one two three four", "five six seven", "", None])]
    given = spark.createDataFrame(rows, "doc_id long, text string, _row long, component long")
    out = {r.doc_id: (r.component_id, r.kept) for r in minhash.report(given).collect()}
    assert out == {0: (0, True), 1: (0, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_hub_does_not_meet_in_one_task(spark):
    """A star of 100,000 members: the rows that ask for its centre, which has no parent, are not shuffled to one task."""
    star = staged(spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")))
    parents = staged(star.select(F.col("b").alias("node"), F.col("a").alias("parent")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = components._follow(star, "a", parents, 100_000)
        largest = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert found.count() == 100_000 and largest < 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    labels = components.components(star)
    assert labels.count() == 100_000 and labels.filter("label <> 0").isEmpty()
