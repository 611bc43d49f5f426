import random
from math import factorial

from siteweave.llm import filter_audit
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, part string, mask int, n int, good int"
LABELS = "doc_id long, quality int, toxic int, part string, mask string"


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        kind = i % 8
        words = [rng.choice("abcdefghij") + str(rng.randrange(3 if kind == 1 else 4000)) for _ in range(rng.choice((3, 199, 200, 230)))]
        if kind == 2:
            words = [w.upper() + "X" for w in words]
        if kind == 3:
            words[rng.randrange(len(words))] += rng.choice("#$%&*|")
        rows.append((i, " \x0b".join(words), rng.choice(("en", "de", "", None))))
    rows += [(1000 + j, rows[j * 3][1], rows[j][2]) for j in range(25)]         # copies, in other parts too
    rows += [(-5, rows[7][1], "en"), (50, rows[50][1], "en"), (50, rows[50][1], "en"), (50, "other", "de")]  # a smaller id; repeated rows; a repeated id
    rows += [(None, None, None), (None, "", "en"), (2000, "", "fr"), (None, rows[9][1], "de"), (None, "lonely", "de"), (None, "lonely", "de")]
    rows += [(3000, "Word " * 100_000, "long"), (3001, "é" * 97 + "ABC", "fr"), (3002, "é" * 96 + "ABCD", "fr"), (3003, "50% of 200 " * 60, "fr")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    rng = random.Random(6)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (3, 1, 0), (3, 0, 1), (99999, 1, 1)]
    given = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS).repartition(5)
    got = found(filter_audit.report(given, spark.createDataFrame([(*r, "y", "z") for r in labels], LABELS)))
    want = plain.audit(rows, labels)
    assert len(want) == 6 * 600 - 600 and got == want  # null and empty parts are one
    assert found(filter_audit.report(given, spark.createDataFrame([], LABELS))) == plain.audit(rows, [])
    assert filter_audit.report(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_lattice():
    for k in range(1, 8):
        edges = filter_audit.lattice(k)
        assert len(edges) == k << k - 1
        for level in range(k):  # every order takes one edge of each level
            assert sum(e.paths for e in edges if e.state.bit_count() == level) == factorial(k)
        for f in range(k):
            assert sum(e.paths for e in edges if e.filter == f) == factorial(k)


def test_equal_texts_do_not_meet(spark):
    """A third of the rows are copies of one text: after the first count no exchange brings them together."""
    rows = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(3000)]
    got = found(filter_audit.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)))
    assert got["en", "EABCD", 1][:2] == (1001, 1999) and got["en", "ABCDE", 1][:2] == (0, 3000)
