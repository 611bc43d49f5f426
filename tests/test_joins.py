import math
import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import match as M
from siteweave.operators import region as RG
from siteweave.operators import nearest, search
from siteweave.operators.joins import lookup_join, number_rows, without


@contextmanager
def no_broadcast(spark):
    """Small tables are joined and salted as large ones are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_join_with_hot_keys(spark):
    """A third of the rows share one key; hot or not, every row gets its answer and none is lost."""
    fact = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), (F.col("id") % 2).alias("side")
    )
    answers = fact.select("k").distinct().filter("k not in ('k1', 'k2')").select("k", F.length("k").alias("n"), F.when(F.col("k") != "k4", F.col("k")).alias("v"))
    wanted = sorted(map(tuple, fact.join(answers, "k", "left").select("id", "k", "side", "n", "v").collect()), key=str)
    small = lookup_join(fact, answers, ["k"], ["id"])
    assert sorted(map(tuple, small.select("id", "k", "side", "n", "v").collect()), key=str) == wanted
    with no_broadcast(spark):
        for min_rows in (1, 100, 10**9):
            got = lookup_join(fact, answers, ["k"], ["id"], min_rows)
            assert sorted(map(tuple, got.select("id", "k", "side", "n", "v").collect()), key=str) == wanted
    left = without(fact, answers, "k", ["id"], 100)
    assert {r.k for r in left.select("k").distinct().collect()} == {"k1", "k2"}


def test_hot_and_null_keys_are_spread(spark):
    """No partition of the join gets a hot key whole: one with an answer, one without, and null."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kind = F.col("id") % 4
        key = F.when(kind == 0, "known").when(kind == 1, "unknown").when(kind == 2, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        fact = spark.range(16_000).select("id", key.alias("k"))
        answers = fact.filter("k is not null and k <> 'unknown'").select("k").distinct().withColumn("v", F.length("k"))
        joined = lookup_join(fact, answers, ["k"], ["id"], 1000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 16_000 and max(sizes) < 2 * 16_000 / 8
        wrong = joined.filter("not (v <=> case when k is null or k = 'unknown' then null else length(k) end)")
        assert wrong.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbering_deals_rows_without_position(spark):
    """A third of the rows have no position: no task sorts much more than its share."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id") * 1000).alias("p"), (F.col("id") % 2).alias("t"), "id")
    numbered = number_rows(rows, "p", "n", ["t"])
    found = numbered.collect()
    for t in (0, 1):
        mine = sorted((r for r in found if r.t == t), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, 15_001))
        assert [r.p for r in mine if r.p is not None] == sorted(r.p for r in mine if r.p is not None) and all(r.p is None for r in mine[10_000:])
    keys = [F.col("t"), F.col("p").asc_nulls_last(), F.xxhash64("p", "t", "id")]
    sizes = [r["count"] for r in rows.repartitionByRange(8, *keys).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8
    assert number_rows(rows.limit(0), "p", "n", ["t"]).collect() == [] and number_rows(rows.limit(0), "p", "n", order=F.col("t")).collect() == []


def test_number_rows_without_position_or_group(spark):
    rows = [("a", 5), ("a", None), (None, 2), (None, 1), ("a", 300_000)]
    df = spark.createDataFrame(rows, "t STRING, p LONG")
    got = {(r.t, r.p): r.n for r in number_rows(df, "p", "n", ["t"]).collect()}
    assert got == {("a", 5): 1, ("a", 300_000): 2, ("a", None): 3, (None, 1): 1, (None, 2): 2}


def test_number_rows(spark):
    rng = random.Random(1)
    rows = [(t, p) for t, n in (("b", 40), ("a", 23), ("c", 1)) for p in rng.sample(range(200), n)]
    df = spark.createDataFrame(rows, "t STRING, p LONG")
    per_type = {(r.t, r.p): r.n for r in number_rows(df, "p", "n", ["t"]).collect()}
    overall = {(r.t, r.p): r.n for r in number_rows(df, "p", "n", ["t"], order=F.ascii("t")).collect()}
    for kind in "abc":
        positions = sorted(p for t, p in rows if t == kind)
        assert [per_type[kind, p] for p in positions] == list(range(1, len(positions) + 1))
    assert [overall[row] for row in sorted(rows)] == list(range(1, len(rows) + 1))


def hits_of(queries, titles):
    out = {}
    for q in {tuple(q) for q in queries}:
        scored = [(len(set(q) & set(t.split())), t) for t in titles]
        best = sorted((s for s in scored if s[0]), key=lambda s: (-s[0], len(s[1]), s[1]))[:5]
        out[q] = {i + 1: (t, n) for i, (n, t) in enumerate(best)}
    return out


def searched(df):
    got = {}
    for r in df.collect():
        got.setdefault(tuple(r.word_set), {})[r["rank"]] = (r.title, r.overlap)
    return got


@pytest.mark.parametrize(("common_titles", "common_words", "combo_words", "longest"), [
    (3, 20000, 6, 5), (10, 2, 6, 5), (0, 20000, 2, 9), (10**6, 20000, 6, 5), (5, 20000, 1, 9), (2, 20000, 3, 12), (4, 20000, 0, 6)])
def test_ranked_hits_equal_brute_force(spark, common_titles, common_words, combo_words, longest):
    """Random titles over few words, some in most titles; any settings of the index give the same hits."""
    rng = random.Random(common_titles + combo_words)
    vocabulary = ["temple", "tomb", "great"] + [f"w{i}" for i in range(25)]
    weights = [30, 20, 10] + [1] * 25
    titles = sorted({" ".join(dict.fromkeys(rng.choices(vocabulary, weights, k=rng.randint(1, longest)))) for _ in range(250)})
    queries = [sorted(set(rng.choices(vocabulary + ["unseen"], weights + [2], k=rng.randint(1, longest)))) for _ in range(120)]
    articles = spark.createDataFrame([("en", t) for t in [*titles, titles[0]]] + [("en", "- ?"), ("en", None), ("ar", "temple")], "lang STRING, title STRING")
    asked = spark.createDataFrame([(q,) for q in queries], "word_set ARRAY<STRING>")
    index = M.title_index(articles, common_titles=common_titles, common_words=common_words, combo_words=combo_words, block=7)
    want = {q: hits for q, hits in hits_of(queries, titles).items() if hits}
    assert searched(search.ranked_hits(asked, index)) == want
    if common_titles == 2:
        with no_broadcast(spark):
            assert searched(search.ranked_hits(asked, index, min_rows=2)) == want  # every key salted


def test_search_looks_at_few_pairs(spark):
    """"egypt" is in a third of the queries and of the titles; default settings."""
    rng = random.Random(3)
    rare = [f"r{i}" for i in range(900)]
    titles = sorted({" ".join(rng.sample(rare, 2) + ["egypt"] * (i % 3 == 0) + ["temple"] * (i % 4 == 0) + ["of"] * (i % 5 == 0)) for i in range(3000)})
    queries = [sorted({rng.choice(rare), "egypt" if i % 3 == 0 else rng.choice(rare), *(["temple", "of"][:i % 4])}) for i in range(600)] + [["egypt"], ["egypt", "of", "temple"]]
    asked = spark.createDataFrame([(q,) for q in queries], "word_set ARRAY<STRING>")
    index = M.title_index(spark.createDataFrame([("en", t) for t in titles], "lang STRING, title STRING"))
    assert {r.word for r in index.common.collect()} == {"egypt", "temple", "of"}
    assert searched(search.ranked_hits(asked, index)) == hits_of(queries, titles)
    pairs = search.candidates(asked, index)
    distinct = {tuple(q) for q in queries}
    most = sum(5 + index.hits * 2 ** len(set(q) & {"egypt", "temple", "of"}) for q in distinct)
    assert pairs.count() <= most
    read = search._met(search._listed(search._asked(asked, index)), index.blocks, ["word", "long", "block"], 10**6).count()
    holders = {w: sum(w in t.split() for t in titles) for w in rare}
    assert read == sum(holders[w] for q in distinct for w in q if w in holders) < len(distinct) * 2 * search.COMMON_TITLES


def km(a, b):
    (lat1, lon1), (lat2, lon2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * nearest.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_region_equals_brute_force(spark):
    """A crowded spot with a third of the points and sites, the rest spread out."""
    rng = random.Random(5)

    def spot():
        if rng.random() < 0.33:
            return (25.7 + rng.random() / 50, 32.6 + rng.random() / 50)
        return (21 + rng.random() * 11, 24 + rng.random() * 13)

    known = [(f"p{i}", *spot(), f"r{i % 27}") for i in range(600)] + [("a twin", 25.0, 30.0, "x"), ("b twin", 25.0, 30.0, "y")]
    sites = [spot() for _ in range(400)] + [(25.0, 30.01), (45.0, 45.0)]
    got = {
        (r.lat, r.lon): (r.place, r.region, r.distance_km)
        for r in RG.nearest_regions(
            spark.createDataFrame(sites + sites[:9] + [(None, 1.0)], "lat DOUBLE, lon DOUBLE"),
            spark.createDataFrame(known, "place STRING, lat DOUBLE, lon DOUBLE, region STRING"),
        ).collect()
    }
    for site in sites:
        best = min((km(site, (lat, lon)), place, region) for place, lat, lon, region in known)
        if best[0] > RG.MAX_KM:
            assert site not in got
        else:
            assert got[site][:2] == best[1:] and abs(got[site][2] - best[0]) < 1e-6


def test_forward_regions(spark):
    gazetteer = spark.createDataFrame(
        [
            ("A, Luxor, Egypt", 1, {"state": "Luxor Governorate"}), ("B, x, Egypt", 1, {"state": "unknown"}), ("B, Egypt", 1, {"province": "Giza"}),
            ("C, Egypt", 2, {"state": "Cairo"}), ("D, Egypt", 1, {"state": "Sohag"}),
        ],
        "query STRING, rank INT, address MAP<STRING, STRING>",
    )
    places = spark.createDataFrame([("A", "Luxor"), ("B", "x"), ("C", ""), ("D", ""), ("E", "")], "name STRING, location STRING")
    got = {r.name: r.region for r in RG.forward_regions(places, gazetteer).collect()}
    assert got == {"A": "Luxor", "B": "Giza", "D": "Sohag"}


@pytest.mark.parametrize("max_km", [20.0, 200.0, None])
def test_nearest_region_at_any_distance_and_place(spark, max_km):
    """High latitudes, both sides of the date line, near a pole, and points far away."""
    rng = random.Random(8)
    known = [(f"p{i}", rng.uniform(-89, 89), rng.uniform(-180, 180), "r") for i in range(60)]
    known += [("north", 60.0, 10.28, "n"), ("line", 10.0, -179.95, "l"), ("pole", 89.9, 100.0, "o"), ("far", 25.8, 30.0, "f")]
    sites = [(60.0, 10.0), (10.0, 179.95), (89.9, -80.0), (25.0, 30.3), (-45.0, 170.0)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(25)]
    found = RG.nearest_regions(
        spark.createDataFrame(sites, "lat DOUBLE, lon DOUBLE"), spark.createDataFrame([*known, ("none", None, None, "z")], "place STRING, lat DOUBLE, lon DOUBLE, region STRING"), max_km
    )
    got = {(r.lat, r.lon): (r.place, round(r.distance_km, 6)) for r in found.collect()}
    wanted = {}
    for site in sites:
        d, place = min((km(site, k[1:3]), k[0]) for k in known)
        if max_km is None or d <= max_km:
            wanted[site] = (place, round(d, 6))
    assert got == wanted


def test_crowded_spot(spark, monkeypatch):
    """10,000 sites and 10,000 points inside 0.01 degrees, points far away, and sites beside the crowd and far from all."""
    rng = np.random.default_rng(7)
    known = np.c_[25.7 + rng.random(10_000) / 100, 32.6 + rng.random(10_000) / 100]
    known = np.r_[known, rng.uniform((-80, -180), (80, 180), (300, 2))]
    sites = np.r_[25.7 + rng.random((10_000, 2)) / 100 + (0, 6.9), np.c_[25.72 + rng.random(300) / 1000, 32.6 + rng.random(300) / 100], rng.uniform((-89, -180), (89, 180), (100, 2))]
    points = spark.createDataFrame([(f"p{i}", float(a), float(b), f"r{i % 27}") for i, (a, b) in enumerate(known)], "place STRING, lat DOUBLE, lon DOUBLE, region STRING")
    asked = spark.createDataFrame([(float(a), float(b)) for a, b in sites], "lat DOUBLE, lon DOUBLE")
    tree = nearest.build(points)
    assert len(tree.levels) > 4 and max(len(r.spots) for r in tree.leaves.collect()) <= nearest.LEAF
    looked_at = []
    lookup = nearest.lookup_join

    def counted(fact, answers, keys, spread_by, min_rows):
        joined = lookup(fact, answers, keys, spread_by, min_rows)
        if "spots" in joined.columns:
            looked_at.append(joined.select(F.sum(F.size("spots"))).first()[0])
        return joined

    monkeypatch.setattr(nearest, "lookup_join", counted)
    got = {(r.lat, r.lon): (r.place, r.distance_km) for r in nearest.nearest(asked, tree).collect()}
    assert len(got) == len(sites)
    def in_space(spots):
        lat, lon = np.radians(spots).T
        return np.c_[np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]

    there = in_space(known)
    for site, at in zip(sites, in_space(sites)):
        place, distance = got[float(site[0]), float(site[1])]
        d = ((there - at) ** 2).sum(axis=1)
        best = tuple(map(float, known[d.argmin()]))
        assert int(place[1:]) == d.argmin() or abs(d[int(place[1:])] - d.min()) < 1e-15
        assert abs(distance - km(tuple(map(float, site)), best)) < 1e-6
    assert looked_at[0] < 8 * nearest.LEAF * len(sites)  # of 10,300 points a site
    with no_broadcast(spark):  # every hot cell salted
        again = {(r.lat, r.lon): r.place for r in nearest.nearest(asked, nearest.build(points, min_rows=10), min_rows=10).collect()}
    assert again == {k: v[0] for k, v in got.items()}


def test_saved_reverse_answers(spark):
    known = spark.createDataFrame([("p", 25.0, 30.0, "Qena"), ("nan", math.nan, 30.0, "x")], "place STRING, lat DOUBLE, lon DOUBLE, region STRING")
    saved = spark.createDataFrame(
        [(25.01, 30.0, {"state": "Luxor Governorate"}), (25.01, 30.0, {"state": "Giza"}), (25.02, 30.0, {"state": "nowhere"}), (1.0, 2.0, {"province": "Cairo"}), (9.0, 9.0, {"state": "Giza"}), (None, 1.0, {"state": "Giza"})],
        "lat DOUBLE, lon DOUBLE, address MAP<STRING, STRING>")
    points = spark.createDataFrame([(25.01, 30.0), (25.02, 30.0), (25.02, 30.0), (1.0, 2.0), (50.0, 50.0), (None, 2.0), (math.nan, 1.0)], "lat DOUBLE, lon DOUBLE")

    def found(*given):
        return {(r.lat, r.lon): r.region for r in RG.reverse_regions(points, *given).collect()}

    assert found(known, saved) == {(25.01, 30.0): "Giza", (25.02, 30.0): "Qena", (1.0, 2.0): "Cairo"}
    assert found(known) == {(25.01, 30.0): "Qena", (25.02, 30.0): "Qena"}
    assert found(None, saved) == {(25.01, 30.0): "Giza", (1.0, 2.0): "Cairo"}
    assert found(None) == {} and found(known.limit(0), saved.limit(0)) == {}
