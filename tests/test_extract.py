import random
import re

from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import extract as X

KARNAK = (
    "Karnak was built by Ramesses II. The hypostyle hall is famous. It was dedicated to Amun. It is the largest "
    "religious complex of its time. It became a UNESCO World Heritage site."
)


def test_facts(values):
    got = values(
        X.facts, KARNAK, "It is the largest. Short.", "x" * 290 + " is the oldest one.",
        "Finished in 1477 AD or so, they say. Finished in 1477 A.D. or so, they say, again.",
        "It has many meters lost since 1800 of them. A long sentence without anything notable in it.",
        " ".join(f"This is the only sentence number {i} here." for i in range(9)),
    )
    assert got[0] == ["It is the largest religious complex of its time.", "It became a UNESCO World Heritage site."]
    assert got[1] == [] and got[2] == []
    assert got[3] == ["Finished in 1477 AD or so, they say."]
    assert got[4] == ["It has many meters lost since 1800 of them."]
    assert len(got[5]) == 5


def test_facts_are_cleaned_and_distinct(values):
    text = "It is the oldest[1]   temple around here. It is the oldest temple around[2] here."
    assert values(X.facts, text) == [["It is the oldest temple around here."]]


def test_facts_agree_with_a_plain_reading_of_the_patterns(spark):
    """Random sentences; the same four indicator patterns tried one by one."""
    patterns = [
        rf"\b({'|'.join(L.FACT_SUPERLATIVES)})\b", rf"\b({'|'.join(L.FACT_PHRASES)})\b",
        rf"\b(\d{{3,4}}\s*({'|'.join(L.FACT_YEAR_MARKS)}))\b", rf"\b({'|'.join(L.FACT_UNITS)})\b.*\b\d+\b",
    ]
    rng = random.Random(7)
    words = "first Only meters 12 feetlong BC 300 A.D.x 1200 AD built in stone é square\nmile oldest. UNESCOs most! B.C.E 45".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = {r.i: r.f for r in rows.select("i", X.facts(F.col("t"), 1000).alias("f")).collect()}
    for i, text in enumerate(texts):
        told = [s for s in re.split(r"(?<=[.!?])\s+", text) if 30 <= len(s) <= 300 and any(re.search(p, s, re.I) for p in patterns)]
        clean = [re.sub(r"\s+", " ", re.sub(r"\[\d+\]", "", s)).strip() for s in told]
        assert got[i] == list(dict.fromkeys(clean))


def test_key_figures(values):
    got = values(X.key_figures, KARNAK, "Ra, RA and ra; Ramessesii met Khufu IV", "Rambo set a raft")
    assert got == [["Ramesses", "Amun"], ["Ramesses", "Khufu", "Ra", "RA", "ra"], []]


def test_features(values):
    got = values(X.features, "Hypostyle Hall, a PYLON, the hypostyle hall and a pylon; sphinxes", "mortuary temple")
    assert got == [["Hypostyle Hall", "Pylon"], ["Mortuary Temple"]]


def test_period(values):
    got = values(X.period, "an old kingdom site, later Roman", "nothing", "x" * 1995 + " Roman", "y " + "x" * 1990 + " Roman")
    assert got == ["old kingdom", "", "", "Roman"]  # the introduction ends after 2,000 characters


def test_terms(values):
    text = "The temple of amun and Amun-Ra by king Ramesses II. AMUN's mortuary temple, Temple, re, God's wife."
    got = values(X.terms, text)[0]
    assert [(t["term"], t["category"]) for t in got] == [
        ("Ramesses", "pharaoh"), ("amun", "deity"), ("Ra", "deity"), ("re", "deity"), ("mortuary temple", "architecture"),
        ("king", "title"), ("God's wife", "title"), ("temple", "place_feature"),
    ]


def test_sub_location_quirks(values):
    got = values(
        X.sub_location_names, "Temple of Amun is famous. Tomb of Amun is old.", "Contains the Tomb of Ramesses II and Tomb of Seti I.",
        "The great sphinx, Hypostyle  Hall and HYPOSTYLE  hall", " ".join(f"Temple of {c}mun." for c in "ABCDEFG"),
    )
    assert got[0] == ["Temple of Amun Is", "Tomb of Amun I"]
    assert got[1] == ["Tomb of Ramesses Ii", "Tomb of Seti I"]
    assert got[2] == ["Great Sphinx", "Hypostyle  Hall"]
    assert len(got[3]) == 5
    assert values(lambda d: X.sub_location_names(d, strict_case=True), "Temple of Amun is famous") == [["Temple of Amun"]]


def test_sub_locations_fall_back_to_the_site(values):
    found, itself, empty = values(
        X.sub_locations, ("site_001", "Karnak", "The Sacred Lake."), ("site_002", "Mound", "d" * 300), ("site_003", "Mound", "")
    )
    assert found == [{
        "id": "site_001_sub_01", "siteId": "site_001", "name": "Sacred Lake", "arabicName": "",
        "shortDescription": "Notable feature of Karnak", "imageName": "", "fullDescription": "",
    }]
    assert itself[0]["name"] == "Mound" and itself[0]["shortDescription"] == "d" * 200 and itself[0]["fullDescription"] == "d" * 300
    assert empty[0]["shortDescription"] == "Archaeological site: Mound"


def test_search_variants(values):
    got = values(
        X.search_variants, ("Kom el-Dikka", "Alexandria"), ("Karnak Temple", "Luxor"), ("The Sunken City", ""), ("Saqqara", ""),
    )
    assert got[0] == [
        "Kom el-Dikka", "Kom el Dikka", "Kom-el-Dikka", "Kom El Dikka", "Kom El-Deka", "Kom el-Dikka (Alexandria)",
        "Kom el-Dikka, Alexandria", "Kom el-Dikka Temple", "Temple of Kom el-Dikka",
    ]
    assert got[1] == ["Karnak Temple", "Karnak-Temple", "Karnak Temple (Luxor)", "Karnak Temple, Luxor"]
    assert got[2] == ["The Sunken City", "The-Sunken-City", "The Sunken City Temple", "Temple of The Sunken City", "Sunken City"]
    assert got[3][-1] == "Saqqara Pyramid"


def test_relevance(values):
    got = values(
        X.is_relevant, ("Kom el-Dikka", "Kom", "nothing"), ("Kom el-Dikka Big Site", "Kom", "x"), ("One", "Other", "x"),
        ("Kom el-Dikka Big Site", "Other", "in ALEXANDRIA"),
    )
    assert got == [True, False, True, True]  # a one-word name accepts every hit


def test_hours(values):
    got = values(
        X.opening_hours, "Monday: 9:00 AM - 5:00 PM\nFriday: Closed", "Monday: 9 AM to 5 PM\nnoise\nMonday: 8-2\nTuesday", "9 - 5 Sunday", "",
    )
    assert got == [{"Monday": "9:00 AM - 5:00 PM", "Friday": "Closed"}, {"Monday": "8 - 2"}, {"Sunday": "9  - 5 "}, {}]
    assert values(X.hours_range, "open 10 AM – 4 PM or 5-6", "closed") == ["10 AM - 4 PM", ""]


def test_map_values(values):
    url = "https://maps.example/@25.7188,-32.6573,15z"
    assert values(lambda u: F.array(X.coordinate(u, 1), X.coordinate(u, 2)), url, "https://maps.example/") == [[25.7188, -32.6573], [None, None]]
    assert values(X.rating, "4.8", "5.1", "none", "0") == [4.8, None, None, 0.0]
    assert values(X.review_count, "12,345 reviews", "1 Review", "(77) reviews", ", review") == [12345, 1, None, None]


def test_address_region(spark):
    rows = spark.createDataFrame(
        [(1, {"state": "Luxor Governorate"}), (2, {"state": "nowhere", "county": "Giza محافظة"}), (3, {"city": "Cairo"}), (4, None)],
        "i INT, a MAP<STRING, STRING>",
    )
    got = {r.i: r.r for r in rows.select("i", X.address_region(F.col("a")).alias("r")).collect()}
    assert got == {1: "Luxor", 2: "Giza", 3: None, 4: None}
