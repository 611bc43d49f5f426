from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import rules as R


def test_era(values):
    got = values(
        R.era, "built during the old kingdom period", "dates to the middle kingdom", "constructed in the new kingdom",
        "built during the 18th dynasty", "ptolemaic temple dedicated to", "roman period", "mamluk architecture",
        "coptic church built", "no era keywords here", "a romance", "islamic and coptic", "old kingdom, new kingdom",
    )
    assert got == [
        "Old Kingdom", "Middle Kingdom", "New Kingdom", "New Kingdom", "Ptolemaic", "Roman", "Islamic", "Roman", "",
        "Roman", "Islamic", "Old Kingdom",
    ]


def test_tourism_type(values):
    got = values(
        R.tourism_type, ("Old Kingdom", "", "Pyramid"), ("Roman", "", "Temple"), ("Islamic", "", "Mosque"),
        ("", "coptic church", "Church"), ("", "", "Madrasa of X"), ("", "ptolem", ""), ("", "", "Mound"),
        ("Late Period", "mosque", ""),
    )
    assert got == ["Pharaonic", "Greco-Roman", "Islamic", "Coptic", "Islamic", "Greco-Roman", "Pharaonic", "Pharaonic"]


def test_place_type(values):
    got = values(
        R.place_type, ("Great Pyramid", ""), ("Karnak Temple", ""), ("Tomb of Ramesses", ""), ("Egyptian Museum", ""),
        ("Al-Azhar Mosque", ""), ("", "ancient monastery"), ("Qaitbay Citadel", ""), ("Roman Amphitheatre", ""),
        ("Unknown Site", ""), ("Tomb", "near the temple"),
    )
    assert got == ["Pyramid", "Temple", "Tomb", "Museum", "Mosque", "Church", "Fortress", "Monument", "Ruins", "Temple"]


def test_extended_rules(values):
    assert values(lambda c: R.era(c, L.ERA_RULES_EXT), "byzantine walls", "hellenistic", "19th century") == ["Roman", "Ptolemaic", "Modern"]
    assert values(lambda n, d: R.place_type(n, d, L.PLACE_RULES_EXT), ("Khan", ""), ("", "a bazaar"), ("", "burial"))[1:] == ["Market", "Tomb"]


def test_regions(values):
    got = values(
        R.known_place_region, "Karnak Temple", "Giza Plateau", "Great Sphinx", "Avenue of the Sphinx", "Pyramid of X",
        "The pyramids", "Saint Catherine Monastery", "Nowhere",
    )
    assert got == ["Luxor", "Giza", "Giza", "Giza", None, "Giza", "South Sinai", None]
    assert values(R.alias_region, " Cairo ", "fayoum", "matrouh", "WADI AL-JADID", "", "Paris") == [
        "Cairo", "Faiyum", "Matruh", "New Valley", None, None,
    ]
    assert values(R.is_region, "Cairo", "CAIRO", "") == [True, False, False]
    assert len(L.REGION_NAMES) == 27


def test_in_bounds(values):
    assert values(R.in_bounds, (25.7, 32.6), (20.9, 32.6), (25.7, 37.1), (21.0, 24.0)) == [True, False, False, True]


def test_official_website(values):
    got = values(R.official_website, "Egyptian Museum", "Grand Egyptian Museum", "GEM", "Gem Hall", "Bibliotheca X", "Karnak")
    first, gem, library = (url for _, url in L.OFFICIAL_SITE_RULES)
    assert got == [first, first, gem, gem, library, ""]


def test_official_domain(values):
    got = values(
        R.is_official_domain, "https://egypt.travel/x", "http://www.egypt.travel", "https://notegypt.travel/", "https://egypt.travel.example/",
        "no url at all",
    )
    assert got == [True, True, False, False, False]


def test_prices(values):
    assert values(R.mentions_price, "EGP 50", "costs 450 egp", "120 Egyptian pound", "50 EUR") == [True, True, True, False]
    assert values(R.price_amount, "120 EGP or EGP 7", "120 Egyptian pounds", "free") == [7, 120, None]


def test_hours_mention(values):
    assert values(R.mentions_hours, "Monday 9", "Wednesday 9", "OPEN", "") == [True, False, True, False]


def test_tips(values):
    def of(*args):
        return values(R.contextual_tips, args)[0]

    general = L.GENERAL_TIPS
    assert of("Great Pyramid", "Ruins", "", "") == general + L.PYRAMID_TIPS
    assert of("Valley of X", "Temple", "Pharaonic", "Luxor") == general + L.TOMB_TIPS + [L.CITY_RULES[0][1], L.TOURISM_TIP_RULES[0][1]]
    mosque = of("X", "Mosque", "Islamic", "Cairo")
    assert mosque == general + L.MOSQUE_TIPS + [L.CITY_RULES[2][1], L.TOURISM_TIP_RULES[1][1]]
    assert of("X", "Market", "Coptic", "Alexandria") == general + [L.CITY_RULES[1][1]]


def test_duration_and_time(values):
    got = values(R.visit_duration, ("Karnak", "Temple"), ("X", "Museum"), ("X", "Church"), ("X", "Monument"))
    assert got == ["3-4 hours", "2-3 hours", "30 minutes - 1 hour", "1-2 hours"]
    got = values(R.best_time, ("Ruins", "Luxor"), ("Museum", "Luxor"), ("Fortress", "aswan"), ("Fortress", "Cairo"))
    assert got == [L.BEST_TIME_BY_TYPE[0][1], L.BEST_TIME_BY_TYPE[1][1], L.BEST_TIME_HOT[1], L.DEFAULT_BEST_TIME]


def test_site_tips_order(values):
    got = values(R.site_tips, ("Egyptian Museum", "Museum", "Coptic", "Cairo"))[0]
    assert got[-3:] == [
        "Official website: " + L.OFFICIAL_SITE_RULES[0][1],
        "Recommended visit duration: 2-3 hours",
        "Best time to visit: Weekday mornings for fewer crowds",
    ]
    priced = values(lambda n: R.site_tips(n, F.lit("Tomb"), F.lit(""), F.lit(""), F.lit("200 EGP"), F.lit("")), "X")[0]
    assert priced[4] == "Ticket price (foreigners): 200 EGP" and priced[5].startswith("Recommended visit duration")
