import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import text as T


def test_clean_text(values):
    assert values(T.clean_text, "Built[1] by[23] \n  kings.  ", "a  b", "") == ["Built by kings.", "a b", ""]


def test_sentences(values):
    got = values(T.sentences, "One. Two!  Three?\nFour", "v1.2 is one", "")
    assert got == [["One.", "Two!", "Three?", "Four"], ["v1.2 is one"], [""]]


def test_title_case_is_not_initcap(values):
    got = values(T.title_case, "amun-RA", "god's wife", "18th", "ßig", "temple of  él-x", "")
    assert got == ["Amun-Ra", "God'S Wife", "18Th", "Ssig", "Temple Of  Él-X", ""]


def test_title_case_agrees_with_the_definition(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="abZ é'-19 ", max_size=20), min_size=1, max_size=40))
    def check(words):
        rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i INT, w STRING")
        got = {r.i: r.t for r in rows.select("i", T.title_case(F.col("w")).alias("t")).collect()}
        assert [got[i] for i in range(len(words))] == [w.title() for w in words]

    check()


def test_distinct_ignoring_case_keeps_first_spelling(values):
    got = values(lambda s: T.distinct_ignoring_case(F.split(s, ",")), "Ra,RA,Mut,ra,mut,Set")
    assert got == [["Ra", "Mut", "Set"]]


def test_phonetic_guide(values):
    got = values(T.phonetic_guide, "Nephthys", "phoenix", "Seth", "Aegeis", "ra", "colossus")
    assert got == ["Ne-Fthys", "Foenix", "Seth", "Eegays", "Ra", "Co-Lo-Ssu-S"]


def test_pronounce_prefers_the_guide(values):
    assert values(T.pronounce, "RAMESSES", " amun ", "Sobek") == ["Ram-sees", "AH-moon", "Sobek"]


def test_page_type_label(values):
    got = values(T.page_type_label, "museums", "sunken-monuments", "old-town walls")
    assert got == ["Museums", "Sunken Monuments", "Old Town Walls"]


def test_urls(values):
    assert values(T.arabic_url, "https://x/en/a/en/b") == ["https://x/ar/a/ar/b"]
    assert values(T.percent_encode, "Abu Simbel, a/b~*é") == ["Abu%20Simbel%2C%20a/b~%2A%C3%A9"]
    assert values(T.listing_url, "museums") == [L.BASE_URL + "/en/museums/"]
    assert values(T.maps_url, "Abu Simbel") == [L.MAPS_SEARCH_URL + "Abu%20Simbel%20Egypt"]


def test_has_arabic(values):
    assert values(T.has_arabic, "معبد", "x ي", "Temple") == [True, True, False]


def test_ids(values):
    assert values(T.site_id, 7, 1234) == ["site_007", "site_1234"]
    assert values(T.sub_location_id, ("site_007", 3)) == ["site_007_sub_03"]
    assert values(T.card_id, "site_007_sub_03") == ["site_007_sub_03_card_01"]


def test_glossary_text_takes_the_whole_description_and_the_article_introduction(values):
    long = "x" * 5000
    got = values(T.glossary_text, ("N", long, "y" * 3000))[0]
    assert got == "N " + long + " " + "y" * 2000


def test_word_pattern_halves_nothing_away(values):
    """The first-letter look-ahead never hides a word, whatever its case."""
    for words in (L.ARTICLE_DEITIES, L.TERM_ARCHITECTURE, L.ARTICLE_PERIODS):
        text = " ".join(w.upper() + ", " + w.lower() + "; " + w for w in words)
        got = values(lambda t: T.find_all(t, T.word_pattern(words)), text)[0]  # noqa: B023
        wanted = re.findall(rf"\b({'|'.join(words)})\b", text, re.IGNORECASE)
        assert got == wanted
