"""Entities and values taken out of text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import text as T

FACT_PATTERN = (
    rf"(?U)\b(?=[\d{T.initials(L.FACT_SUPERLATIVES + L.FACT_PHRASES + L.FACT_UNITS)}])(?i)(?:"
    rf"(?:{'|'.join(L.FACT_SUPERLATIVES + L.FACT_PHRASES)})\b"
    rf"|\d{{3,4}}\s*(?:{'|'.join(L.FACT_YEAR_MARKS)})\b"
    rf"|(?:{'|'.join(L.FACT_UNITS)})\b[^\n]*\b\d+\b)"
)
FIGURE_PATTERN = T.word_pattern(L.ARTICLE_PHARAOHS, r"\s*" + L.ARTICLE_NUMERAL)
DEITY_PATTERN = T.word_pattern(L.ARTICLE_DEITIES)
FEATURE_PATTERN = T.word_pattern(L.ARTICLE_FEATURES)
PERIOD_PATTERN = T.word_pattern(L.ARTICLE_PERIODS)


def facts(text: Column, limit: int = L.MAX_FACTS) -> Column:
    """Distinct cleaned sentences of a fair length that carry a fact indicator; the first few."""
    low, high = L.FACT_LENGTHS
    told = F.filter(
        T.sentences(text),
        lambda s: F.length(s).between(low, high) & F.rlike(s, F.lit(FACT_PATTERN)),
    )
    return F.slice(F.array_distinct(F.transform(told, T.clean_text)), 1, limit)


def key_figures(text: Column, limit: int = L.MAX_FIGURES) -> Column:
    """Rulers, then deities, distinct by spelling, in order of first occurrence."""
    both = F.array_union(T.find_all(text, FIGURE_PATTERN), T.find_all(text, DEITY_PATTERN))
    return F.slice(both, 1, limit)


def features(text: Column) -> Column:
    """Architecture terms in title case, distinct, in order of first occurrence."""
    # distinct spellings first, so the costly title casing runs on few words
    return F.array_distinct(F.transform(F.array_distinct(T.find_all(text, FEATURE_PATTERN)), T.title_case))


def period(text: Column) -> Column:
    """First period named in the introduction, as spelled there.

    The introduction (the first 2,000 characters) is part of the definition: a period that is only
    named further down is not the site's main one.
    """
    return T.first_match(F.left(text, F.lit(L.INTRO_CHARS)), PERIOD_PATTERN)


def terms(text: Column, categories: list[tuple[str, list[str]]] = L.TERM_CATEGORIES) -> Column:
    """Glossary terms as array<struct<term, category>>, by category, then text order.

    Duplicates are dropped whatever their case; the first category and spelling win.
    """
    found = [_category_terms(text, category, words) for category, words in categories]
    return T.let(F.concat(*found), lambda every: T.first_by(every, lambda t: F.lower(t["term"])))


def _category_terms(text: Column, category: str, words: list[str]) -> Column:
    tail = r"\s*" + L.TERM_NUMERAL if category == "pharaoh" else ""
    spelled = T.distinct_ignoring_case(T.find_all(text, T.word_pattern(words, tail)))
    return F.transform(spelled, lambda w: F.struct(w.alias("term"), F.lit(category).alias("category")))


def sub_location_names(description: Column, limit: int = L.MAX_SUB_LOCATIONS, strict_case: bool = False) -> Column:
    """Names of parts of a site, by pattern order, then text order.

    Matching ignores case, so "Temple of Amun is" gives "Temple Of ... Is"; ``strict_case`` asks for
    capitals instead.  Titles are a function of the lower-cased match, so a plain distinct also
    removes duplicates that differ in case.
    """
    flags = "(?U)" if strict_case else "(?iU)"
    return F.slice(
        F.array_distinct(
            F.concat(*[_titled(description, flags + pattern, prefix) for pattern, prefix in L.SUB_LOCATION_PATTERNS])
        ),
        1,
        limit,
    )


def _titled(description: Column, pattern: str, prefix: str) -> Column:
    found = F.array_distinct(T.find_all(description, pattern))
    return F.transform(found, lambda m: F.concat(F.lit(prefix), T.title_case(m)))


def sub_locations(site: Column, name: Column, description: Column) -> Column:
    """Sub-location records of a site; the site itself if none is named."""
    notable = F.concat(F.lit("Notable feature of "), name)
    short = F.when(description != "", F.left(description, F.lit(L.SHORT_CHARS))).otherwise(
        F.concat(F.lit("Archaeological site: "), name)
    )
    itself = F.array(_sub_location(site, F.lit(1), name, short, description))
    listed = F.transform(
        sub_location_names(description), lambda n, i: _sub_location(site, i + 1, n, notable, F.lit(""))
    )
    return T.let(listed, lambda found: F.when(F.size(found) > 0, found).otherwise(itself))


def _sub_location(site: Column, number: Column, name: Column, short: Column, full: Column) -> Column:
    return F.struct(
        T.sub_location_id(site, number).alias("id"),
        site.alias("siteId"),
        name.alias("name"),
        F.lit("").alias("arabicName"),
        short.alias("shortDescription"),
        F.lit("").alias("imageName"),
        full.alias("fullDescription"),
    )


def search_variants(name: Column, location: Column) -> Column:
    """Article titles to try for a site, best first (repeats are kept, as they do no harm)."""
    lowered = F.lower(name)
    hyphens = F.when(F.contains(name, F.lit("-")), F.replace(name, F.lit("-"), F.lit(" ")))
    blanks = F.when(F.contains(name, F.lit(" ")), F.replace(name, F.lit(" "), F.lit("-")))
    spelled = [
        F.when(F.contains(lowered, F.lit(old)), T.title_case(F.replace(lowered, F.lit(old), F.lit(new))))
        for old, new in L.TRANSLITERATIONS
    ]
    located = F.coalesce(location, F.lit("")) != ""
    no_temple = ~F.contains(lowered, F.lit("temple"))
    pyramid = ~F.contains(lowered, F.lit("pyramid")) & T.any_contains(lowered, L.PYRAMID_FIELDS)
    bare = F.replace(F.replace(name, F.lit("The "), F.lit("")), F.lit("the "), F.lit(""))
    candidates = [
        name,
        hyphens,
        blanks,
        *spelled,
        F.when(located, F.concat(name, F.lit(" ("), location, F.lit(")"))),
        F.when(located, F.concat(name, F.lit(", "), location)),
        F.when(no_temple, F.concat(name, F.lit(" Temple"))),
        F.when(no_temple, F.concat(F.lit("Temple of "), name)),
        F.when(pyramid, F.concat(name, F.lit(" Pyramid"))),
        F.when(bare != name, bare),
    ]
    return F.filter(F.array(*candidates), lambda v: v.isNotNull())


def search_queries(name: Column, location: Column) -> Column:
    """Full-text queries to try, in order, when no title variant exists."""
    located = F.coalesce(location, F.lit("")) != ""
    return F.filter(
        F.array(
            F.concat(name, F.lit(" " + L.COUNTRY)),
            name,
            F.when(located, F.concat_ws(" ", name, location)),
        ),
        lambda q: q.isNotNull(),
    )


def name_parts(name: Column) -> Column:
    """Lower-cased words of a name; hyphens and underscores separate words."""
    spaced = T.collapse(F.translate(F.lower(name), "-_", "  "))
    return F.filter(F.split(spaced, " "), lambda p: p != "")


def token_overlap(name: Column, title: Column) -> Column:
    """How many words of the name occur in the title."""
    lowered = F.lower(title)
    return F.size(F.filter(name_parts(name), lambda p: F.contains(lowered, p)))


def is_relevant(name: Column, title: Column, snippet: Column) -> Column:
    """A search hit is kept for a domain word in its snippet or for enough shared words."""
    enough = token_overlap(name, title) >= F.floor(F.size(name_parts(name)) / 2)
    return T.any_contains(F.lower(snippet), L.RELEVANCE_KEYWORDS) | enough


def opening_hours(text: Column) -> Column:
    """Weekday to hours, from one line per day.

    The first weekday (Monday first) named in a line counts; a later line replaces an earlier one.  The
    map is built from de-duplicated entries, so it needs no session setting for repeated keys.
    """
    told = F.filter(F.transform(F.split(text, "\n"), _hours_entry), lambda e: e["value"].isNotNull())
    return F.map_from_entries(T.let(told, _latest_per_day))


def _latest_per_day(entries: Column) -> Column:
    days = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(days, lambda d: F.element_at(F.filter(entries, _same_day(d)), -1))


def _same_day(day: Column):
    return lambda e: e["key"] == day


def _hours_entry(line: Column) -> Column:
    return T.let(F.lower(line), lambda lowered: T.let(_weekday(lowered), lambda day: _day_and_hours(line, lowered, day)))


def _weekday(lowered: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(d.lower())), F.lit(d)) for d in L.WEEKDAYS])


def _day_and_hours(line: Column, lowered: Column, day: Column) -> Column:
    closed = F.when(F.contains(lowered, F.lit("closed")), F.lit("Closed"))
    value = T.let(hours_range(line), lambda hours: F.when(hours != "", hours).otherwise(closed))
    return F.struct(day.alias("key"), F.when(day.isNotNull(), value).alias("value"))


def hours_range(text: Column) -> Column:
    """First time range as "start - end", else an empty string.

    The text is searched once; start and end are taken from what was found, where the pattern, which looks at nothing
    around it, matches in the same way.
    """
    pattern = "(?iU)" + L.TIME_RANGE

    def parts(found: Column) -> Column:
        start, end = T.first_match(found, pattern, 1), T.first_match(found, pattern, 2)
        return F.when(found != "", F.concat(start, F.lit(" - "), end)).otherwise(F.lit(""))

    return T.let(T.first_match(text, pattern, 0), parts)


def coordinate(url: Column, part: int) -> Column:
    """Latitude (part 1) or longitude (part 2) of a map address, else null."""
    return F.nullif(T.first_match(url, "(?U)" + L.MAP_COORDS, part), F.lit("")).try_cast("double")


def rating(text: Column) -> Column:
    """First number of the text if it lies between 0 and 5."""
    found = T.first_match(text, "(?U)" + L.RATING_NUMBER)
    number = T.let(found, lambda digits: F.nullif(digits, F.lit("")).try_cast("double"))
    return T.let(number, lambda n: F.when(n.between(0, 5), n))


def review_count(text: Column) -> Column:
    digits = F.replace(T.first_match(text, "(?iU)" + L.REVIEW_COUNT), F.lit(","), F.lit(""))
    return F.nullif(digits, F.lit("")).try_cast("int")


def address_region(address: Column) -> Column:
    """Region of a geocoder address: the first field that names one."""
    return F.coalesce(*[_field_region(F.try_element_at(address, F.lit(f))) for f in L.ADDRESS_FIELDS])


def _field_region(value: Column) -> Column:
    bare = F.lower(value)
    for suffix in L.ADDRESS_SUFFIXES:
        bare = F.replace(bare, F.lit(suffix), F.lit(""))
    return T.lookup(L.REGION_ALIASES, T.strip(bare))
