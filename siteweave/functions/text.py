"""Text scalars.

Every function takes and returns Column expressions.  Regular expressions carry ``U`` so that ``\\b``,
``\\s`` and ``\\d`` mean the same for accented and Arabic text on every Java release.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import lexicons as L


def strip(c: Column) -> Column:
    """Trim every kind of white space (``trim`` handles blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Turn each run of white space into one blank and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Drop ``[12]``-style reference marks, then collapse white space."""
    return collapse(F.regexp_replace(c, r"(?U)\[\d+\]", ""))


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` that white space follows."""
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def title_case(c: Column) -> Column:
    """Capital after every non-letter ("Amun-Ra", "God'S Wife"), which ``initcap`` does not do."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, _capital), "")


def _capital(w: Column) -> Column:
    # one letter may become two ("ß" to "Ss"); only the first of them is a capital
    first = F.upper(F.left(w, F.lit(1)))
    return F.concat(F.left(first, F.lit(1)), F.lower(F.substring(first, 2, 9)), F.substring(w, 2, 2147483647))


def any_contains(c: Column, words: list[str]) -> Column:
    """True where ``c`` contains at least one of the words (plain substrings)."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def initials(words: list[str]) -> str:
    """Character class members for the first letters of the words, in every case."""
    letters = {w[0].lower() for w in words} | {w[0].upper() for w in words}
    folded = {"s": "\u017f", "k": "\u212a"}  # long s and the Kelvin sign fold to s and k
    return "".join(sorted(letters | {folded[c] for c in letters if c in folded}))


def word_pattern(words: list[str], tail: str = "") -> str:
    """One case-insensitive whole-word alternation with the word as group 1.

    The look-ahead on the first letter turns most word starts down before the alternatives are tried;
    it halves the time of a scan.
    """
    return rf"(?U)\b(?=[{initials(words)}])(?i)({'|'.join(words)}){tail}\b"


def find_all(c: Column, pattern: str) -> Column:
    """Group 1 of every match, in text order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, else an empty string."""
    return F.regexp_extract(c, pattern, group)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda would be computed again for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_ignoring_case(words: Column) -> Column:
    """Keep the first spelling of every word, in order.

    Exact repeats go first through the hash-based ``array_distinct``, so the quadratic step sees only
    different spellings.
    """
    return let(F.array_distinct(words), lambda exact: first_by(exact, F.lower))


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order; ``items`` must be a column or a :func:`let` variable."""
    return let(
        F.transform(items, lambda x: key(x)),
        lambda keys: F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1),
    )


def phonetic_guide(term: Column) -> Column:
    """Rule-made pronunciation of a term: six replacements, then syllable hyphens in long words."""
    spoken = reduce(lambda c, r: F.regexp_replace(c, f"(?i){r[0]}", r[1]), L.PHONETIC_RULES, term)
    return let(spoken, lambda word: title_case(F.when(F.length(word) > 6, _syllables(word)).otherwise(word)))


def _syllables(word: Column) -> Column:
    return F.regexp_replace(word, "(?iu)([aeiou])([^aeiou])", "$1-$2")


def literal_map(entries: dict[str, str]) -> Column:
    """A constant map; only for lexicons of a fixed, small size."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def lookup(entries: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a constant lexicon, null on a miss."""
    return F.try_element_at(literal_map(entries), key)


def pronounce(term: Column) -> Column:
    """Guide entry of the term, else its rule-made pronunciation."""
    return F.coalesce(lookup(L.PRONUNCIATION, F.lower(strip(term))), phonetic_guide(term))


def page_type_label(page_type: Column) -> Column:
    """Display name of a page type."""
    spaced = F.replace(page_type, F.lit("-"), F.lit(" "))
    return F.coalesce(lookup(L.PAGE_TYPE_LABELS, page_type), title_case(spaced))


def percent_encode(c: Column) -> Column:
    """Encode a query part; blanks become ``%20`` and slashes stay."""
    encoded = F.url_encode(c)
    for old, new in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def listing_url(page_type: Column, base_url: str = L.BASE_URL) -> Column:
    return F.concat(F.lit(base_url + "/en/"), page_type, F.lit("/"))


def geocode_url(query: Column, with_address: bool = False) -> Column:
    detail = "&addressdetails=1" if with_address else ""
    return F.concat(
        F.lit(L.GEOCODER_URL + "?q="), percent_encode(query), F.lit(f"&format=json{detail}&limit=1")
    )


def maps_url(name: Column, location: Column | None = None) -> Column:
    """Map search address of a site; without a location the country is searched."""
    place = F.lit(L.COUNTRY) if location is None else location
    return F.concat(F.lit(L.MAPS_SEARCH_URL), percent_encode(F.concat_ws(" ", name, place)))


def arabic_url(url: Column) -> Column:
    """Address of the Arabic twin of an English page."""
    return F.replace(url, F.lit("/en/"), F.lit("/ar/"))


def has_arabic(c: Column) -> Column:
    return F.rlike(c, F.lit(r"[؀-ۿ]"))


def site_id(number: Column) -> Column:
    return F.format_string("site_%03d", number)


def sub_location_id(site: Column, number: Column) -> Column:
    return F.format_string("%s_sub_%02d", site, number)


def card_id(sub_location: Column) -> Column:
    return F.concat(sub_location, F.lit("_card_01"))


def glossary_text(name: Column, description: Column, article_text: Column | None = None) -> Column:
    """Text the glossary reads: the name, the whole description, and the article's introduction."""
    parts = [name, F.coalesce(description, F.lit(""))]
    if article_text is not None:
        parts.append(F.left(article_text, F.lit(L.INTRO_CHARS)))
    return F.concat_ws(" ", *parts)
