"""Content of crawled pages, read with Spark SQL string functions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import text as T

# The entities that occur in page text; the ampersand comes last so that nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
# Elements whose start or end tag ends an open paragraph.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|div|dl|fieldset|footer|form|h[1-6]|header|hr|html|main|nav|ol|"
    "pre|section|table|ul"
)
INVISIBLE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
HEADING = (
    r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>"
    r'|<[a-z][a-z0-9]*\s[^>]*class\s*=\s*"(?:[^"]*\s)?pageTitle(?:\s[^"]*)?"[^>]*>(.*?)</'
)
PARAGRAPH_START = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = rf"(?is)(?:</p\s*>|</?(?:{BLOCK_TAGS})(?:[\s/][^>]*)?>).*$"
GALLERY = r'(?i)<article\b|class\s*=\s*"(?:[^"]*\s)?(?:gallery|slider)(?:\s[^"]*)?"'


def _tail(pieces: Column) -> Column:
    """All pieces of a split but the first."""
    return F.filter(pieces, lambda p, i: i > 0)


def visible(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, INVISIBLE, "")


def decode(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: tags out, entities decoded, white space as a browser shows it."""
    flat = F.regexp_replace(fragment, r"(?U)\s+", " ")
    lines = F.regexp_replace(flat, r"(?i) *<br\s*/?> *", "\n")
    return T.strip(decode(F.regexp_replace(lines, "<[^>]*>", "")))


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute in a start tag, else an empty string."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return decode(F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)))


def page_title(seen: Column, listing_name: Column) -> Column:
    """First heading of the page; the listing's name only if there is no heading element."""
    inner = F.concat(F.regexp_extract(seen, HEADING, 1), F.regexp_extract(seen, HEADING, 2))
    return F.when(F.rlike(seen, F.lit(HEADING)), inner_text(inner)).otherwise(listing_name)


def arabic_heading(seen: Column) -> Column:
    """First ``h1`` if it is written in Arabic, else an empty string."""
    heading = inner_text(F.regexp_extract(seen, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>", 1))
    return F.when(T.has_arabic(heading), heading).otherwise(F.lit(""))


def paragraphs(seen: Column) -> Column:
    """Trimmed texts of all paragraphs, in page order."""
    pieces = _tail(F.split(seen, PARAGRAPH_START))
    return F.transform(pieces, lambda p: inner_text(F.regexp_replace(p, PARAGRAPH_END, "")))


def content_paragraphs(
    seen: Column, stop_phrases: list[str] = L.STOP_PHRASES, min_length: int = L.MIN_PARAGRAPH
) -> Column:
    """Paragraphs that are long enough and hold no boilerplate phrase."""
    return F.filter(
        paragraphs(seen),
        lambda p: (F.length(p) > min_length) & ~T.any_contains(F.lower(p), stop_phrases),
    )


def description(seen: Column, **filters) -> Column:
    """Content paragraphs joined by blank lines."""
    return F.array_join(content_paragraphs(seen, **filters), "\n\n")


def extended_paragraphs(seen: Column) -> Column:
    """The declared larger filter: footer phrases, and navigation phrases with their own length."""
    kept = F.filter(
        paragraphs(seen),
        lambda p: (F.length(p) > L.MIN_PARAGRAPH) & ~T.any_contains(F.lower(p), L.FOOTER_PHRASES_EXT),
    )
    return F.filter(
        kept,
        lambda p: (F.length(p) > L.MIN_SENTENCE_EXT) & ~T.any_contains(F.lower(p), L.NAVIGATION_PHRASES_EXT),
    )


def gallery_images(seen: Column) -> Column:
    """Image addresses inside articles, galleries and sliders.

    Articles are read to their end tag; a gallery or slider to its last image, that is up to the next
    closing ``section`` or the end of the page.
    """
    zones = _tail(F.split(seen, GALLERY))
    inside = F.transform(zones, lambda z: F.regexp_replace(z, r"(?is)</(?:article|section)\s*>.*$", ""))
    tags = F.flatten(F.transform(inside, lambda z: F.regexp_extract_all(z, F.lit(r"(?is)<img\b([^>]*)>"), F.lit(1))))
    return F.filter(F.transform(tags, lambda t: attribute(t, "src")), lambda s: s != "")


def images(seen: Column, listing_image: Column, limit: int = L.MAX_IMAGES) -> Column:
    """Listing image, then gallery images without logos; distinct, the first few."""
    first = F.when(F.coalesce(listing_image, F.lit("")) != "", F.array(listing_image)).otherwise(
        F.array().cast("array<string>")
    )
    rest = F.filter(gallery_images(seen), lambda s: ~F.contains(F.lower(s), F.lit("logo")))
    return F.slice(F.array_distinct(F.concat(first, rest)), 1, limit)


def listing_cards(html: Column) -> Column:
    """Cards of a listing page as array<struct<href, title, location, description, image>>."""
    pieces = _tail(F.split(visible(html), r"(?i)<a(?=\s)"))
    opened = F.filter(pieces, lambda p: F.rlike(p, F.lit(r'(?is)^[^>]*\bclass\s*=\s*"(?:[^"]*\s)?listItem(?:\s[^"]*)?"')))
    return F.filter(F.transform(opened, _card), lambda c: c["href"] != "")


def _card(piece: Column) -> Column:
    # the parts are computed once each, as several fields read them
    parts = F.struct(
        F.regexp_extract(piece, r"(?s)^([^>]*)>", 1).alias("tag"),
        F.regexp_replace(piece, r"(?is)^[^>]*>|</a\s*>.*$", "").alias("body"),
    )
    return T.let(parts, lambda p: _card_fields(p["tag"], p["body"]))


def _card_fields(tag: Column, body: Column) -> Column:
    image = F.regexp_extract(body, r"(?is)<img\b([^>]*)>", 1)
    return F.struct(
        attribute(tag, "href").alias("href"),
        attribute(tag, "title").alias("title"),
        inner_text(F.regexp_extract(body, _first_paragraph("location", r".*?"), 1)).alias("location"),
        inner_text(F.regexp_extract(body, _first_paragraph("details", r"\s*"), 1)).alias("description"),
        T.let(image, lambda tag_: attribute(tag_, "src")).alias("image"),
    )


def _first_paragraph(css_class: str, gap: str) -> str:
    return (
        rf'(?is)class\s*=\s*"(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"[^>]*>{gap}<p(?:\s[^>]*)?>(.*?)</p\s*>'
    )
