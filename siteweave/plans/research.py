"""From listing and stored crawl to one row per site."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from siteweave import lexicons as L
from siteweave.functions import extract as X
from siteweave.functions import html as H
from siteweave.functions import rules as R
from siteweave.functions import text as T
from siteweave.operators import glossary as G
from siteweave.operators import match as M
from siteweave.operators import region as RG
from siteweave.operators.joins import HOT_ROWS, is_small, lookup_join, number_rows
from siteweave.session import staged
from siteweave.sources import tables


@dataclass(frozen=True)
class Crawl:
    """The stored inputs of a run."""

    listing: DataFrame
    pages: DataFrame
    articles: DataFrame
    gazetteer: DataFrame
    known_points: DataFrame | None = None
    reverse: DataFrame | None = None
    place_info: DataFrame | None = None


def type_rank(page_types: list[str] | None = None) -> Column:
    """Position of a row's page type in the run's order; types that the order leaves out come last."""
    order = page_types or L.PAGE_TYPES
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("page_type"))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def one_per(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key: the least by all other columns, nulls last (a snapshot may hold a row twice).

    Repeated keys are found from the key columns alone.  Only their rows are compared, so a snapshot without repeats
    passes through without a shuffle of its other columns.
    """
    repeated = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys))
    if repeated.isEmpty():
        return rows
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(*[F.struct(F.col(c).isNull(), F.to_json(c) if isinstance(rows.schema[c].dataType, MapType) else F.col(c)) for c in others])
    several = rows.join(repeated, list(keys), "left_semi")
    one = several.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")
    return rows.join(repeated, list(keys), "left_anti").unionByName(one.select(*rows.columns))


def blank_texts(listing: DataFrame) -> DataFrame:
    """Listing rows with blank instead of null texts."""
    return listing.fillna({c: "" for c in ("name", "location", "description", "image")})


def snapshot(crawl: "Crawl") -> "Crawl":
    """The inputs with one row per article and answer, and blank instead of null listing texts.

    Pages are reduced in ``page_rows``, when their markup has been read.
    """
    return replace(
        crawl, listing=blank_texts(crawl.listing), articles=one_per(crawl.articles, "lang", "title"), gazetteer=one_per(crawl.gazetteer, "query", "rank"),
        place_info=None if crawl.place_info is None else one_per(crawl.place_info, "name"),
    )


def first_of_each_type(listing: DataFrame, max_sites: int | None) -> DataFrame:
    """The first ``max_sites`` rows of each page type in page order; all of them without a number.

    Spark applies the limit within each partition before it shuffles.
    """
    if max_sites is None:
        return listing
    order = Window.partitionBy("page_type").orderBy("pos")
    return listing.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_sites).drop("_n")


def of_types(listing: DataFrame, page_types: list[str] | None) -> DataFrame:
    return listing if page_types is None else listing.filter(F.col("page_type").isin(page_types))


def page_contents(pages: DataFrame, *kept: str) -> DataFrame:
    """What a page says: heading (null if there is none), description, gallery images, Arabic heading; markup is read once."""
    seen = F.col("seen")
    return pages.select("url", H.visible(F.col("html")).alias("seen"), *kept).select(
        "url",
        H.page_title(seen, F.lit(None).cast("string")).alias("page_heading"),
        H.description(seen).alias("full_description"),
        H.images(seen, F.lit(None).cast("string"), limit=L.MAX_IMAGES + 1).alias("gallery"),
        H.arabic_heading(seen).alias("arabic_name"),
        *kept,
    )


def addresses(listing: DataFrame) -> DataFrame:
    """Addresses of the listed sites' pages, English and Arabic."""
    return listing.select(F.explode(F.array("url", T.arabic_url(F.col("url")))).alias("url")).distinct()


def cut_to_few(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """Only the pages of a listing that is small enough to be broadcast; of a longer one all pages, as no exchange is to carry markup."""
    return pages.join(F.broadcast(addresses(listing)), "url", "left_semi") if is_small(listing) else pages


def arabic_names(contents: DataFrame) -> DataFrame:
    """Arabic headings by page address."""
    return contents.select(F.col("url").alias("arabic_url"), "arabic_name").filter("arabic_name <> ''")


def with_headings(listing: DataFrame, contents: DataFrame) -> DataFrame:
    """Listing rows with their page's heading and Arabic name; rows without a page are dropped, and no page text is moved."""
    joined = (
        listing.join(contents.select("url", "page_heading"), "url")
        .withColumn("arabic_url", T.arabic_url(F.col("url")))
        .join(arabic_names(contents), "arabic_url", "left")
    )
    return joined.select(
        *listing.columns, F.coalesce("page_heading", "name").alias("heading"), F.coalesce("arabic_name", F.lit("")).alias("arabic_name")
    )


def with_texts(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows of ``with_headings`` with their page's texts and classes: the one exchange that carries page texts."""
    lowered = F.col("_lowered")
    listed = F.when(F.coalesce("image", F.lit("")) != "", F.array("image")).otherwise(F.array().cast("array<string>"))
    texts = rows.join(contents.select("url", "full_description", "gallery"), "url").select(
        *rows.columns,
        "full_description",
        F.slice(F.array_distinct(F.concat(listed, "gallery")), 1, L.MAX_IMAGES).alias("images"),
        F.lower("full_description").alias("_lowered"),
    )
    return (
        texts.withColumn("era", R.era(lowered))
        .withColumn("tourism_type", R.tourism_type(F.col("era"), lowered, F.col("heading")))
        .withColumn("place_type", R.place_type(F.col("heading"), lowered))
        .drop("_lowered")
    )


def page_rows(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """Listing rows with their page's content, classes and Arabic name; rows without a page are dropped.

    Each page is read once, before any shuffle; its texts are written, and the joins carry texts, not markup.
    """
    contents = one_per(staged(page_contents(pages)), "url")
    return with_texts(with_headings(listing, contents), contents)


def page_facts(listing: DataFrame, pages: DataFrame, gazetteer: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Page rows with the coordinates of their heading."""
    contents = one_per(staged(page_contents(pages)), "url")
    rows = staged(with_headings(listing.drop("description"), contents))
    return with_texts(with_coordinates(rows, gazetteer, min_rows), contents)


def with_coordinates(rows: DataFrame, gazetteer: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    answers = RG.coordinates(rows.select("heading").distinct(), gazetteer)
    return lookup_join(rows, answers, ["heading"], ["url"], min_rows)


def numbered(listing: DataFrame, pages: DataFrame, first_number: int = 0, page_types: list[str] | None = None) -> DataFrame:
    """Listing rows that have a page, numbered over all types in the order given, with their site id; given ids are kept."""
    kept = listing.join(pages.select("url"), "url", "left_semi")
    if "id" in listing.columns:
        return kept.drop("_tie")
    tie = F.col("_tie") if "_tie" in listing.columns else None
    rows = number_rows(kept, "pos", "site_number", groups=["page_type"], order=type_rank(page_types), tie=tie)
    return rows.withColumn("id", T.site_id(F.col("site_number") + first_number)).drop("site_number", "_tie")


def shortened(listing: DataFrame) -> DataFrame:
    """Listing rows with as much of their description as a site row shows, so later steps do not move the rest.

    ``_tie`` orders rows of one position in the numbering, and is made from the whole row.
    """
    tie = F.xxhash64("url", *[c for c in listing.columns if c != "url"])
    return listing.withColumns({"_tie": tie, "description": F.left("description", F.lit(L.SHORT_CHARS))})


def place_info(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Opening hours, coordinates and ratings out of captured map-page texts."""
    hours = F.col("hours_text")
    told = R.mentions_hours(hours)
    return captures.select(
        *keys,
        F.when(told, hours).otherwise(F.lit("")).alias("opening_hours_text"),
        F.when(told, X.opening_hours(hours)).alias("opening_hours"),
        F.when(told, X.hours_range(hours)).otherwise(F.lit("")).alias("opening_hours_simple"),
        X.coordinate(F.col("map_url"), 1).alias("latitude"),
        X.coordinate(F.col("map_url"), 2).alias("longitude"),
        X.rating(F.col("rating_text")).alias("rating"),
        X.review_count(F.col("review_text")).alias("review_count"),
    )


def dossiers(names: DataFrame, crawl: Crawl, dictionary: DataFrame, **match_options) -> DataFrame:
    """What depends on (name, location) alone, one row per distinct pair; of the article only its title (see ``matched_facts``)."""
    keys = ["name", "location"]
    matched = M.match_articles(names, crawl.articles, **match_options).drop("how")
    open_names = names.filter(RG.cheap_region(F.col("name"), F.col("location")).isNull())
    forward = RG.forward_regions(open_names, crawl.gazetteer).withColumnRenamed("region", "forward_region")
    rows = names.join(matched, keys, "left").join(forward, keys, "left")
    rows = rows.join(G.name_translations(names, dictionary), "name", "left")
    if crawl.place_info is not None:
        rows = rows.join(crawl.place_info.select("name", "opening_hours_text", "rating", "review_count"), "name", "left")
    return rows


def matched_facts(answers: DataFrame, articles: DataFrame) -> DataFrame:
    """What site rows take from the articles that some dossier matches, by title; other articles are not mined."""
    titles = staged(answers.select("title").filter("title is not null").distinct())
    found = articles.filter("lang = 'en'").join(titles, "title", "left_semi")
    facts = M.article_facts(found.unionByName(articles.filter("lang = 'ar'")))
    return staged(facts.select("title", *OF_ARTICLE))


def dictionary_of(crawl: Crawl) -> DataFrame:
    """The translations that a run looks up, written once."""
    return staged(tables.dictionary(crawl.listing.sparkSession, M.article_pairs(crawl.articles)))


# what site_rows reads of a listing row, its page and its dossier
OF_LISTING = ["id", "name", "description", "page_type", "url"]
OF_PAGE = ["arabic_name", "full_description", "images", "era", "tourism_type", "place_type", "latitude", "longitude", "governorate"]
OF_DOSSIER = ["name_arabic", "opening_hours_text", "rating", "review_count"]
OF_ARTICLE = ["historical_period", "intro", "unique_facts", "key_figures", "architectural_features", "article_url"]


def research_rows(
    listing: DataFrame, contents: DataFrame, crawl: Crawl, dictionary: DataFrame, min_rows: int = HOT_ROWS, keep: list[str] = OF_LISTING,
    **match_options,
) -> DataFrame:
    """What ``site_rows`` reads, and the columns ``keep`` of the listing: one row per listed site that has a page.

    Lookups by name, coordinates or title run on distinct keys and come back through the hot-key-safe join, to rows without
    long texts; what articles and pages say comes last.
    """
    contents = one_per(contents, "url")
    rows = staged(with_headings(listing, contents))
    names = rows.select("name", "location").distinct()
    answers = staged(dossiers(names, crawl, dictionary, **match_options))
    facts = matched_facts(answers, crawl.articles)
    located = staged(with_coordinates(rows, crawl.gazetteer, min_rows))
    known, reverse = located, None
    if crawl.known_points is not None or crawl.reverse is not None:
        known = known.withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
        open_points = located.filter(RG.cheap_region(F.col("name"), F.col("location")).isNull()).select(
            F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
        )
        nearest = RG.reverse_regions(open_points, crawl.known_points, crawl.reverse).withColumnRenamed("region", "reverse_region")
        known = lookup_join(known, nearest, ["lat", "lon"], ["url"], min_rows)
        known = known.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
        reverse = F.col("reverse_region")
    known = lookup_join(known, answers, ["name", "location"], ["url"], min_rows)
    region = RG.resolve_region(F.col("name"), F.col("location"), F.col("forward_region"), reverse)
    known = lookup_join(staged(known.withColumn("governorate", region)), facts, ["title"], ["url"], min_rows)
    return with_texts(known, contents).select(*keep, *OF_PAGE, *[c for c in OF_DOSSIER if c in known.columns], *OF_ARTICLE)


def research_sites(
    crawl: Crawl, first_number: int = 0, min_rows: int = HOT_ROWS, page_types: list[str] | None = None, **match_options
) -> DataFrame:
    """One complete row per listed site that has a page (plus its ``page_type`` and ``url``).

    Page texts and dossiers are written once and read by every later step.
    """
    crawl = snapshot(crawl)
    listing = staged(numbered(shortened(crawl.listing), crawl.pages, first_number, page_types))
    contents = staged(page_contents(cut_to_few(crawl.pages, listing)))
    dictionary = dictionary_of(crawl)
    known = research_rows(listing, contents, crawl, dictionary, min_rows, **match_options)
    return site_rows(known.withColumn("translations", G.lexicon_translations(dictionary)))


def _or_empty(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def _or_no_items(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def site_rows(known: DataFrame) -> DataFrame:
    """Merge page, article, region, glossary and advice into the site row."""
    name, place, tourism, city = (F.col(c) for c in ("name", "place_type", "tourism_type", "governorate"))
    text = T.glossary_text(name, F.col("full_description"), F.col("intro"))
    terms = G.glossary(text, name, F.col("name_arabic"), F.col("translations"))
    has_places = "rating" in known.columns
    none_of = F.lit(None)
    return known.select(
        "id",
        "name",
        F.col("arabic_name").alias("arabicName"),
        F.coalesce(F.nullif("historical_period", F.lit("")), "era").alias("era"),
        tourism.alias("tourismType"),
        place.alias("placeType"),
        "governorate",
        "latitude",
        "longitude",
        F.left("description", F.lit(L.SHORT_CHARS)).alias("shortDescription"),
        F.col("full_description").alias("fullDescription"),
        F.col("images").alias("imageNames"),
        R.visit_duration(name, place).alias("estimatedDuration"),
        R.best_time(place, city).alias("bestTimeToVisit"),
        (_or_empty("opening_hours_text") if has_places else F.lit("")).alias("openingHours"),
        R.official_website(name).alias("officialWebsite"),
        X.sub_locations(F.col("id"), name, F.col("full_description")).alias("subLocations"),
        R.site_tips(name, place, tourism, city).alias("tips"),
        terms.alias("arabicPhrases"),
        _or_no_items("unique_facts").alias("uniqueFacts"),
        _or_no_items("key_figures").alias("keyFigures"),
        _or_no_items("architectural_features").alias("architecturalFeatures"),
        _or_empty("article_url").alias("wikipediaUrl"),
        (F.col("rating") if has_places else none_of.cast("double")).alias("rating"),
        (F.col("review_count") if has_places else none_of.cast("int")).alias("reviewCount"),
        "page_type",
        "url",
    )


def research_all(
    crawl: Crawl, page_types: list[str] | None = None, max_sites: int | None = None, **options
) -> DataFrame:
    """Research the first ``max_sites`` rows of the chosen page types, ids in type and page order."""
    chosen = first_of_each_type(of_types(crawl.listing, page_types), max_sites)
    return research_sites(replace(crawl, listing=chosen), page_types=page_types, **options)
