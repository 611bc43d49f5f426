"""The registered queries: every operator over the whole given tables.

Array results are shown as joined text, so that any engine's rows compare by value.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave import schemas as S
from siteweave.functions import extract as X
from siteweave.functions import html as H
from siteweave.functions import rules as R
from siteweave.functions import text as T
from siteweave.operators import children, metrics
from siteweave.operators import glossary as G
from siteweave.operators import match as M
from siteweave.operators import region as RG
from siteweave.operators.joins import lookup_join, number_rows
from siteweave.plans import export, incremental, research
from siteweave.plans.research import Crawl
from siteweave.session import local_table, shared_dir, staged
from siteweave.sources import corpus as C
from siteweave.sources import tables
from siteweave.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def shown(c: Column | str, sep: str = " | ") -> Column:
    return F.array_join(c, sep)


def count(c: Column | str) -> Column:
    return F.size(c).cast("long")


def crawl(spark: SparkSession, sf: str) -> Crawl:
    return Crawl(
        C.listing(spark, sf), C.detail_pages(spark, sf), C.articles(spark, sf), C.gazetteer(spark, sf),
        C.gazetteer_points(spark, sf), C.reverse_answers(spark, sf),
    )


def classed(spark: SparkSession, sf: str) -> DataFrame:
    """Described sites with their three classes."""
    lowered = F.col("lowered")
    return (
        C.sites(spark, sf).withColumn("lowered", F.lower("full_description"))
        .withColumn("era", R.era(lowered))
        .withColumn("tourism_type", R.tourism_type(F.col("era"), lowered, F.col("name")))
        .withColumn("place_type", R.place_type(F.col("name"), lowered))
    )


def labelled(spark: SparkSession, sf: str, listing: DataFrame) -> DataFrame:
    """Listing rows that an earlier run is taken to have processed: those of labelled documents."""
    labels = C.table(spark, sf, "labels").select(F.col("doc_id").alias("pos"))
    return listing.join(labels, "pos", "left_semi")


def earlier(spark: SparkSession, sf: str, listing: DataFrame) -> DataFrame:
    """Their progress rows: failed where the label says so."""
    labels = C.table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), "quality")
    return listing.join(labels, "pos").select(
        "url", "name", "page_type",
        F.when(F.col("quality") == 1, F.lit("done")).otherwise(F.lit("failed")).alias("status"),
        F.col("pos").cast("string").alias("batch"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos")).alias("updated_at"),
    )


# ---- scans, sources, sinks ------------------------------------------------------------------------------
@register("listing_scan")
def listing_scan(spark, sf):
    return research.of_types(C.listing(spark, sf), ["museums", "monuments"])


@register("listing_card_extract")
def listing_card_extract(spark, sf):
    cards = children.unnest(C.listing_pages(spark, sf), H.listing_cards(F.col("html")), "c")
    return cards.select(
        F.col("c.href").alias("url"), F.col("c.title").alias("name"), "c.location", "c.description", "c.image", "page_type"
    )


@register("page_scan")
def page_scan(spark, sf):
    return C.detail_pages(spark, sf).select("url", F.length("html").cast("long").alias("html_chars"))


@register("article_scan")
def article_scan(spark, sf):
    return C.articles(spark, sf).select(
        "lang", "title", "summary", "text", "url", F.try_element_at("langlinks", F.lit("ar")).alias("ar_link")
    )


@register("gazetteer_scan")
def gazetteer_scan(spark, sf):
    body = F.to_json(F.array(F.struct("lat", "lon", "address")))
    answers = tables.geo_answers(C.gazetteer(spark, sf).select("query", body.alias("body")))
    return answers.select(
        "query", F.col("rank").cast("long").alias("rank"), "lat", "lon",
        F.try_element_at("address", F.lit("state")).alias("state"),
        F.try_element_at("address", F.lit("province")).alias("province"),
    )


@register("existing_output_scan")
def existing_output_scan(spark, sf):
    path = shared_dir(spark)
    labelled(spark, sf, C.sites(spark, sf)).select("name").write.json(f"{path}/sites")
    return tables.existing_names(spark, path)


@register("checkpoint_scan")
def checkpoint_scan(spark, sf):
    path = shared_dir(spark)
    rows = earlier(spark, sf, C.listing(spark, sf))
    rows.withColumn("status", F.nullif("status", F.lit("done"))).write.parquet(path)
    return tables.processed(spark, path).select("url", "name", "page_type", "status")


@register("checkpoint_document")
def checkpoint_document(spark, sf):
    """Checkpoint documents of 100 listing rows each: whole ones, ones without names, cut ones, and ones with names of a wrong type."""
    rows = C.listing(spark, sf).withColumn("document", F.floor(F.col("pos") / 100))
    lists = rows.groupBy("document").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("url", "name", "page_type")])
    urls, types = F.col("url").alias("processed_urls"), F.col("page_type").alias("page_types_completed")
    whole = F.to_json(F.struct(urls, F.col("name").alias("processed_names"), types, F.size("url").alias("total_processed")))
    mistyped = F.to_json(F.struct(urls, F.array_join("name", ", ").alias("processed_names"), types))
    kind = F.pmod("document", F.lit(4))
    body = (
        F.when(kind == 0, whole).when(kind == 1, F.to_json(F.struct(urls)))
        .when(kind == 2, F.substring(whole, F.lit(1), F.length(whole) - 5)).otherwise(mistyped)
    )
    found = staged(tables.checkpoint_documents(lists.select("document", body.alias("body"))))
    progress = tables.checkpoint_progress(found).select("url", "name")
    types = tables.checkpoint_types(found).select(F.lit("type").alias("kind"), F.col("page_type").alias("value"))
    listed = progress.select(
        F.when(F.col("url") != "", F.lit("url")).otherwise(F.lit("name")).alias("kind"), F.concat("url", "name").alias("value")
    )
    bad = found.filter("malformed").select(F.lit("malformed").alias("kind"), F.col("document").cast("string").alias("value"))
    return listed.unionByName(types).unionByName(bad)


@register("checkpoint_sink")
def checkpoint_sink(spark, sf):
    path = shared_dir(spark)
    rows = earlier(spark, sf, C.listing(spark, sf))
    tables.append(rows.filter("status = 'done'"), path)
    tables.append(rows.filter("status = 'failed'"), path)
    return tables.processed(spark, path).groupBy("page_type", "status").agg(F.count(F.lit(1)).alias("sites"))


@register("checkpoint_reset")
def checkpoint_reset(spark, sf):
    path = shared_dir(spark)
    tables.append(earlier(spark, sf, C.listing(spark, sf)), path)
    before = tables.processed(spark, path).agg(F.count(F.lit(1)).alias("rows")).first()[0]
    tables.reset(spark, path)
    left = tables.processed(spark, path).agg(F.count(F.lit(1)).alias("rows_after"))
    return left.select(F.lit(before).alias("rows_before"), "rows_after")


@register("lexicon_scan")
def lexicon_scan(spark, sf):
    named = C.sites(spark, sf).groupBy(F.lower("location").alias("key")).agg(F.count(F.lit(1)).alias("sites"))
    return tables.lexicon(spark).join(named, "key", "left").select(
        "lexicon", F.col("pos").cast("long").alias("pos"), "key", "value", F.coalesce("sites", F.lit(0)).alias("sites")
    )


# ---- page content ---------------------------------------------------------------------------------------
def seen_pages(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", "url", H.visible(F.col("html")).alias("seen"))


@register("page_title")
def page_title(spark, sf):
    return seen_pages(spark, sf).select("page_id", H.page_title(F.col("seen"), F.lit("")).alias("title"))


@register("paragraph_extract")
def paragraph_extract(spark, sf):
    return seen_pages(spark, sf).select("page_id", H.description(F.col("seen")).alias("full_description"))


@register("boilerplate_filter_ext")
def boilerplate_filter_ext(spark, sf):
    return seen_pages(spark, sf).select(
        "page_id", F.array_join(H.extended_paragraphs(F.col("seen")), "\n\n").alias("full_description")
    )


@register("script_detect")
def script_detect(spark, sf):
    return C.detail_pages(spark, sf).select("url", H.arabic_heading(H.visible(F.col("html"))).alias("arabic_name"))


@register("image_select")
def image_select(spark, sf):
    pages = C.detail_pages(spark, sf).select("url", H.visible(F.col("html")).alias("seen"))
    rows = C.listing(spark, sf).select("url", "image").join(pages, "url")
    return rows.select("url", shown(H.images(F.col("seen"), F.col("image"))).alias("images"))


@register("short_description")
def short_description(spark, sf):
    return C.listing(spark, sf).select("url", F.left("description", F.lit(L.SHORT_CHARS)).alias("short_description"))


@register("page_type_filter")
def page_type_filter(spark, sf):
    cards = children.unnest(C.listing_pages(spark, sf), H.listing_cards(F.col("html")), "c").select("c.href", "c.title")
    return cards.filter(F.contains("href", F.lit("/museums/")))


@register("page_type_label")
def page_type_label(spark, sf):
    kinds = C.listing(spark, sf).select("page_type").unionByName(
        C.table(spark, sf, "documents").select(F.concat_ws("-", "source", "lang", F.lit("pages")).alias("page_type"))
    )
    counts = kinds.groupBy("page_type").agg(F.count(F.lit(1)).alias("sites"))
    return counts.select("page_type", T.page_type_label(F.col("page_type")).alias("label"), "sites")


@register("url_language_swap")
def url_language_swap(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", "url", T.arabic_url(F.col("url")).alias("arabic_url"))


@register("query_urls")
def query_urls(spark, sf):
    rows = C.sites(spark, sf)
    asked = F.concat_ws(", ", "unique_name", "location", F.lit(L.COUNTRY))
    return rows.select(
        "site_key",
        T.listing_url(F.col("page_type")).alias("listing_url"),
        T.geocode_url(asked, with_address=True).alias("geocode_url"),
        T.maps_url(F.col("unique_name")).alias("maps_url"),
    )


@register("official_domain_filter")
def official_domain_filter(spark, sf):
    hosts = F.array(*[F.lit(h) for h in [*L.OFFICIAL_DOMAINS, "www.egypt.travel", "notegypt.travel", "egypt.travel.example"]])
    slot = (F.pmod("doc_id", F.lit(8)) + 1).cast("int")
    made = C.table(spark, sf, "documents").select(F.concat(F.lit("https://"), F.element_at(hosts, slot), F.lit("/"), "doc_id").alias("url"))
    links = made.unionByName(C.table(spark, sf, "pages").select("url"))
    return links.select("url", R.is_official_domain(F.col("url")).alias("is_official"))


@register("geo_bounds_filter")
def geo_bounds_filter(spark, sf):
    points = C.site_points(spark, sf).withColumn("lat", F.col("lat") * 1.125)
    return points.filter(R.in_bounds(F.col("lat"), F.col("lon")))


# ---- rule classifiers -----------------------------------------------------------------------------------
@register("era_classify")
def era_classify(spark, sf):
    return classed(spark, sf).select("site_key", "era")


@register("tourism_classify")
def tourism_classify(spark, sf):
    return classed(spark, sf).select("site_key", "tourism_type")


@register("place_classify")
def place_classify(spark, sf):
    return classed(spark, sf).select("site_key", "place_type")


@register("class_counts")
def class_counts(spark, sf):
    """Sites per page type, era, tourism type and place type."""
    return classed(spark, sf).groupBy("page_type", "era", "tourism_type", "place_type").agg(F.count(F.lit(1)).alias("sites"))


@register("keyword_classify_ext")
def keyword_classify_ext(spark, sf):
    rows = C.sites(spark, sf).withColumn("lowered", F.lower("full_description"))
    return rows.select(
        "site_key",
        R.era(F.col("lowered"), L.ERA_RULES_EXT).alias("era"),
        R.place_type(F.col("name"), F.col("lowered"), L.PLACE_RULES_EXT).alias("place_type"),
    )


@register("class_domain_check")
def class_domain_check(spark, sf):
    return metrics.class_violations(classed(spark, sf))


def titled_sites(spark, sf):
    """Every site that has an article, next to that article."""
    articles = C.articles(spark, sf).filter("lang = 'en'").select("title", "summary", F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("site_key"))
    return C.sites(spark, sf).select("site_key", "name", "unique_name", "location").join(articles, "site_key")


@register("relevance_flag")
def relevance_flag(spark, sf):
    return titled_sites(spark, sf).select(
        "site_key", "title", X.is_relevant(F.col("name"), F.col("title"), F.col("summary")).alias("relevant")
    )


@register("price_mention")
def price_mention(spark, sf):
    text = F.col("full_description")
    return C.sites(spark, sf).select(
        "site_key",
        F.when(R.mentions_price(text), F.lit(L.PRICE_SOURCE)).otherwise(F.lit("")).alias("source_url"),
        R.price_amount(text).cast("long").alias("amount"),
    )


@register("hours_text_flag")
def hours_text_flag(spark, sf):
    return C.map_captures(spark, sf).select("doc_id", R.mentions_hours(F.col("hours_text")).alias("has_hours"))


# ---- text scalars ---------------------------------------------------------------------------------------
@register("clean_text")
def clean_text(spark, sf):
    return C.sites(spark, sf).select("site_key", T.clean_text(F.col("full_description")).alias("clean"))


@register("sentence_split")
def sentence_split(spark, sf):
    parts = children.unnest(C.sites(spark, sf).drop("pos"), T.sentences(F.col("full_description")), "sentence")
    return parts.select("site_key", F.col("pos").cast("long").alias("pos"), "sentence")


@register("fact_extract")
def fact_extract(spark, sf):
    return C.sites(spark, sf).select("site_key", shown(X.facts(F.col("full_description"))).alias("facts"))


@register("key_figure_extract")
def key_figure_extract(spark, sf):
    return C.sites(spark, sf).select("site_key", shown(X.key_figures(F.col("full_description"))).alias("figures"))


@register("feature_extract")
def feature_extract(spark, sf):
    return C.sites(spark, sf).select("site_key", shown(X.features(F.col("full_description"))).alias("features"))


@register("period_extract")
def period_extract(spark, sf):
    return C.sites(spark, sf).select("site_key", X.period(F.col("full_description")).alias("period"))


def site_terms(spark, sf):
    text = T.glossary_text(F.col("name"), F.col("full_description"))
    return C.sites(spark, sf).select("site_key", "name", X.terms(text).alias("terms"))


@register("term_extract")
def term_extract(spark, sf):
    terms = children.unnest(site_terms(spark, sf), "terms", "t")
    return terms.select("site_key", F.col("pos").cast("long").alias("pos"), "t.term", "t.category")


@register("search_variants")
def search_variants(spark, sf):
    return C.listing(spark, sf).select("url", shown(X.search_variants(F.col("name"), F.col("location"))).alias("variants"))


@register("phonetic_guide")
def phonetic_guide(spark, sf):
    words = C.sites(spark, sf).select(F.explode(F.split("full_description", r"\s+")).alias("word"))
    distinct = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return distinct.select("word", T.phonetic_guide(F.col("word")).alias("guide"), "uses")


@register("title_case")
def title_case(spark, sf):
    return C.listing(spark, sf).select("url", T.title_case(F.col("description")).alias("titled"))


@register("sub_location_extract")
def sub_location_extract(spark, sf):
    subs = X.sub_locations(F.format_string("site_%d", "site_key"), F.col("name"), F.col("full_description"))
    return children.unnest(C.sites(spark, sf).drop("pos"), subs, "s").select("s.*")


@register("hours_parse")
def hours_parse(spark, sf):
    rows = C.map_captures(spark, sf).select("doc_id", F.explode(X.opening_hours(F.col("hours_text"))).alias("day", "hours"))
    return rows


@register("hours_simple")
def hours_simple(spark, sf):
    return C.map_captures(spark, sf).select("doc_id", X.hours_range(F.col("hours_text")).alias("hours"))


@register("coords_from_url")
def coords_from_url(spark, sf):
    url = F.col("map_url")
    return C.map_captures(spark, sf).select("doc_id", X.coordinate(url, 1).alias("lat"), X.coordinate(url, 2).alias("lon"))


@register("rating_parse")
def rating_parse(spark, sf):
    return C.map_captures(spark, sf).select("doc_id", X.rating(F.col("rating_text")).alias("rating"))


@register("review_count_parse")
def review_count_parse(spark, sf):
    return C.map_captures(spark, sf).select("doc_id", X.review_count(F.col("review_text")).cast("long").alias("reviews"))


@register("coords_parse")
def coords_parse(spark, sf):
    return C.gazetteer(spark, sf).select("query", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))


@register("address_region")
def address_region(spark, sf):
    return C.gazetteer(spark, sf).select("query", X.address_region(F.col("address")).alias("region"))


# ---- joins and lookups ----------------------------------------------------------------------------------
@register("listing_detail_join")
def listing_detail_join(spark, sf):
    pages = C.detail_pages(spark, sf).select("url", F.length("html").cast("long").alias("html_chars"))
    return C.listing(spark, sf).select("url", "name", "pos").join(pages, "url")


@register("language_pair_join")
def language_pair_join(spark, sf):
    rows = C.listing(spark, sf).select("url", "name", T.arabic_url(F.col("url")).alias("arabic_url"))
    names = research.arabic_names(research.page_contents(C.detail_pages(spark, sf)))
    return rows.join(names, "arabic_url", "left").select("url", "name", F.coalesce("arabic_name", F.lit("")).alias("arabic_name"))


def site_names(spark, sf):
    return C.listing(spark, sf).select("name", "location").distinct()


@register("exact_variant_match")
def exact_variant_match(spark, sf):
    found = M.exact_matches(site_names(spark, sf), C.articles(spark, sf))
    return found.withColumn("variant_pos", F.col("variant_pos").cast("long"))


@register("fuzzy_match")
def fuzzy_match(spark, sf):
    found = M.fuzzy_matches(site_names(spark, sf), C.articles(spark, sf))
    return found.withColumn("query_pos", F.col("query_pos").cast("long")).withColumn("rank", F.col("rank").cast("long"))


@register("langlink_join")
def langlink_join(spark, sf):
    return M.arabic_twins(C.articles(spark, sf))


def full_dictionary(spark, sf):
    return tables.dictionary(spark, M.article_pairs(C.articles(spark, sf)))


@register("translate_lookup")
def translate_lookup(spark, sf):
    terms = children.unnest(site_terms(spark, sf), "terms.term", "term").select("term").unionByName(
        C.listing(spark, sf).select(F.col("name").alias("term"))
    )
    return G.translate(terms.distinct(), full_dictionary(spark, sf))


@register("translate_terms")
def translate_terms(spark, sf):
    terms = C.listing(spark, sf).select("pos", F.col("name").alias("english"))
    return G.translate_terms(terms, full_dictionary(spark, sf))


@register("pronounce_lookup")
def pronounce_lookup(spark, sf):
    terms = children.unnest(site_terms(spark, sf), "terms.term", "term").select("term").distinct()
    return terms.select("term", T.pronounce(F.col("term")).alias("pronunciation"))


@register("known_place_match")
def known_place_match(spark, sf):
    return C.sites(spark, sf).select("site_key", R.known_place_region(F.col("unique_name")).alias("region"))


@register("alias_lookup")
def alias_lookup(spark, sf):
    return C.sites(spark, sf).select("site_key", R.alias_region(F.col("location")).alias("region"))


@register("forward_geocode")
def forward_geocode(spark, sf):
    return RG.forward_regions(site_names(spark, sf), C.gazetteer(spark, sf))


@register("reverse_geocode")
def reverse_geocode(spark, sf):
    points = C.site_points(spark, sf)
    nearest = RG.nearest_regions(points, C.gazetteer_points(spark, sf), max_km=None)
    rows = lookup_join(points.filter("lat is not null and lon is not null"), nearest, ["lat", "lon"], ["site_key"])
    return rows.select("site_key", "place", "region", F.round("distance_km", 6).alias("distance_km"))


@register("region_cascade")
def region_cascade(spark, sf):
    rows = C.listing(spark, sf).select("url", "name", "location", F.col("pos").alias("site_key"))
    names = rows.select("name", "location").distinct()
    unresolved = names.filter(RG.cheap_region(F.col("name"), F.col("location")).isNull())
    forward = RG.forward_regions(unresolved, C.gazetteer(spark, sf)).withColumnRenamed("region", "forward")
    answered = lookup_join(rows, forward, ["name", "location"], ["url"])
    points = C.site_points(spark, sf)
    located = answered.join(points, "site_key")
    unplaced = located.filter(RG.cheap_region(F.col("name"), F.col("location")).isNull() & F.col("forward").isNull())
    nearest = RG.reverse_regions(unplaced, C.gazetteer_points(spark, sf), C.reverse_answers(spark, sf)).withColumnRenamed("region", "reverse")
    placed = lookup_join(located, nearest, ["lat", "lon"], ["site_key"])
    region = RG.resolve_region(F.col("name"), F.col("location"), F.col("forward"), F.col("reverse"))
    return placed.select("site_key", "name", region.alias("region"))


@register("coordinates_lookup")
def coordinates_lookup(spark, sf):
    headings = C.listing(spark, sf).select(F.col("name").alias("heading"), "url")
    return lookup_join(headings, RG.coordinates(headings.select("heading").distinct(), C.gazetteer(spark, sf)), ["heading"], ["url"])


def full_sites(spark, sf):
    return research.research_sites(crawl(spark, sf))


FLAT_SITE = [
    "id", "name", "arabicName", "era", "tourismType", "placeType", "governorate", "latitude", "longitude", "shortDescription", "fullDescription",
    "estimatedDuration", "bestTimeToVisit", "openingHours", "officialWebsite", "wikipediaUrl",
]


def flat_site(site):
    """A site row with its lists as text."""
    return site.select(
        *FLAT_SITE,
        shown("imageNames").alias("imageNames"), shown("uniqueFacts").alias("uniqueFacts"),
        shown("keyFigures").alias("keyFigures"), shown("architecturalFeatures").alias("architecturalFeatures"),
        shown("tips").alias("tips"), shown("subLocations.name").alias("subLocations"), shown("arabicPhrases.english").alias("arabicPhrases"),
    )


@register("site_synthesize")
def site_synthesize(spark, sf):
    return flat_site(full_sites(spark, sf)).select("id", "name", "era", "tourismType", "placeType", "governorate", "wikipediaUrl", "subLocations", "tips")


@register("skip_processed")
def skip_processed(spark, sf):
    rows = C.listing(spark, sf).select("url", "name", "page_type", "pos")
    return incremental.pending_sites(rows, earlier(spark, sf, rows))


@register("skip_existing")
def skip_existing(spark, sf):
    rows = C.listing(spark, sf).select("url", "name", "page_type", "pos")
    none = local_table(spark, [], S.PROCESSED)
    return incremental.pending_sites(rows, none, labelled(spark, sf, rows).select("name"))


@register("skip_completed_types")
def skip_completed_types(spark, sf):
    """The page type with the most labelled rows is taken to be finished."""
    rows = C.listing(spark, sf).select("url", "name", "page_type", "pos")
    counts = labelled(spark, sf, rows).groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))
    return incremental.pending_types(rows, counts.orderBy(F.desc("n"), "page_type").limit(1))


@register("dry_run_status")
def dry_run_status(spark, sf):
    rows = C.listing(spark, sf)
    return incremental.dry_run_rows(rows, labelled(spark, sf, rows).select("name"))


@register("region_validate")
def region_validate(spark, sf):
    return C.sites(spark, sf).select("site_key", "location", R.is_region(F.col("location")).alias("valid"))


@register("official_site_lookup")
def official_site_lookup(spark, sf):
    return C.sites(spark, sf).select("site_key", R.official_website(F.col("unique_name")).alias("official_website"))


# ---- aggregations ---------------------------------------------------------------------------------------
@register("count_by_type")
def count_by_type(spark, sf):
    return metrics.count_by_type(C.listing(spark, sf))


@register("new_vs_existing")
def new_vs_existing(spark, sf):
    rows = C.listing(spark, sf)
    existing = labelled(spark, sf, rows).select("name")
    return metrics.new_vs_existing(incremental.dry_run_rows(rows, existing), existing)


@register("site_summary")
def site_summary(spark, sf):
    summary = metrics.site_summary(full_sites(spark, sf))
    return summary.select("id", "name", "region", "era", "type", *[F.col(c).cast("long").alias(c) for c in ("facts", "tips", "phrases")])


@register("export_counts")
def export_counts(spark, sf):
    return metrics.export_counts(export.tables(staged(full_sites(spark, sf))))


@register("coverage_metrics")
def coverage_metrics(spark, sf):
    return metrics.coverage(full_sites(spark, sf))


@register("checkpoint_stats")
def checkpoint_stats(spark, sf):
    done = earlier(spark, sf, C.listing(spark, sf))
    completed = done.groupBy("page_type").agg(F.max("updated_at").alias("updated_at"))
    return metrics.checkpoint_stats(done, completed)


@register("region_list")
def region_list(spark, sf):
    named = C.sites(spark, sf).select(R.alias_region(F.col("location")).alias("region")).filter("region is not null")
    return RG.region_list(named)


@register("distinct_entities")
def distinct_entities(spark, sf):
    rows = C.sites(spark, sf).select(X.key_figures(F.col("full_description")).alias("figures"))
    return metrics.entity_counts(rows, "figures")


@register("token_overlap")
def token_overlap(spark, sf):
    return titled_sites(spark, sf).select(
        "site_key", "title", X.token_overlap(F.col("unique_name"), F.col("title")).cast("long").alias("overlap")
    )


# ---- ranking, top-k, numbering --------------------------------------------------------------------------
@register("top_n_per_type")
def top_n_per_type(spark, sf):
    return research.first_of_each_type(C.listing(spark, sf), 30).select("page_type", "pos", "url", "name")


@register("site_numbering")
def site_numbering(spark, sf):
    return research.numbered(C.listing(spark, sf), C.detail_pages(spark, sf)).select("id", "url")


@register("child_numbering")
def child_numbering(spark, sf):
    names = children.unnest(C.sites(spark, sf), X.sub_location_names(F.col("full_description")), "sub_name", "n")
    return names.select("site_key", (F.col("n") + 1).cast("long").alias("number"), "sub_name")


@register("glossary_topk")
def glossary_topk(spark, sf):
    top = F.slice("terms.term", 1, L.MAX_TERMS)
    return site_terms(spark, sf).select("site_key", shown(top).alias("terms"))


@register("first_k_facts")
def first_k_facts(spark, sf):
    text = F.col("full_description")
    return C.sites(spark, sf).select(
        "site_key",
        count(X.facts(text, 3)).alias("facts"), count(X.key_figures(text, 2)).alias("figures"), count(X.sub_location_names(text, 1)).alias("subs"),
    )


def asked_words(spark, sf):
    queries = X.search_queries(F.col("name"), F.col("location"))
    return site_names(spark, sf).select(F.explode(queries).alias("query")).select(M.words(F.col("query")).alias("word_set"))


@register("search_top5")
def search_top5(spark, sf):
    hits = M.ranked_hits(asked_words(spark, sf), C.articles(spark, sf))
    return hits.select(
        shown("word_set", " ").alias("words"), F.col("rank").cast("long").alias("rank"), "title", F.col("overlap").cast("long").alias("overlap")
    )


@register("first_match_wins")
def first_match_wins(spark, sf):
    """Best article of each site over both ways of matching."""
    return M.match_articles(site_names(spark, sf), C.articles(spark, sf))


@register("listing_row_number")
def listing_row_number(spark, sf):
    rows = C.listing(spark, sf).select("page_type", "pos", "name")
    totals = rows.groupBy("page_type").agg(F.count(F.lit(1)).alias("of_n"))
    return number_rows(rows, "pos", "i", ["page_type"]).join(totals, "page_type").select("page_type", "name", "i", "of_n")


# ---- set operations -------------------------------------------------------------------------------------
@register("union_page_types")
def union_page_types(spark, sf):
    rows = C.listing(spark, sf)
    first, *rest = [rows.filter(F.col("page_type") == t) for t in L.PAGE_TYPES]
    for part in rest:
        first = first.unionByName(part)
    return first.select("page_type", "pos", "url", "name")


@register("union_entities")
def union_entities(spark, sf):
    text = F.col("full_description")
    both = F.array_union(T.find_all(text, X.FIGURE_PATTERN), T.find_all(text, X.FEATURE_PATTERN))
    return C.sites(spark, sf).select("site_key", shown(both).alias("entities"))


@register("checkpoint_merge")
def checkpoint_merge(spark, sf):
    rows = C.sites(spark, sf).select("url", "name", "page_type", "pos")
    return incremental.merge_progress(earlier(spark, sf, rows), rows, "name")


@register("pending_sites")
def pending_sites(spark, sf):
    rows = C.listing(spark, sf).select("url", "name", "page_type", "pos")
    return incremental.pending_by_type(rows, earlier(spark, sf, rows).filter("status = 'done'"))


# ---- normalise ------------------------------------------------------------------------------------------
@register("explode_sub_locations")
def explode_sub_locations(spark, sf):
    return children.sub_locations(full_sites(spark, sf))


@register("derive_cards")
def derive_cards(spark, sf):
    return children.cards(full_sites(spark, sf))


@register("explode_tips")
def explode_tips(spark, sf):
    return children.tips(full_sites(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@register("explode_phrases")
def explode_phrases(spark, sf):
    return children.phrases(full_sites(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


LISTS = ["imageNames", "uniqueFacts", "keyFigures", "architecturalFeatures"]


@register("project_sites")
def project_sites(spark, sf):
    return children.sites(full_sites(spark, sf)).withColumns({c: shown(c) for c in LISTS})


@register("nest_children")
def nest_children(spark, sf):
    tips = children.unnest(tip_rows(spark, sf), "tips", "tip")
    nested = children.nest(tips.select("site_key", "pos", "tip"), "site_key", "pos", "tips")
    return nested.select("site_key", shown("tips.tip").alias("tips"))


# ---- advice ---------------------------------------------------------------------------------------------
def advice_inputs(spark, sf):
    return classed(spark, sf).select("site_key", "name", "tourism_type", "place_type", F.col("location").alias("city"))


def advice_columns():
    return [F.col(c) for c in ("name", "place_type", "tourism_type", "city")]


def tip_rows(spark, sf):
    return advice_inputs(spark, sf).select("site_key", R.contextual_tips(*advice_columns()).alias("tips"))


@register("contextual_tips")
def contextual_tips(spark, sf):
    return tip_rows(spark, sf).select("site_key", shown("tips").alias("tips"))


@register("visit_duration")
def visit_duration(spark, sf):
    return advice_inputs(spark, sf).select("site_key", R.visit_duration(F.col("name"), F.col("place_type")).alias("duration"))


@register("best_time")
def best_time(spark, sf):
    return advice_inputs(spark, sf).select("site_key", R.best_time(F.col("place_type"), F.col("city")).alias("best_time"))


@register("site_tips")
def site_tips(spark, sf):
    return advice_inputs(spark, sf).select("site_key", shown(R.site_tips(*advice_columns())).alias("tips"))


@register("city_tip_ext")
def city_tip_ext(spark, sf):
    return C.sites(spark, sf).select("site_key", F.coalesce(T.lookup(L.CITY_TIPS_EXT, F.col("location")), F.lit("")).alias("tip"))


@register("phrase_book_ext")
def phrase_book_ext(spark, sf):
    book = tables.phrase_book(spark)
    return classed(spark, sf).select("site_key", "place_type").join(book, "place_type").select(
        "site_key", F.col("pos").cast("long").alias("pos"), "english", "arabic", "pronunciation"
    )


# ---- whole runs -----------------------------------------------------------------------------------------
@register("page_facts")
def page_facts(spark, sf):
    rows = research.page_facts(C.listing(spark, sf), C.detail_pages(spark, sf), C.gazetteer(spark, sf))
    return rows.select(
        "url", "name", "heading", "full_description", "arabic_name", "era", "tourism_type", "place_type", "latitude", "longitude",
        "location", shown("images").alias("images"),
    )


@register("article_facts")
def article_facts(spark, sf):
    matched = M.match_articles(site_names(spark, sf), C.articles(spark, sf))
    rows = matched.join(M.article_facts(C.articles(spark, sf)), "title")
    return rows.select(
        "name", "title", "summary", "article_url", "arabic_title", "arabic_summary", "arabic_url", "historical_period",
        shown("unique_facts").alias("unique_facts"), shown("key_figures").alias("key_figures"),
        shown("architectural_features").alias("architectural_features"),
    )


@register("glossary")
def glossary(spark, sf):
    dictionary = full_dictionary(spark, sf)
    rows = C.listing(spark, sf).select("url", "name", "description")
    named = lookup_join(rows, G.name_translations(rows, dictionary), ["name"], ["url"])
    named = named.withColumn("translations", G.lexicon_translations(dictionary))
    text = T.glossary_text(F.col("name"), F.col("description"))
    entries = G.glossary(text, F.col("name"), F.col("name_arabic"), F.col("translations"))
    return children.unnest(named, entries, "e").select(
        "url", F.col("pos").cast("long").alias("pos"), "e.english", "e.arabic", "e.pronunciation", "e.context"
    )


@register("place_info")
def place_info(spark, sf):
    rows = research.place_info(C.map_captures(spark, sf), ["doc_id"])
    weekdays = F.array(*[F.lit(d) for d in L.WEEKDAYS])

    def days(hours):
        return F.filter(F.transform(weekdays, lambda d: F.concat(d, F.lit("="), F.try_element_at(hours, d))), lambda d: d.isNotNull())

    return rows.select(
        "doc_id", "opening_hours_text", shown(T.let(F.col("opening_hours"), days)).alias("opening_hours"), "opening_hours_simple",
        "latitude", "longitude", "rating", F.col("review_count").cast("long").alias("review_count"),
    )


@register("research_sites")
def research_sites(spark, sf):
    return flat_site(full_sites(spark, sf))


@register("research_all")
def research_all(spark, sf):
    site = research.research_all(crawl(spark, sf), ["museums", "monuments"], max_sites=25)
    return flat_site(site)


@register("export_json")
def export_json(spark, sf):
    path = shared_dir(spark)
    export.write(full_sites(spark, sf), path)
    back = {name: spark.read.json(f"{path}/{name}") for name in children.TABLES}
    return metrics.export_counts(back)


def rows_per_site(parts):
    keys = {"sites": "id", "subLocations": "siteId", "cards": "subLocationId", "tips": "siteId", "arabicPhrases": "siteId"}
    rows = None
    for name, df in parts.items():
        part = df.groupBy(F.substring_index(keys[name], "_sub_", 1).alias("site")).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register("export_all")
def export_all(spark, sf):
    return rows_per_site(export.tables(staged(full_sites(spark, sf))))


@register("export_document")
def export_document(spark, sf):
    """The whole catalogue as one JSON document, read back."""
    path = shared_dir(spark)
    export.write_document(full_sites(spark, sf), path)
    return rows_per_site(export.read_document(spark, path))


@register("dry_run")
def dry_run(spark, sf):
    rows = C.listing(spark, sf)
    result = incremental.dry_run(rows, labelled(spark, sf, rows).select("name"), L.PAGE_TYPES, 20)
    return result["rows"].groupBy("page_type", "status").agg(F.count(F.lit(1)).alias("sites"))


@register("incremental_run")
def incremental_run(spark, sf):
    """Two runs over the same listing; the second finds only what the first was not given."""
    whole = crawl(spark, sf)
    store = incremental.Store(spark, shared_dir(spark))
    first = Crawl(labelled(spark, sf, whole.listing), whole.pages, whole.articles, whole.gazetteer)
    incremental.run(first, store, mark_completed=False)
    incremental.run(whole, store)
    return store.processed().select("url", "name", "page_type", "status")


# ---- streams --------------------------------------------------------------------------------------------
def documents_stream(spark, sf):
    """The documents as a stream; the table is one file or a folder of part files, which may lie in partition folders."""
    reader = spark.readStream.schema(C.table(spark, sf, "documents").schema).option("basePath", sf)  # a pattern has no base to find partition columns from
    return reader.parquet(f"{sf}/documents.parque[t]")  # a stream takes a single file by a pattern only


def listing_stream(spark, sf):
    """The listing of :func:`siteweave.sources.corpus.listing`, over a stream of documents."""
    return C.listing_of(C.seeded_of(spark, documents_stream(spark, sf)))


@register("incremental_listing")
def incremental_listing(spark, sf):
    """Listing rows as a stream, twice; the second pass over the same files adds nothing."""
    path, checkpoint = shared_dir(spark), shared_dir(spark)
    for _ in range(2):
        intake.new_listing_rows(listing_stream(spark, sf), path, checkpoint).awaitTermination()
    return spark.read.schema(S.LISTING).parquet(path).drop("batch")


@register("stream_dedup")
def stream_dedup(spark, sf):
    """Each listing address once, from a stream that holds every row twice and is then read again by another query."""
    path = shared_dir(spark)
    for _ in range(2):
        rows = listing_stream(spark, sf).select("page_type", "url")
        intake.distinct_addresses(rows.unionByName(listing_stream(spark, sf).select("page_type", "url")), path, shared_dir(spark)).awaitTermination()
    return spark.read.schema("page_type STRING, url STRING").parquet(path).select("page_type", "url")


@register("incremental_updates")
def incremental_updates(spark, sf):
    """Pages whose content is not the stored one; of labelled documents the stored one is outdated."""
    pages = C.table(spark, sf, "pages")
    old = pages.join(C.table(spark, sf, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    stored = pages.join(old.select("page_id"), "page_id", "left_anti").select("url", F.xxhash64("html").alias("content_hash"))
    stale = old.select("url", F.xxhash64(F.concat("html", F.lit("old"))).alias("content_hash"))
    return incremental.changed_pages(pages, stored.unionByName(stale)).select("page_id", "url")
