"""Matching sites to encyclopedia articles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import extract as X
from siteweave.functions import text as T
from siteweave.operators import search
from siteweave.operators.search import words


def exact_matches(names: DataFrame, articles: DataFrame) -> DataFrame:
    """(name, location) to the first title variant that exists: title, variant_pos.

    ``names`` holds distinct pairs, so repeated sites are looked up once.
    """
    variants = names.select(
        "name", "location", F.posexplode(X.search_variants(F.col("name"), F.col("location"))).alias("pos", "title")
    )
    titles = articles.filter("lang = 'en'").select("title").distinct()
    return (
        variants.join(titles, "title")
        .groupBy("name", "location")
        .agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("variant_pos"))
    )


def title_index(articles: DataFrame, **settings) -> search.TitleIndex:
    """The index that searches of these articles read; build it once and pass it to every batch."""
    return search.build(articles.filter("lang = 'en'").select("title"), **settings)


def ranked_hits(queries: DataFrame, articles: DataFrame, index: search.TitleIndex | None = None, **settings) -> DataFrame:
    """word_set to its best article titles: rank, title, overlap (see ``search``)."""
    return search.ranked_hits(queries, index or title_index(articles, **settings))


def fuzzy_matches(names: DataFrame, articles: DataFrame, **options) -> DataFrame:
    """(name, location) to the first relevant hit of its search queries: title, query_pos, rank."""
    asked = names.select(
        "name", "location", F.posexplode(X.search_queries(F.col("name"), F.col("location"))).alias("query_pos", "query")
    ).select("name", "location", "query_pos", words(F.col("query")).alias("word_set"))
    hits = ranked_hits(asked, articles, **options)
    snippets = articles.filter("lang = 'en'").select("title", "summary")
    seen = asked.join(hits.join(snippets, "title"), "word_set")
    relevant = seen.filter(X.is_relevant(F.col("name"), F.col("title"), F.col("summary")))
    first = F.min(F.struct("query_pos", "rank", "title")).alias("hit")
    return relevant.groupBy("name", "location").agg(first).select(
        "name", "location", "hit.title", "hit.query_pos", "hit.rank"
    )


def match_articles(names: DataFrame, articles: DataFrame, **options) -> DataFrame:
    """(name, location) to an article title: by exact variant, else by search.

    The search runs only for the pairs without an exact match.
    """
    exact = exact_matches(names, articles).select("name", "location", "title", F.lit("exact").alias("how"))
    missed = names.join(exact, ["name", "location"], "left_anti")
    fuzzy = fuzzy_matches(missed, articles, **options).select("name", "location", "title", F.lit("search").alias("how"))
    return exact.unionByName(fuzzy)


def arabic_twins(articles: DataFrame) -> DataFrame:
    """English title to its Arabic article: arabic_title, arabic_summary, arabic_url."""
    linked = articles.filter("lang = 'en'").select(
        "title", F.try_element_at("langlinks", F.lit("ar")).alias("arabic_title")
    )
    arabic = articles.filter("lang = 'ar'").select(
        F.col("title").alias("arabic_title"),
        T.clean_text(F.left("summary", F.lit(500))).alias("arabic_summary"),
        F.col("url").alias("arabic_url"),
    )
    return linked.filter("arabic_title is not null").join(arabic, "arabic_title")


def article_pairs(articles: DataFrame) -> DataFrame:
    """Title pairs of linked articles, as dictionary entries."""
    return arabic_twins(articles).select(F.col("title").alias("english"), F.col("arabic_title").alias("arabic"))


def article_facts(articles: DataFrame) -> DataFrame:
    """Facts of each English article, keyed by title."""
    text = F.col("text")
    english = articles.filter("lang = 'en'").select(
        "title",
        T.clean_text(F.col("summary")).alias("summary"),
        F.col("url").alias("article_url"),
        F.left(text, F.lit(L.INTRO_CHARS)).alias("intro"),
        X.facts(text).alias("unique_facts"),
        X.key_figures(text).alias("key_figures"),
        X.features(text).alias("architectural_features"),
        X.period(text).alias("historical_period"),
    )
    return english.join(arabic_twins(articles), "title", "left").fillna(
        "", ["arabic_title", "arabic_summary", "arabic_url"]
    )
