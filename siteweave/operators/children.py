"""Sites and their child rows: nested lists to tables and back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import schemas as S
from siteweave.functions import text as T


def unnest(rows: DataFrame, items: Column | str, name: str, pos: str = "pos") -> DataFrame:
    """One row per list item, with its place from 0; the other columns stay.

    For a plain explode the optimizer puts a filter on the list's size below it, which computes a
    derived list twice.  The outer form has no such filter; the rows of empty lists go afterwards.
    """
    return rows.select("*", F.posexplode_outer(items).alias(pos, name)).filter(F.col(pos).isNotNull())


def sites(site: DataFrame) -> DataFrame:
    """The exported columns; long texts and nested lists stay behind."""
    return site.select(*S.EXPORTED_SITE)


def sub_locations(site: DataFrame) -> DataFrame:
    return unnest(site.select("subLocations"), "subLocations", "s").select(
        "s.id", "s.siteId", "s.name", "s.arabicName", "s.shortDescription", "s.imageName"
    )


def cards(site: DataFrame) -> DataFrame:
    """One card per sub-location; its text is the sub-location's, else the site's."""
    rows = unnest(site.select("subLocations", "fullDescription"), "subLocations", "s")
    return rows.select(
        T.card_id(F.col("s.id")).alias("id"),
        F.col("s.id").alias("subLocationId"),
        F.coalesce(F.nullif("s.fullDescription", F.lit("")), "fullDescription").alias("fullDescription"),
    )


def tips(site: DataFrame) -> DataFrame:
    return unnest(site.select(F.col("id").alias("siteId"), "tips"), "tips", "tip").select("siteId", "pos", "tip")


def phrases(site: DataFrame) -> DataFrame:
    return unnest(site.select(F.col("id").alias("siteId"), "arabicPhrases"), "arabicPhrases", "p").select(
        "siteId", "pos", "p.english", "p.arabic", "p.pronunciation"
    )


def nest(children: DataFrame, parent: str, pos: str, name: str) -> DataFrame:
    """Child rows to one ordered list per parent.

    A parent has at most a handful of children here (eight tips, five sub-locations, eight terms).
    """
    fields = [c for c in children.columns if c not in (parent, pos)]
    ordered = F.array_sort(F.collect_list(F.struct(pos, *fields)))
    return children.groupBy(parent).agg(F.transform(ordered, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name))


TABLES = {
    "sites": sites,
    "subLocations": sub_locations,
    "cards": cards,
    "tips": tips,
    "arabicPhrases": phrases,
}
