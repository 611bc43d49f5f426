"""Counts, coverage and checks over listings, sites and progress."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.operators.children import unnest


def count_by_type(listing: DataFrame) -> DataFrame:
    """Sites per page type and in all (page_type 'ALL')."""
    return listing.rollup("page_type").agg(F.count(F.lit(1)).alias("sites")).select(
        F.coalesce("page_type", F.lit("ALL")).alias("page_type"), "sites"
    )


def new_vs_existing(marked: DataFrame, existing: DataFrame) -> DataFrame:
    """Totals of a listing whose rows carry ``exists_already``.

    ``new_sites`` counts listed rows that are not in the earlier output; ``new_by_difference`` is listed
    rows minus all earlier names, listed or not, and can be negative.
    """
    known = existing.agg(F.count(F.lit(1)).alias("existing_names"))
    totals = marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("exists_already")).alias("new_sites"),
        F.count_if("exists_already").alias("existing_sites"),
    )
    return totals.select("*", known.scalar().alias("existing_names")).withColumn(
        "new_by_difference", F.col("total") - F.col("existing_names")
    )


def _shown(c: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))


def site_summary(site: DataFrame) -> DataFrame:
    return site.select(
        "id", "name",
        _shown("governorate").alias("region"),
        _shown("era").alias("era"),
        F.concat_ws(" / ", "tourismType", "placeType").alias("type"),
        F.size("uniqueFacts").alias("facts"),
        F.size("tips").alias("tips"),
        F.size("arabicPhrases").alias("phrases"),
    )


def export_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each output table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    first, *rest = counts
    for df in rest:
        first = first.unionByName(df)
    return first


def coverage(site: DataFrame) -> DataFrame:
    """Shares of sites that are complete, have Arabic content, have facts, matched an article."""
    arabic = (F.col("arabicName") != "") | (F.size("arabicPhrases") > 0)
    facts = F.size("uniqueFacts") > 0
    matched = F.col("wikipediaUrl") != ""
    complete = (
        (F.col("era") != "") & (F.col("governorate") != "") & (F.col("fullDescription") != "")
        & F.col("latitude").isNotNull() & arabic
    )
    return site.rollup("page_type").agg(
        F.count(F.lit(1)).alias("sites"),
        _share(complete).alias("complete"),
        _share(arabic).alias("arabic"),
        _share(facts).alias("facts"),
        _share(matched).alias("matched"),
    ).withColumn("page_type", F.coalesce("page_type", F.lit("ALL")))


def _share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")), 6)


def checkpoint_stats(processed: DataFrame, completed: DataFrame) -> DataFrame:
    """Distinct processed addresses, completed page types, last update."""
    types = completed.agg(F.count_distinct("page_type").alias("n"))
    last = completed.agg(F.max("updated_at").alias("t"))
    return processed.agg(
        F.count_distinct(F.nullif("url", F.lit(""))).alias("total_processed"),
        F.max("updated_at").alias("last_site"),
    ).select(
        "total_processed",
        types.scalar().alias("page_types_completed"),
        F.greatest("last_site", last.scalar()).alias("last_updated"),
    )


def entity_counts(site: DataFrame, column: str) -> DataFrame:
    """How many sites name each entity."""
    return unnest(site.select(column), column, "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("sites"))


def class_violations(site: DataFrame) -> DataFrame:
    """Values outside the declared domains, with their counts."""
    domains = [("era", L.ERA_DOMAIN), ("tourism_type", L.TOURISM_DOMAIN), ("place_type", L.PLACE_DOMAIN)]
    values = F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(field).alias("value"), F.col(field).isin(domain).alias("legal"))
        for field, domain in domains
    ])
    return (
        site.select(F.explode(values).alias("v")).select("v.*").filter(~F.col("legal"))
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("sites"))
    )
