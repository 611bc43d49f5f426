"""Region and coordinates of a place, from saved geocoder answers and known points."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import extract as X
from siteweave.functions import rules as R
from siteweave.operators import nearest as near
from siteweave.session import staged

MAX_KM = 20.0   # how far a known place may be to decide a region; None: any distance


def first_answers(gazetteer: DataFrame) -> DataFrame:
    """Only the first answer of a query counts."""
    return gazetteer.filter(F.col("rank") == 1)


def forward_regions(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(name, location) to region: the query with the location first, then the one without.

    ``places`` holds distinct pairs.  A query whose answer names no known region does not count.
    """
    plain = F.concat_ws(", ", "name", F.lit(L.COUNTRY))
    hinted = F.when(F.col("location") != "", F.concat_ws(", ", "name", "location", F.lit(L.COUNTRY)))
    tries = places.select("name", "location", F.posexplode(F.array(hinted, plain)).alias("pos", "query"))
    named = (
        first_answers(gazetteer)
        .select("query", X.address_region(F.col("address")).alias("region"))
        .filter("region is not null")
    )
    return (
        tries.filter("query is not null").join(named, "query")
        .groupBy("name", "location")
        .agg(F.min_by("region", "pos").alias("region"))
    )


def coordinates(headings: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """heading to latitude and longitude of its first answer; both null unless both are numbers."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    answers = first_answers(gazetteer).select(
        "query", F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude")
    )
    asked = headings.select("heading", F.concat_ws(", ", "heading", F.lit(L.COUNTRY)).alias("query"))
    return asked.join(answers, "query").drop("query")


def nearest_regions(points: DataFrame, known: DataFrame, max_km: float | None = MAX_KM) -> DataFrame:
    """(lat, lon) to the nearest known point within ``max_km`` (None: at any distance): place, region, distance_km.

    Sites are distinct coordinates, and known points at one spot count once (least place name).  See ``nearest``.
    """
    return near.nearest(points, near.build(known), max_km)


def reverse_regions(points: DataFrame, known: DataFrame | None, saved: DataFrame | None = None, max_km: float | None = MAX_KM) -> DataFrame:
    """(lat, lon) to region: a saved reverse-geocoder answer that names one, else the nearest known point's.

    ``saved`` (lat, lon, address) holds the answers for exactly these coordinates; of several the least region counts.
    Only coordinates without an answer are searched.
    """
    sites = points.filter("lat is not null and lon is not null").select("lat", "lon").distinct()
    if saved is None:
        answered = sites.limit(0).select("lat", "lon", F.lit(None).cast("string").alias("region"))
    else:
        named = saved.select("lat", "lon", X.address_region(F.col("address")).alias("region")).filter("region is not null")
        answered = sites.join(named.groupBy("lat", "lon").agg(F.min("region").alias("region")), ["lat", "lon"])
    if known is None:
        return answered
    found = staged(answered)
    rest = sites.join(found.select("lat", "lon"), ["lat", "lon"], "left_anti")
    return found.unionByName(nearest_regions(rest, known, max_km).select("lat", "lon", "region"))


def cheap_region(name: Column, location: Column) -> Column:
    """Known place, then alias of the location; null if neither decides."""
    return F.coalesce(R.known_place_region(name), R.alias_region(location))


def resolve_region(
    name: Column, location: Column, forward: Column | None = None, reverse: Column | None = None
) -> Column:
    """The whole cascade; the listing's location text is the last resort."""
    steps = [cheap_region(name, location)]
    steps += [step for step in (forward, reverse) if step is not None]
    return F.coalesce(*steps, location)


def region_list(aliases: DataFrame) -> DataFrame:
    """Sorted distinct official regions of an alias table."""
    return aliases.select("region").distinct().orderBy("region")
