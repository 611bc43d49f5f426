"""Nearest known point, through a tree of cells that are split by the number of their points.

Coordinates become points of the unit sphere in space.  Straight distances (chords) grow with great-circle distances, so the
distance to a box of space bounds that to every point in it, and neither the date line nor the poles are special.

The tree splits a cell of space into ``FAN`` to the power of three cells while it has more than ``leaf`` points, so a crowded
spot has deep, small cells and an empty region none.  The search goes down the tree with all sites at once.  A site keeps the
cells that can hold its nearest point: those whose least distance is not above the wanted radius or the distance to any point
that it has met, and every cell shows it one.  At the end each site meets the points of a few leaves, however crowded its
surroundings are; no site meets all points of a cell that has more than ``leaf``.
"""

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.operators.joins import HOT_ROWS, lookup_join
from siteweave.session import staged

EARTH_KM = 6371.0088
FAN = 8
LEAF = 256      # most points of a cell that is not split
DEPTH = 15      # levels until cells are as small as the numbers allow
ROOT = "root"


@dataclass(frozen=True)
class PointTree:
    """The stored cells: by level, each split cell's children (at most ``FAN`` to the power of three); and the points of all leaves."""

    levels: tuple[DataFrame, ...]
    leaves: DataFrame


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _in_space(lat: str, lon: str) -> list[Column]:
    la, lo = F.radians(F.col(lat)), F.radians(F.col(lon))
    return [(F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z")]


def _placed(lat: str, lon: str) -> Column:
    """Rows with numbers for coordinates."""
    return F.col(lat).between(-1e6, 1e6) & F.col(lon).between(-1e6, 1e6)


def build(known: DataFrame, leaf: int = LEAF, min_rows: int = HOT_ROWS) -> PointTree:
    """The tree of ``known`` (place, lat, lon, region); of points at one spot the least place counts."""
    spots = known.filter(_placed("lat", "lon")).groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(
        F.min(F.struct("place", "region")).alias("spot")
    )
    active = staged(spots.select("plat", "plon", "spot", *_in_space("plat", "plon"), F.lit(ROOT).alias("parent")))
    levels, leaves = [], []
    for level in range(1, DEPTH + 1):
        size = 2.0 / FAN**level
        numbers = [F.floor((F.col(c) + 1.0) / size).alias(f"i{c}") for c in "xyz"]
        placed = active.select("*", *numbers).withColumn("cell", F.concat_ws(":", F.lit(str(level)), "ix", "iy", "iz"))
        counts = staged(
            placed.groupBy("parent", "cell", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "z")).alias("one")).withColumn("leaf", (F.col("n") <= leaf) | F.lit(level == DEPTH))
        )
        low = [(F.col(f"i{c}") * size - 1.0).alias(f"low_{c}") for c in "xyz"]
        levels.append(counts.groupBy(F.col("parent").alias("cell")).agg(F.collect_list(F.struct("cell", "leaf", "one", *low)).alias("children")))
        if counts.filter("not leaf").isEmpty():
            leaves.append(placed.select("cell", "plat", "plon", "spot"))
            break
        marked = staged(lookup_join(placed.drop("ix", "iy", "iz"), counts.select("cell", "leaf"), ["cell"], ["plat", "plon"], min_rows))
        leaves.append(marked.filter("leaf").select("cell", "plat", "plon", "spot"))
        active = marked.filter("not leaf").select("plat", "plon", "spot", "x", "y", "z", F.col("cell").alias("parent"))
    gathered = reduce(DataFrame.unionByName, leaves).groupBy("cell").agg(F.collect_list(F.struct("plat", "plon", "spot")).alias("spots"))
    return PointTree(tuple(levels), staged(gathered))


def _least(size: float, child: Column) -> Column:
    """Squared least distance from (x, y, z) to a child cell."""
    total = None
    for c in "xyz":
        below = child[f"low_{c}"] - F.col(c)
        outside = F.greatest(below, -below - size, F.lit(0.0))
        total = outside * outside if total is None else total + outside * outside
    return total


def _to_one(child: Column) -> Column:
    """Squared distance from (x, y, z) to the point that a child cell shows."""
    x, y, z = (child["one"][c] - F.col(c) for c in "xyz")
    return x * x + y * y + z * z


def _able(least: Column, bound: Column) -> Column:
    return least <= bound * 1.000001 + 1e-20  # room for rounding


def nearest(points: DataFrame, tree: PointTree, max_km: float | None = None, min_rows: int = HOT_ROWS) -> DataFrame:
    """(lat, lon) to its nearest known point within ``max_km``: place, region, distance_km; ties by place, region."""
    limit = 5.0 if max_km is None or max_km >= math.pi * EARTH_KM else 4 * math.sin(max_km / (2 * EARTH_KM)) ** 2
    sites = points.filter(_placed("lat", "lon")).select("lat", "lon").distinct()
    frontier = sites.select("lat", "lon", *_in_space("lat", "lon"), F.lit(limit).alias("bound"), F.lit(ROOT).alias("cell"))
    site, ended = Window.partitionBy("lat", "lon"), None
    for level, children in enumerate(tree.levels, 1):
        met = lookup_join(frontier, children, ["cell"], ["lat", "lon"], min_rows).drop("cell")
        size = 2.0 / FAN**level
        seen = met.withColumn("bound", F.least("bound", F.array_min(F.transform("children", _to_one))))
        sized = F.transform("children", lambda c: F.struct(c["cell"].alias("cell"), c["leaf"].alias("leaf"), _least(size, c).alias("least")))
        able = seen.select("lat", "lon", "x", "y", "z", "bound", F.explode(F.filter(sized, lambda c: _able(c["least"], F.col("bound")))).alias("c"))
        shared = able.select("lat", "lon", "x", "y", "z", "c.*", F.min("bound").over(site).alias("bound"))
        step = staged(shared.filter(_able(F.col("least"), F.col("bound"))))
        leaves = step.filter("leaf").select("lat", "lon", "cell", "least", "bound")
        ended = leaves if ended is None else ended.unionByName(leaves)
        frontier = step.filter("not leaf").drop("leaf", "least")
        if level + 1 < len(tree.levels) and frontier.isEmpty():
            break
    chosen = ended.withColumn("bound", F.min("bound").over(site)).filter(_able(F.col("least"), F.col("bound"))).select("lat", "lon", "cell")
    pairs = lookup_join(chosen, tree.leaves, ["cell"], ["lat", "lon"], min_rows).select("lat", "lon", F.explode("spots").alias("s"))
    km = haversine(F.col("lat"), F.col("lon"), F.col("s.plat"), F.col("s.plon"))
    measured = pairs.select("lat", "lon", F.struct(km.alias("km"), F.col("s.spot.place").alias("place"), F.col("s.spot.region").alias("region")).alias("seen"))
    near = measured if max_km is None else measured.filter(F.col("seen.km") <= max_km)
    best = near.groupBy("lat", "lon").agg(F.min("seen").alias("best"))
    return best.select("lat", "lon", "best.place", "best.region", F.col("best.km").alias("distance_km"))
