"""Join and numbering helpers that hold up when one key owns a large share of the rows."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.session import staged

HOT_KEYS = 10_000       # most keys that are split; any other key has less than 1/10,000 of the rows
HOT_ROWS = 1_000_000    # rows from which a key is worth splitting
SALTS = 64


def hot_keys(fact: DataFrame, keys: list[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """The most frequent keys: never more than ``HOT_KEYS`` rows, whatever the size of ``fact``."""
    counts = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_rows)
    return counts.orderBy(F.desc("_rows"), *keys).limit(HOT_KEYS).drop("_rows")


def is_small(df: DataFrame) -> bool:
    """Whether Spark itself would broadcast ``df`` by the size it knows (files, local rows); never where rows are multiplied."""
    frame = getattr(df, "_jdf", None)
    if frame is None:
        return False
    plan = frame.queryExecution().optimizedPlan()
    limit = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return int(plan.stats().sizeInBytes()) <= limit and "Generate " not in plan.toString() and "Join " not in plan.toString()


def lookup_join(
    fact: DataFrame,
    answers: DataFrame,
    keys: list[str],
    spread_by: list[str],
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a table with one row per key, safe for hot keys on the fact side.

    Rows of a hot key carry one of ``SALTS`` salts, taken from ``spread_by``, and its answer is there once per
    salt; so do rows with a null key, which match nothing.  Hot keys without an answer are spread alike.  All other
    rows and answers have salt 0.  The salt is data on both sides, so it takes part in the partitioning.  Only the
    hot keys, not their answers, are broadcast.  Answers that Spark broadcasts by their known size need none of this.
    """
    values = [c for c in answers.columns if c not in keys]
    if is_small(answers):
        return fact.join(answers, keys, "left").select(*fact.columns, *values)
    hot = hot_keys(fact.select(*keys), keys, min_rows).withColumn("_hot", F.lit(True))
    marked = fact.join(F.broadcast(hot), keys, "left")
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int") + 1
    salted = marked.withColumn("_salt", F.when(F.col("_hot") | missing, spread).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    copies = answers.join(F.broadcast(hot), keys, "left").select(*keys, *values, F.explode(every).alias("_salt"))
    return salted.join(copies, [*keys, "_salt"], "left").select(*fact.columns, *values)


def without(fact: DataFrame, known: DataFrame, key: str, spread_by: list[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``fact`` whose key is not in ``known`` (an anti-join that keeps hot keys apart)."""
    marks = known.select(key).distinct().withColumn("_known", F.lit(True))
    return lookup_join(fact, marks, [key], spread_by, min_rows).filter("_known is null").drop("_known")


def number_rows(
    df: DataFrame, position: str, number: str, groups: list[str] | None = None, order: Column | None = None, tie: Column | None = None
) -> DataFrame:
    """Running number 1, 2, 3, ... by ``position``, per group or (with ``order``) over all groups.

    A window over a group would put it into one task.  Rows are range-partitioned by order, group, position and a hash of all
    columns, and written with their place in their partition; how many rows the partitions before hold (one row per partition, or
    per partition and group) is added.  Equal and missing positions are split by the hash, so whatever share of the rows has none,
    they are dealt like all others.  Rows without a position come last in their group; a null group is a group of its own.
    A hash that the caller has made (of columns that are not here any more) may be given as ``tie``.
    """
    groups = groups or []
    keys = [*([order] if order is not None else []), *[F.col(g) for g in groups], F.col(position).asc_nulls_last(), F.xxhash64(*df.columns) if tie is None else tie]
    placed = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    within = ["_part"] if order is not None else ["_part", *groups]
    counts = placed.groupBy(*within).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*within[1:]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    offsets = before.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(within)], "_before", "_first")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(within)])
    return placed.join(offsets, same).withColumn(number, F.col("_before") + F.col("_place") - F.col("_first") + 1).select(*df.columns, number)
