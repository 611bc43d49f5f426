"""Row identities, numbering and joins shared by the operators."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.session import staged

HOT_SHARE = 5_000  # a key with 1/5000 of the rows or more is hot, so there are at most 5,000 hot keys


def numbered(df: DataFrame, order: list, number: str) -> DataFrame:
    """``df`` with its rows numbered 0, 1, 2, ... in ``order``, without bringing them together.

    Rows are range-partitioned and sorted, then written with their place in their partition; the sizes of
    the partitions (one row each) give the offsets.
    """
    place = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = place.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row per partition
    return (
        place.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(number, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .select(*df.columns, number)
    )


def keyed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``doc_id`` and ``columns`` with a unique ``_row``, in the order of ``doc_id``.

    Where ids are unique and not null, ``_row`` is the id.  Otherwise rows are numbered by id (null last)
    and then by a hash of the columns, so that repeated rows and null ids are documents of their own.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    odd = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return base.withColumn("_row", F.col("doc_id"))
    return numbered(base, [F.col("doc_id").asc_nulls_last(), F.xxhash64(*base.columns[1:])], "_row")


def hot_rows(total: int) -> int:
    return max(20, math.ceil(total / HOT_SHARE))


def answer_join(fact: DataFrame, answers: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``fact`` with ``answers``, which has one row per key and, in ``size``, how many fact rows have it.

    Answers of hot keys are broadcast (at most ``HOT_SHARE`` rows whatever the input), so hot keys never
    meet in one task; all others go through the shuffle join.  Both branches read ``fact``: give a written
    or cheap one.  ``how`` is inner or left.
    """
    limit = hot_rows(total)
    values = [c for c in answers.columns if c not in key]
    hot = answers.filter(F.col(size) >= limit).select(*key, F.struct(*values).alias("_hot"))
    cold = answers.filter(F.col(size) < limit)
    marked = fact.join(F.broadcast(hot), key, "left")
    quick = marked.filter("_hot is not null").select(*fact.columns, *[F.col("_hot")[v].alias(v) for v in values])
    rest = marked.filter("_hot is null").drop("_hot").join(cold, key, how)
    return quick.unionByName(rest.select(*fact.columns, *values))
