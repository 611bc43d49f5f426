"""Connected components by hooking and pointer jumping, on DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.rows import answer_join
from siteweave.session import staged


def _follow(rows: DataFrame, column: str, parents: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``column`` replaced by its parent where it has one.

    Keys without a parent are answered too, with null: the centre of a star is such a key, and as a hot one it must not go
    through the shuffle.
    """
    asked = rows.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_asked"))
    answers = asked.join(parents.select(F.col("node").alias("_key"), F.col("parent").alias("_to")), "_key", "left")
    found = answer_join(rows.withColumnRenamed(column, "_key"), answers, ["_key"], "_asked", total, "left")
    return found.withColumn(column, F.coalesce("_to", "_key")).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) with a larger label than its component's least node.

    Each round lets every node point to its least smaller neighbour, follows the pointers to their roots,
    and replaces the edges by edges between roots.  Hubs are joined by ``answer_join``.  Nodes that are the
    least of their component have no row.
    """
    labels = None
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while total := edges.count():
        parents = staged(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        while True:
            jumped = staged(_follow(parents.select("node", F.col("parent").alias("old"), F.col("parent").alias("root")), "root", parents, total))
            parents = jumped.select("node", F.col("root").alias("parent"))
            if jumped.filter("old <> root").isEmpty():
                break
        labels = parents if labels is None else staged(_follow(labels, "parent", parents, total).unionByName(parents))
        moved = _follow(_follow(edges, "b", parents, total), "a", parents, total)
        edges = staged(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.groupBy("node").agg(F.min("parent").alias("label"))
