"""Export of researched sites as five flat tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteweave import schemas as S
from siteweave.operators import children, metrics
from siteweave.session import local_table, staged
from siteweave.sources import document

OPENING, ROW, CLOSING = range(3)    # kinds of lines of a document, in their order


def tables(site: DataFrame) -> dict[str, DataFrame]:
    return {name: derive(site) for name, derive in children.TABLES.items()}


def write(site: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> DataFrame:
    """Write each table into its own folder below ``path``; returns the row counts.

    Text is UTF-8 as is, and null fields are written.  The site rows are staged once, so the five
    writes do not repeat the research.
    """
    parts = tables(staged(site))
    for name, df in parts.items():
        writer = df.write.mode(mode).format(fmt)
        if fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.save(f"{path}/{name}")
    return metrics.export_counts(parts)


def write_document(site: DataFrame, path: str) -> None:
    """Write the catalogue as one JSON document, of any size, as the only file of the folder ``path``.

    Every row is a line, by id number and place in the site's list.  Lines are range-partitioned in document order; the bytes
    of the partitions before (one number per partition) and of the lines before give each line its offset, and all tasks write
    at once (:mod:`siteweave.sources.document`).
    """
    lines = None
    for rank, (name, df) in enumerate(tables(staged(site)).items()):
        for part in (_body(df), _frame(site.sparkSession, rank, name)):
            part = part.withColumn("_table", F.lit(rank))
            lines = part if lines is None else lines.unionByName(part)
    order = ["_table", "_kind", "_length", "_key", "_pos", F.xxhash64("line")]
    laid = staged(lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    # a row ends with a comma or a blank, so its length does not depend on what follows it
    sized = laid.withColumns({"_part": F.shiftright("_place", 33), "_bytes": F.octet_length("line") + F.when(F.col("_kind") == ROW, 2).otherwise(1)})
    parts = sized.groupBy("_part").agg(F.sum("_bytes").alias("_size"), F.min_by("_kind", "_place").alias("_opens"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = parts.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
        F.lead("_opens").over(Window.orderBy("_part")).alias("_next_opens"),
    )
    within = Window.partitionBy("_part").orderBy("_place")
    before = F.coalesce(F.sum("_bytes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumns({"_before": before, "_next": F.lead("_kind").over(within)}).join(starts, "_part")
    follows = F.coalesce("_next", "_next_opens")
    end = F.when(F.col("_kind") != ROW, F.lit("\n")).when(follows == ROW, F.lit(",\n")).otherwise(F.lit(" \n"))
    document.write(placed.select((F.col("_start") + F.col("_before")).alias("offset"), F.concat("line", end).alias("text")), path)


def _body(df: DataFrame) -> DataFrame:
    """The rows of a table as lines with their place: by id number, then place in the site's list."""
    key = df.columns[0]
    place = F.col("pos") if "pos" in df.columns else F.lit(0)
    row = F.struct(*[c for c in df.columns if c != "pos"])
    line = F.concat(F.lit("    "), F.to_json(row, {"ignoreNullFields": "false"}))
    return df.select(F.lit(ROW).alias("_kind"), F.length(key).alias("_length"), F.col(key).alias("_key"), place.alias("_pos"), line.alias("line"))


def _frame(spark: SparkSession, rank: int, name: str) -> DataFrame:
    """The lines before and after the rows of a table."""
    last = rank == len(children.TABLES) - 1
    opening = ("{\n" if rank == 0 else "") + f'  "{name}": ['
    rows = [(OPENING, 0, "", 0, opening), (CLOSING, 0, "", 0, "  ]\n}" if last else "  ],")]
    return local_table(spark, rows, "_kind INT, _length INT, _key STRING, _pos INT, line STRING")


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a document of :func:`write_document`, read line by line in as many tasks as its size asks for."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit("    {")))
    row = F.regexp_replace("value", r",\s*$", "")
    found = lines.select(row.alias("row"), F.array_join(F.json_object_keys(row), ",").alias("fields"))
    return {
        name: found.filter(F.col("fields") == ",".join(fields)).select(F.from_json("row", schema).alias("r")).select("r.*")
        for name, (fields, schema) in _shapes(spark).items()
    }


def _shapes(spark: SparkSession) -> dict[str, tuple[list[str], StructType]]:
    """Field names and schema of each table's rows in a document."""
    empty = local_table(spark, [], f"{S.SITE}, page_type STRING, url STRING")
    return {name: ([c for c in df.columns if c != "pos"], df.drop("pos").schema) for name, df in tables(empty).items()}
