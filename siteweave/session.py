"""Session settings and the shared work folder."""

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def build(app: str = "siteweave", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partitions are left to the cluster: AQE coalesces small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new sub-folder of the folder that all executors reach.

    ``spark.checkpoint.dir`` names that folder.  A session whose tasks are all threads of this process may
    go without it: one temporary folder then serves the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = _local_roots.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="siteweave-")
        _local_roots[spark.sparkContext.applicationId] = root
    return os.path.join(root, "siteweave-" + uuid.uuid4().hex)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table.

    It goes in as an Arrow table, which makes a local relation: Catalyst knows its size, so it decides
    by size whether to broadcast it.
    """
    columns = StructType.fromDDL(schema)
    arrow = to_arrow_schema(columns)
    names = columns.fieldNames()
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, row)) for row in rows], arrow), columns)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from its files.

    Later steps read only the columns they need, and a lost executor costs no more than re-reading.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
