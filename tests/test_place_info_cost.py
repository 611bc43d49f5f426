"""How often the long texts of captured map pages are read."""

import re

from pyspark.sql import functions as F

from siteweave.functions import extract as X
from siteweave.functions import rules as R
from siteweave.plans.catalog import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hours_are_searched_once(spark, values):
    rows = spark.createDataFrame([("x",)], "c STRING")
    plan = optimized(rows.select(X.hours_range(F.col("c")).alias("h")))
    assert len(re.findall(r"regexp_extract\(c#", plan)) == 1
    assert optimized(rows.select(R.mentions_hours(F.col("c")).alias("m"))).count("lower(") == 1
    texts = ["Monday 9 am to 5 PM", "9:30 AM - 5 PM and 7 - 8", "12:00–14", "345 to 67", "no hours", "", None, "7   8", "1 ot- 2 AM", "9 to  5  AMx"]
    wanted = ["9 am - 5 PM", "9:30 AM - 5 PM", "12:00 - 14", "45 - 67", "", "", "", "", "1  - 2 AM", "9  - 5  AM"]
    got = values(X.hours_range, *texts)
    assert [g.split() for g in got] == [w.split() for w in wanted]


def test_hours_map_is_built_once(spark, tmp_path):
    text = "Quiet place. Open.\nA second line of some length\nthird"
    spark.createDataFrame([(k, text * (k % 3)) for k in range(20)], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"https://h/{k}", "<p>") for k in range(0, 20, 2)], "page_id LONG, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["place_info"](spark, str(tmp_path))
    assert rows.count() == 20
    plan = optimized(rows)
    assert "map_from_entries" in plan and re.search(r"=, element_at\(lambda \w+#\d+, lambda", plan)  # not the map's expression, once per weekday
