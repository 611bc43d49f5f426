"""Stream queries over tables that are one file, as over tables that are folders of part files."""

import glob
import os
import shutil

import pytest

from siteweave.plans.catalog import QUERIES

ROWS = [(k, f"Text of document {k}. It has two sentences.") for k in range(60)]


@pytest.fixture(scope="module", params=["file", "folder"])
def sf(spark, tmp_path_factory, request):
    top = tmp_path_factory.mktemp(request.param)
    documents = spark.createDataFrame(ROWS, "doc_id LONG, text STRING")
    if request.param == "folder":
        documents.repartition(3).write.parquet(f"{top}/documents.parquet")
    else:
        documents.coalesce(1).write.parquet(f"{top}/parts")
        shutil.copy(glob.glob(f"{top}/parts/part-*.parquet")[0], f"{top}/documents.parquet")
    assert os.path.isdir(f"{top}/documents.parquet") == (request.param == "folder")
    return str(top)


def test_incremental_listing(spark, sf):
    listed = QUERIES["listing_card_extract"](spark, sf).select("url", "name")
    got = QUERIES["incremental_listing"](spark, sf)
    assert sorted(got.select("url", "name").collect()) == sorted(listed.collect())
    assert sorted(r.pos for r in got.collect()) == [k for k, _ in ROWS]


def test_stream_dedup(spark, sf):
    listed = QUERIES["listing_card_extract"](spark, sf).select("page_type", "url")
    assert sorted(QUERIES["stream_dedup"](spark, sf).collect()) == sorted(listed.collect())


@pytest.mark.parametrize("name", ["stream_dedup", "incremental_listing"])
def test_documents_in_partition_folders(spark, tmp_path, name):
    documents = spark.createDataFrame([(k, text, "en" if k % 2 else None) for k, text in ROWS], "doc_id LONG, text STRING, lang STRING")
    documents.write.partitionBy("lang").parquet(f"{tmp_path}/documents.parquet")
    listed = QUERIES["listing_card_extract"](spark, str(tmp_path)).select("page_type", "url")
    got = QUERIES[name](spark, str(tmp_path)).select("page_type", "url")
    assert len(ROWS) == listed.count() and sorted(got.collect()) == sorted(listed.collect())
