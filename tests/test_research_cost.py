"""How often long texts are written and pages read."""

import pytest

from siteweave.operators import joins
from siteweave.plans import catalog, export, incremental, research
from siteweave.session import shared_dir, staged
from tests.test_runs import crawl  # noqa: F401


@pytest.fixture
def written(monkeypatch):
    """Column names of the tables that are written."""
    tables = []

    def noted(df):
        tables.append(df.columns)
        return staged(df)

    for module in (research, incremental, joins, catalog, export):
        monkeypatch.setattr(module, "staged", noted)
    return tables


def test_page_and_article_texts_are_written_once(crawl, written):  # noqa: F811
    names = sorted(r["name"] for r in research.research_sites(crawl).collect())
    assert names == ["Gem Hall", "Karnak Temple", "Kom el-Dikka"]
    assert sum("full_description" in columns for columns in written) == 1
    assert sum("intro" in columns for columns in written) == 1


def test_a_short_listing_reads_its_own_pages_only(crawl):  # noqa: F811
    listing = staged(crawl.listing.filter("name = 'Karnak Temple'"))
    urls = {r["url"] for r in research.cut_to_few(crawl.pages, listing).collect()}
    assert urls == {"https://s/en/monuments/1", "https://s/ar/monuments/1"}


def test_a_run_reads_its_pages_once(spark, crawl, written, monkeypatch):  # noqa: F811
    read, contents = [], research.page_contents

    def counted(pages, *kept):
        read.append(pages)
        return contents(pages, *kept)

    monkeypatch.setattr(research, "page_contents", counted)
    store = incremental.Store(spark, shared_dir(spark))
    incremental.run(crawl, store)  # four batches
    assert len(read) == 1
    ids = {r["name"]: r["id"] for r in store.output_table("sites", "id STRING, name STRING").collect()}
    assert sorted(ids.values()) == ["site_001", "site_002", "site_003"] and len(ids) == 3


def test_export_counts_researches_once(spark, tmp_path, written):
    rows = [(k, f"Text {k} with some more words.") for k in range(24)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,), (5,)], "doc_id LONG").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 2)], "c_custkey LONG, c_nationkey LONG").write.parquet(f"{tmp_path}/customer.parquet")
    counts = {r["table_name"]: r["rows"] for r in catalog.QUERIES["export_counts"](spark, str(tmp_path)).collect()}
    assert counts["sites"] == 22 and set(counts) == {"sites", "subLocations", "cards", "tips", "arabicPhrases"}
    assert sum("subLocations" in columns for columns in written) == 1
