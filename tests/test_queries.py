"""The registered queries against their SQL on the smallest given tables (all of them: tests/compare.py)."""

import pytest

import __spark_entry__ as entry
from siteweave.checks.statements import STATEMENTS
from siteweave.plans.catalog import QUERIES
from tests.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
CHECKED = [
    "listing_card_extract", "gazetteer_scan", "checkpoint_sink", "paragraph_extract", "class_counts", "term_extract", "fact_extract",
    "hours_parse", "forward_geocode", "skip_processed", "dry_run_status", "site_numbering", "site_tips", "page_facts", "glossary",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_statement():
    assert set(QUERIES) == set(STATEMENTS)


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_type", "era", "tourism_type", "place_type", "sites"]


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == sql_rows(con, entry.oracle_sql()[name])
