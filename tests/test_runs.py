"""Whole runs on a small crawl."""

import glob
import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siteweave import schemas as S
from siteweave.operators import children, metrics
from siteweave.plans import export, incremental, research
from siteweave.plans.research import Crawl
from siteweave.session import shared_dir, staged
from siteweave.sources import tables
from siteweave.streaming import intake

KEEP = "This paragraph is long enough to be kept as content. "
LISTING = [
    ("https://s/en/monuments/1", "Karnak Temple", "Luxor", "Short words", "k.jpg", "monuments", 1),
    ("https://s/en/monuments/2", "Lost Mound", "", "No page", "", "monuments", 2),
    ("https://s/en/museums/3", "Gem Hall", "somewhere", "d" * 300, "", "museums", 1),
    ("https://s/en/archaeological-sites/4", "Kom el-Dikka", "Alexandria", "", "", "archaeological-sites", 9),
]
PAGES = [
    ("https://s/en/monuments/1", f"<h1>Karnak page</h1><p>{KEEP}A new kingdom Temple of Amun with a Sacred Lake.</p>"),
    ("https://s/ar/monuments/1", "<h1>معبد الكرنك</h1>"),
    ("https://s/en/museums/3", f"<h1>Hall</h1><p>{KEEP}A museum.</p>"),
    ("https://s/en/archaeological-sites/4", f"<h2>none</h2><p>{KEEP}A roman theater.</p>"),
]
ARTICLES = [
    ("en", "Karnak Temple (Luxor)", "Sum[1] mary", "It was the largest old kingdom temple of Ramesses II.", "https://w/k", {"ar": "الكرنك"}),
    ("ar", "الكرنك", "x[1] y", "نص", "https://w/ar", None),
    ("en", "Kom El-Deka", "A place in Egypt", "Nothing told.", "https://w/d", None),
]
GAZETTEER = [
    ("Karnak page, Egypt", 1, "25.7", "32.6", {"state": "Luxor"}), ("Gem Hall, somewhere, Egypt", 1, "x", "1", {"state": "Giza Governorate"}),
]


@pytest.fixture(scope="module")
def crawl(spark):
    return Crawl(
        spark.createDataFrame(LISTING, S.LISTING), spark.createDataFrame(PAGES, S.PAGE), spark.createDataFrame(ARTICLES, S.ARTICLE),
        spark.createDataFrame(GAZETTEER, S.GAZETTEER),
    )


@pytest.fixture(scope="module")
def site(crawl):
    return staged(research.research_sites(crawl))


def test_research(site):
    rows = {r["name"]: r for r in site.collect()}
    assert set(rows) == {"Karnak Temple", "Gem Hall", "Kom el-Dikka"}
    karnak, gem, kom = rows["Karnak Temple"], rows["Gem Hall"], rows["Kom el-Dikka"]
    assert [kom["id"], karnak["id"], gem["id"]] == ["site_001", "site_002", "site_003"]
    assert karnak["era"] == "old kingdom"  # the article's period wins, as spelled
    assert karnak["tourismType"] == "Pharaonic" and karnak["placeType"] == "Temple" and karnak["governorate"] == "Luxor"
    assert karnak["arabicName"] == "معبد الكرنك" and (karnak["latitude"], karnak["longitude"]) == (25.7, 32.6)
    assert karnak["imageNames"] == ["k.jpg"] and karnak["shortDescription"] == "Short words"
    assert [s["name"] for s in karnak["subLocations"]] == ["Temple of Amun With", "Sacred Lake"]
    assert karnak["keyFigures"] == ["Ramesses"] and karnak["uniqueFacts"] == ["It was the largest old kingdom temple of Ramesses II."]
    assert karnak["wikipediaUrl"] == "https://w/k" and karnak["rating"] is None and karnak["openingHours"] == ""
    assert [p["english"] for p in karnak["arabicPhrases"]] == ["Ramesses", "Amun", "Sacred Lake", "Temple"]
    assert gem["governorate"] == "Giza" and gem["latitude"] is None and gem["officialWebsite"].endswith("museum.org")
    assert gem["wikipediaUrl"] == "" and gem["uniqueFacts"] == [] and len(gem["shortDescription"]) == 200
    assert kom["wikipediaUrl"] == "https://w/d" and kom["era"] == "Roman" and kom["tourismType"] == "Greco-Roman"


def test_summary_and_coverage(site):
    summary = {r["name"]: r for r in metrics.site_summary(site).collect()}
    assert summary["Gem Hall"]["era"] == "N/A" and summary["Karnak Temple"]["type"] == "Pharaonic / Temple"
    total = {r.page_type: r for r in metrics.coverage(site).collect()}["ALL"]
    assert (total.sites, total.matched, total.facts) == (3, 0.666667, 0.333333)


def test_export(spark, site):
    path = shared_dir(spark)
    counts = {r.table_name: r.rows for r in export.write(site, path).collect()}
    assert counts["sites"] == 3 and counts["subLocations"] == counts["cards"] == 4
    lines = [json.loads(line) for f in glob.glob(path + "/sites/*.json") for line in open(f, encoding="utf-8")]
    karnak = next(r for r in lines if r["name"] == "Karnak Temple")
    assert list(karnak) == S.EXPORTED_SITE and karnak["arabicName"] == "معبد الكرنك"
    assert next(r for r in lines if r["name"] == "Gem Hall")["latitude"] is None
    assert {r.name for r in tables.existing_names(spark, path).collect()} == {"Karnak Temple", "Gem Hall", "Kom el-Dikka"}


def test_export_document(spark, site):
    path = shared_dir(spark)
    export.write_document(site, path)
    [part] = glob.glob(path + "/part-*")
    text = open(part, encoding="utf-8").read()
    document = json.loads(text)
    assert list(document) == ["sites", "subLocations", "cards", "tips", "arabicPhrases"]
    assert [r["id"] for r in document["sites"]] == ["site_001", "site_002", "site_003"]
    assert list(document["tips"][0]) == ["siteId", "tip"] and "معبد الكرنك" in text and "\n" in text.strip()
    assert {r.name for r in tables.existing_names(spark, part).collect()} == {"Karnak Temple", "Gem Hall", "Kom el-Dikka"}
    back = export.read_document(spark, path)
    for name, df in export.tables(site).items():
        assert sorted(map(str, back[name].collect())) == sorted(map(str, df.drop("pos").collect())), name
    assert os.listdir(path) == ["part-document.json"]


def test_export_document_without_rows(spark, site):
    path = shared_dir(spark)
    export.write_document(site.filter("false"), path)
    document = json.load(open(path + "/part-document.json", encoding="utf-8"))
    assert document == {"sites": [], "subLocations": [], "cards": [], "tips": [], "arabicPhrases": []}


def test_large_export_document(spark, site):
    """Above 100,000 rows, in several tasks, in order, and written over an earlier document."""
    path = shared_dir(spark)
    export.write_document(site, path)
    many = site.drop("id").limit(1).crossJoin(spark.range(1, 60_001)).withColumn("id", F.format_string("site_%03d", "id"))
    many = many.withColumn("tips", F.array(F.lit("first \"tip\"\nof two"), F.lit("zweiter, größer")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions stay as they are, so there are several
    try:
        export.write_document(many, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    document = json.load(open(path + "/part-document.json", encoding="utf-8"))
    assert [r["id"] for r in document["sites"]] == [f"site_{n:03d}" for n in range(1, 60_001)]
    assert len(document["tips"]) == 120_000 and [r["tip"][:5] for r in document["tips"]] == ["first", "zweit"] * 60_000
    assert export.read_document(spark, path)["tips"].count() == 120_000


def test_cards_and_nesting(spark, site):
    cards = {r.id: r.fullDescription for r in children.cards(site).collect()}
    assert cards["site_002_sub_01_card_01"].startswith(KEEP.strip()) and len(cards) == 4
    tips = children.tips(site)
    nested = {r.siteId: [t["tip"] for t in r.tips] for r in children.nest(tips, "siteId", "pos", "tips").collect()}
    assert nested == {r.id: list(r.tips) for r in site.select("id", "tips").collect()}


def test_existing_names_of_nothing(spark, tmp_path):
    assert tables.existing_names(spark, str(tmp_path / "none")).count() == 0
    for name, text, wanted in (("bad.json", "{not json", 0), ("empty.json", "{}", 0), ("ok.json", '{"sites": [{"name": "A"}, {"name": ""}, {"x": 1}, {"name": "A"}]}', 1)):
        (tmp_path / name).write_text(text)
        assert tables.existing_names(spark, str(tmp_path / name)).count() == wanted


def test_saved_answers(spark):
    saved = spark.createDataFrame(
        [("q1", '{"query": {"search": [{"title": "A", "snippet": "s"}, {"title": "B"}]}}'), ("q2", "broken"), ("q3", "{}")], "query STRING, body STRING"
    )
    assert [tuple(r) for r in tables.search_hits(saved).orderBy("rank").collect()] == [("q1", 1, "A", "s"), ("q1", 2, "B", "")]
    geo = spark.createDataFrame([("q", '[{"lat": "1.5", "lon": "2", "address": {"state": "Giza"}}, {"lat": "x"}]'), ("e", "[]")], "query STRING, body STRING")
    assert [(r["rank"], r.lat, r.address) for r in tables.geo_answers(geo).orderBy("rank").collect()] == [(1, "1.5", {"state": "Giza"}), (2, "x", None)]


def test_pending_by_type(spark):
    """A name or address of an earlier type is skipped, a repeat within a type is not."""
    rows = [
        ("u1", "A", "archaeological-sites", 1), ("u2", "A", "archaeological-sites", 2), ("u3", "A", "monuments", 1), ("u1", "B", "monuments", 2),
        ("u4", "C", "monuments", 3), ("u5", "D", "museums", 1), ("u6", "C", "museums", 2), ("u7", "old", "museums", 3), ("u7", "E", "sunken-monuments", 1),
    ]
    listing = spark.createDataFrame(rows, "url STRING, name STRING, page_type STRING, pos LONG")
    done = spark.createDataFrame([("u0", "old"), ("", "")], "url STRING, name STRING")
    got = {(r.url, r.name) for r in incremental.pending_by_type(listing, done).collect()}
    assert got == {("u1", "A"), ("u2", "A"), ("u4", "C"), ("u5", "D"), ("u7", "E")}


def test_dry_run(spark, crawl):
    existing = spark.createDataFrame([("Gem Hall",), ("Unlisted",)], "name STRING")
    result = incremental.dry_run(crawl.listing, existing, ["museums", "monuments"], 1)
    assert {(r.name, r.number, r.status) for r in result["rows"].collect()} == {("Karnak Temple", 1, "New"), ("Gem Hall", 1, "Already exists")}
    assert {r.page_type: r.sites for r in result["by_type"].collect()} == {"museums": 1, "monuments": 1, "ALL": 2}
    assert result["totals"].first().asDict() == {"total": 2, "new_sites": 1, "existing_sites": 1, "existing_names": 2, "new_by_difference": 0}


def numbers(store):
    return {r["name"]: r["id"] for r in store.output_table("sites", "id STRING, name STRING").collect()}


def test_incremental_runs(spark, crawl):
    store = incremental.Store(spark, shared_dir(spark))
    first = Crawl(crawl.listing.filter("page_type = 'museums'"), crawl.pages, crawl.articles, crawl.gazetteer)
    incremental.run(first, store, page_types=["museums"])
    assert numbers(store) == {"Gem Hall": "site_001"}
    assert [r.page_type for r in store.completed().collect()] == ["museums"]
    incremental.run(crawl, store)
    assert numbers(store) == {"Gem Hall": "site_001", "Kom el-Dikka": "site_002", "Karnak Temple": "site_003"}
    status = {r["name"]: r["status"] for r in store.processed().collect()}
    assert status == {"Gem Hall": "done", "Kom el-Dikka": "done", "Karnak Temple": "done", "Lost Mound": "failed"}
    stats = metrics.checkpoint_stats(store.processed(), store.completed()).first()
    assert stats.total_processed == 4 and stats.page_types_completed == 4
    # a new run has nothing left to do
    store.spark.createDataFrame([], S.COMPLETED_TYPE).write.mode("overwrite").parquet(f"{store.path}/completed")
    incremental.run(crawl, store)
    assert numbers(store) == {"Gem Hall": "site_001", "Kom el-Dikka": "site_002", "Karnak Temple": "site_003"}
    done = staged(store.processed().drop("batch"))
    store.clear()
    assert store.processed().count() == 0 and store.completed().count() == 0
    tables.append(done.limit(1), f"{store.path}/processed/batch=extra")
    assert store.processed().count() == 0  # not published
    store.publish("extra")
    assert store.processed().count() == 1
    # the export stays, and a run after it adds to it under new numbers
    incremental.run(Crawl(crawl.listing.filter("name = 'Gem Hall'"), crawl.pages, crawl.articles, crawl.gazetteer), store)
    ids = sorted(r.id for r in store.output_table("sites", "id STRING").collect())
    assert ids == ["site_001", "site_002", "site_003"] + (["site_004"] if done.first()["name"] != "Gem Hall" else [])


@pytest.mark.parametrize("lost_at", ["processed", "publish"])
def test_a_lost_driver_leaves_no_trace(spark, crawl, monkeypatch, lost_at):
    """The driver dies after the export, or after export and progress; the next run gives each site once."""
    store = incremental.Store(spark, shared_dir(spark))
    gem = Crawl(crawl.listing.filter("name = 'Gem Hall'"), crawl.pages, crawl.articles, crawl.gazetteer)

    class Lost(Exception):
        pass

    def lose(*_):
        raise Lost

    with monkeypatch.context() as patch:
        patch.setattr(incremental.Store, "publish", lose)
        with pytest.raises(Lost):
            incremental.run(gem, store)
    if lost_at == "processed":
        tables.reset(spark, f"{store.path}/processed", partition="batch")
    incremental.run(gem, store)
    assert [(r.id, r["name"]) for r in store.output_table("sites", "id STRING, name STRING").collect()] == [("site_001", "Gem Hall")]
    assert store.processed().count() == 1


def test_stream_after_a_run(spark, crawl):
    store, folder, checkpoint = incremental.Store(spark, shared_dir(spark)), shared_dir(spark), shared_dir(spark)
    karnak = Crawl(crawl.listing.filter("name = 'Karnak Temple'"), crawl.pages, crawl.articles, crawl.gazetteer)
    incremental.run(karnak, store, mark_completed=False)
    crawl.listing.filter("name in ('Karnak Temple', 'Gem Hall')").write.parquet(folder)
    intake.research_stream(intake.listing_stream(spark, folder), crawl, store, checkpoint).awaitTermination()
    assert numbers(store) == {"Karnak Temple": "site_001", "Gem Hall": "site_002"}


def test_other_types_orders_repeats_and_blanks(spark, crawl):
    """A fifth page type and a null one, types in the caller's order, snapshot rows stored twice, a null location and position."""
    extra = [("https://s/en/gardens/5", "Rose Garden", None, "x", "", "gardens", 1), ("https://s/en/gardens/6", "Palm Garden", "", "x", "", "gardens", None), ("https://s/en/x/7", "Odd Mound", "", "x", "", None, 1)]
    pages = [(u, f"<h1>G</h1><p>{KEEP}A garden.</p>") for u, *_ in extra]
    listing = spark.createDataFrame(LISTING + extra, S.LISTING)
    twice = Crawl(
        listing, crawl.pages.unionByName(crawl.pages).unionByName(spark.createDataFrame(pages, S.PAGE)), crawl.articles.unionByName(crawl.articles), crawl.gazetteer.unionByName(crawl.gazetteer),
    )
    store = incremental.Store(spark, shared_dir(spark))
    incremental.run(twice, store)
    assert numbers(store) == {"Kom el-Dikka": "site_001", "Karnak Temple": "site_002", "Gem Hall": "site_003", "Rose Garden": "site_004", "Palm Garden": "site_005", "Odd Mound": "site_006"}
    assert {r.page_type for r in store.completed().collect()} >= {"gardens", "museums", None}
    assert incremental.pending_types(listing, store.completed()).isEmpty()
    assert incremental.pending_by_type(listing, store.processed().limit(0)).count() == listing.count()
    ordered = research.research_all(twice, ["museums", "gardens", "monuments"]).select("id", "name").collect()
    assert sorted((r.id, r["name"]) for r in ordered) == [("site_001", "Gem Hall"), ("site_002", "Rose Garden"), ("site_003", "Palm Garden"), ("site_004", "Karnak Temple")]


def test_stream_of_listing_rows(spark, crawl):
    folder, store, checkpoint = shared_dir(spark), incremental.Store(spark, shared_dir(spark)), shared_dir(spark)

    def feed_and_run(rows):
        rows.write.mode("append").parquet(folder)
        stream = intake.listing_stream(spark, folder)
        intake.research_stream(stream, crawl, store, checkpoint).awaitTermination()
        return set(numbers(store))

    gem = crawl.listing.filter("name = 'Gem Hall'")
    assert feed_and_run(gem.unionByName(gem).coalesce(1)) == {"Gem Hall"}
    again = gem.unionByName(crawl.listing.filter("name = 'Karnak Temple'")).coalesce(1)
    assert feed_and_run(again) == {"Gem Hall", "Karnak Temple"}
    assert store.processed().count() == 2 and numbers(store)["Karnak Temple"] == "site_002"


def test_changed_pages(spark, crawl):
    stored = crawl.pages.select("url", F.xxhash64("html").alias("content_hash"))
    edited = crawl.pages.withColumn("html", F.when(F.col("url").endswith("/3"), F.lit("new")).otherwise(F.col("html")))
    assert incremental.changed_pages(crawl.pages, stored).count() == 0
    assert [r.url for r in incremental.changed_pages(edited, stored).collect()] == ["https://s/en/museums/3"]


def test_pages_are_parsed_once_and_markup_is_not_shuffled(spark, crawl):
    plan = research.page_contents(crawl.pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = research.page_rows(crawl.listing, crawl.pages.unionByName(crawl.pages))
    assert rows.count() == 3 and "html" not in rows._jdf.queryExecution().executedPlan().toString()


def test_distinct_addresses_over_ten_batches(spark, monkeypatch):
    """Addresses repeat within and across batches, also when the filter is full; its size stays within its bound."""
    for bits in (intake.FILTER_BITS, 64):
        monkeypatch.setattr(intake, "FILTER_BITS", bits)
        folder, path, checkpoint = (shared_dir(spark) for _ in range(3))
        seen = set()
        for n in range(10):
            urls = [f"https://s/{i}" for i in range(n * 30, n * 30 + 60)] * 2 + [None]
            spark.createDataFrame([(u, u, "", "", "", "t", n) for u in urls], S.LISTING).coalesce(1).write.mode("append").parquet(folder)
            stream = intake.listing_stream(spark, folder).select("page_type", "url")
            intake.distinct_addresses(stream, path, checkpoint).awaitTermination()
            seen |= set(urls)
        got = [r.url for r in spark.read.schema("page_type STRING, url STRING").parquet(path).collect()]
        assert len(got) == len(seen) == len(set(got)) and set(got) == seen
        for slot in (0, 1):
            state = spark.read.parquet(f"{checkpoint}-filter/{slot}")
            assert sum(len(r.bits) for r in state.collect()) <= max(1, bits // 32768) * 4096
    again = intake.distinct_addresses(intake.listing_stream(spark, folder).select("page_type", "url"), path, shared_dir(spark))  # another query
    again.awaitTermination()
    assert spark.read.schema("page_type STRING, url STRING").parquet(path).count() == len(seen)


def test_checkpoint_documents(spark):
    """Whole, partial, mistyped and unreadable documents, and none."""
    from siteweave.session import local_table

    path = shared_dir(spark)
    os.makedirs(path)
    whole = {
        "processed_urls": ["http://test.com", "", None], "processed_names": ["Test Site"], "page_types_completed": ["monuments"],
        "total_processed": 1, "last_updated": "2024-05-06T07:08:09.123456", "version": "1.0",
    }
    texts = [
        json.dumps(whole, indent=2), json.dumps({"processed_names": ["Größe"]}, ensure_ascii=False), "not valid json", "",
        json.dumps({"processed_urls": ["http://kept.com"], "processed_names": "no list"}), json.dumps(whole)[:60],
    ]
    for number, text in enumerate(texts):
        with open(f"{path}/{number}.json", "w", encoding="utf-8") as f:
            f.write(text)
    found = staged(tables.checkpoint_documents(tables.checkpoint_bodies(spark, path)))
    rows = tables.checkpoint_progress(found)
    assert rows.schema.simpleString() == local_table(spark, [], S.PROCESSED).schema.simpleString()
    assert {(r.url, r.name, r.status) for r in rows.collect()} == {
        ("http://test.com", "", "done"), ("", "Test Site", "done"), ("", "Größe", "done"), ("http://kept.com", "", "done")
    }
    [kept] = rows.filter("url = 'http://test.com'").collect()
    assert str(kept.updated_at) == "2024-05-06 07:08:09.123456"
    assert [r.page_type for r in tables.checkpoint_types(found).collect()] == ["monuments"]
    assert found.filter("malformed").count() == 3  # an empty file has no row
    blank = local_table(spark, [("",), (None,)], "body STRING")
    assert [r.malformed for r in tables.checkpoint_documents(blank).collect()] == [True, True]
    assert tables.checkpoint_bodies(spark, path + "/none").count() == 0
    store = incremental.Store(spark, shared_dir(spark))
    store.adopt(path)
    store.adopt(path)  # again: the batch is replaced, not repeated
    assert store.processed().count() == 4 and [r.page_type for r in store.completed().collect()] == ["monuments"]
    listed = local_table(spark, [("http://test.com", "Other", "x", 1), ("u", "Test Site", "x", 2), ("v", "New", "x", 3)], "url STRING, name STRING, page_type STRING, pos LONG")
    assert [r.name for r in incremental.pending_sites(listed, store.processed()).collect()] == ["New"]


def test_only_one_creates_a_file(spark):
    from concurrent.futures import ThreadPoolExecutor

    folder = shared_dir(spark)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: tables.create_once(spark, f"{folder}/1.json", str(n)), range(40)))
    assert sum(won) == 1 and open(f"{folder}/1.json").read() == str(won.index(True)) and os.listdir(folder) == ["1.json"]
    assert [tables.create_once(spark, f"file://{folder}/2.json", "x") for _ in range(2)] == [True, False]


def test_two_runs_at_once(spark, crawl, monkeypatch):
    """A second run publishes while the first has its batch worked out: ids are distinct, nothing is lost or repeated."""
    store = incremental.Store(spark, shared_dir(spark))
    other = incremental.Store(spark, store.path)
    save, versions = incremental.Store.save, []

    def interrupted(self, site, progress, batch, version, *more):
        if self is store and not versions:
            versions.append(version)
            listed = crawl.listing.filter("page_type = 'museums' or name = 'Lost Mound'")
            incremental.run(replace(crawl, listing=listed), other, mark_completed=False)
        versions.append(version)
        return save(self, site, progress, batch, version, *more)

    monkeypatch.setattr(incremental.Store, "save", interrupted)
    incremental.run(crawl, store, ["monuments", "museums"], mark_completed=False)
    assert versions == [0, 0, 1, 0, 2]  # first try (marked and saved after the other's two batches), then the repeat
    sites = [(r.id, r["name"]) for r in store.output_table("sites", "id STRING, name STRING").collect()]
    assert sorted(sites) == [("site_001", "Gem Hall"), ("site_002", "Karnak Temple")]
    assert sorted(r["name"] for r in store.processed().collect()) == ["Gem Hall", "Karnak Temple", "Lost Mound"]
    assert store.version() == 3


def test_update_equals_a_fresh_run(spark, crawl):
    """Of three sites one has a changed page and one a new Arabic page; afterwards all five tables are those of a fresh run."""
    schemas = {
        "sites": "id STRING, name STRING, arabicName STRING, era STRING, shortDescription STRING", "subLocations": "id STRING, name STRING",
        "cards": "id STRING, fullDescription STRING", "tips": "siteId STRING, tip STRING", "arabicPhrases": "siteId STRING, english STRING",
    }

    def export_of(store):
        return {name: sorted(map(str, store.output_table(name, schema).drop("batch").collect())) for name, schema in schemas.items()}

    store, fresh = (incremental.Store(spark, shared_dir(spark)) for _ in range(2))
    incremental.run(crawl, store)
    before = export_of(store)
    new = [
        ("https://s/en/monuments/1", f"<h1>Karnak page</h1><p>{KEEP}Now a coptic church with an Inner Hall.</p>"), *PAGES[1:],
        ("https://s/ar/museums/3", "<h1>قاعة</h1>"), ("https://s/en/other/9", "<p>of no site</p>"),
    ]
    later = replace(crawl, pages=spark.createDataFrame(new, S.PAGE))
    incremental.update(later, store)
    incremental.run(later, fresh)
    after = export_of(store)
    assert after == export_of(fresh) and after != before and all(after.values())
    version = store.version()
    incremental.update(later, store)
    assert store.version() == version  # nothing has changed since
    assert sum("Kom el-Dikka" in row for row in after["sites"]) == 1 and store.last_number() == 3
