"""Dry runs and resumable runs."""

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteweave import lexicons as L
from siteweave import schemas as S
from siteweave.functions import text as T
from siteweave.operators import glossary, metrics
from siteweave.operators.joins import HOT_ROWS, lookup_join, number_rows, without
from siteweave.plans import export, research
from siteweave.plans.research import Crawl
from siteweave.session import local_table, staged
from siteweave.sources import tables


def page_types_of(listing: DataFrame) -> list[str | None]:
    """The known page types in their order, then any others that the listing has, null last (names of types, not rows)."""
    found = {row["page_type"] for row in listing.select("page_type").distinct().collect()}
    return [*L.PAGE_TYPES, *sorted(t for t in found if t is not None and t not in L.PAGE_TYPES), *([None] if None in found else [])]


def of_type(listing: DataFrame, page_type: str | None) -> DataFrame:
    return listing.filter(F.col("page_type").eqNullSafe(F.lit(page_type).cast("string")))


def dry_run_rows(listing: DataFrame, existing: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Listing rows with their number within the type and whether an earlier output has their name."""
    marks = existing.select("name").distinct().withColumn("_known", F.lit(True))
    rows = number_rows(listing.select("page_type", "pos", "url", "name", "location"), "pos", "number", ["page_type"])
    marked = lookup_join(rows, marks, ["name"], ["url"], min_rows)
    known = F.col("_known").isNotNull()
    return marked.select(
        "page_type", "number", "url", "name", "location",
        known.alias("exists_already"),
        F.when(known, F.lit("Already exists")).otherwise(F.lit("New")).alias("status"),
    )


def dry_run(
    listing: DataFrame, existing: DataFrame, page_types: list[str] | None = None, max_sites: int | None = None
) -> dict[str, DataFrame]:
    """What a run would do: rows with status, counts by type, new against existing.  Reads no page."""
    chosen = research.first_of_each_type(research.of_types(listing, page_types), max_sites)
    rows = dry_run_rows(chosen, existing)
    return {
        "rows": rows,
        "by_type": metrics.count_by_type(chosen),
        "totals": metrics.new_vs_existing(rows, existing),
    }


def pending_types(listing: DataFrame, completed: DataFrame) -> DataFrame:
    """Listing rows of page types that are not finished."""
    done = completed.select("page_type").distinct()
    return listing.join(done, listing["page_type"].eqNullSafe(done["page_type"]), "left_anti")


def pending_sites(
    listing: DataFrame, processed: DataFrame, existing: DataFrame | None = None, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Listing rows whose address and name are both new; duplicates among them are kept.

    Two anti-joins, by address and by name, because a join on "either" could not be hashed.
    """
    rows = without(listing, processed.filter("url <> ''"), "url", ["url", "pos"], min_rows)
    rows = without(rows, processed.filter("name <> ''"), "name", ["url"], min_rows)
    return rows if existing is None else without(rows, existing, "name", ["url"], min_rows)


def merge_progress(processed: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty values of both."""
    return processed.select(key).unionByName(new.select(key)).filter(F.col(key) != "").distinct()


def pending_by_type(listing: DataFrame, processed: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """What a whole run would process, type after type.

    A row is skipped if its address or name was processed before, also in an earlier type of this run;
    a repeat within one type is kept.  Each type's rows are written before the next type looks at them.
    """
    done = processed.select("url", "name")
    kept = []
    for page_type in page_types_of(listing):
        rows = staged(pending_sites(of_type(listing, page_type), done, None, min_rows))
        done = done.unionByName(rows.select("url", "name"))
        kept.append(rows)
    result, *rest = kept
    for rows in rest:
        result = result.unionByName(rows)
    return result


def hashed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content_hash", F.xxhash64("html"))


def changed_hashes(pages: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Addresses and hashes of the hashed pages that are new or differ; no markup is shuffled."""
    return pages.select("url", "content_hash").join(known_hashes.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def changed_pages(pages: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Pages that are new or whose content differs from the stored hash, with their present hash."""
    return hashed(pages).join(known_hashes.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


# the column of each output table that starts with the site's id, and the stored key tables
SITE_KEYS = {"sites": "id", "subLocations": "siteId", "cards": "subLocationId", "tips": "siteId", "arabicPhrases": "siteId"}
STORED = {"site_keys": "id STRING, url STRING, name STRING", "page_hashes": "url STRING, content_hash LONG"}


class Store:
    """Folders of a resumable run: progress, finished types, the export, and the versions, which list the published batches.

    Every type of every run is a batch with an id of its own, and all of its output goes to folders of that id.  A
    batch counts, for progress and export alike, once its id is in the list, which is written last.  What a lost
    driver leaves behind is therefore ignored, and its rows are pending again; a replayed stream batch has the id it
    had before and replaces its own folders.  Ids are never used for anything else, so nothing is overwritten.

    Runs may go on at once.  Publishing a batch makes the next version, a file that only one run can create; a run whose
    batch was worked out from an older version does not get it, and works the batch out again from what is stored now.
    So ids stay distinct and no site is added twice; who publishes first never waits.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def output(self) -> str:
        return f"{self.path}/output"

    def published(self, without: str | None = None) -> DataFrame:
        """Ids of the batches that count, but for ``without``."""
        rows = self._versions().select("batch").distinct()
        return rows if without is None else rows.filter(F.col("batch") != without)

    def _versions(self) -> DataFrame:
        schema = "version LONG, batch STRING, replaces BOOLEAN"
        rows = tables.or_none(lambda: self.spark.read.schema(schema).json(f"{self.path}/versions"))
        return local_table(self.spark, [], schema) if rows is None else rows

    def version(self) -> int:
        """Number of the latest version, 0 at the start."""
        return self._versions().agg(F.max("version")).first()[0] or 0

    def processed(self, without: str | None = None, retry_failed: bool = False) -> DataFrame:
        rows = tables.processed(self.spark, f"{self.path}/processed").join(self.published(without), "batch", "left_semi")
        return rows.filter("status <> 'failed'") if retry_failed else rows

    def completed(self) -> DataFrame:
        return tables.completed_types(self.spark, f"{self.path}/completed")

    def existing(self, without: str | None = None) -> DataFrame:
        """Distinct site names of the export."""
        names = self.output_table("sites", "name STRING", without)
        names = local_table(self.spark, [], "name STRING") if names is None else names.select("name")
        return names.filter("name <> ''").distinct()

    def output_table(self, name: str, schema: str, without: str | None = None) -> DataFrame | None:
        """A table of the export: published batches only, and of a site that a later batch replaced, that batch's rows."""
        key = SITE_KEYS[name]
        wanted = [f.name for f in StructType.fromDDL(schema)]
        whole = schema if key in wanted else f"{schema}, {key} STRING"
        rows = tables.or_none(lambda: self.spark.read.schema(f"{whole}, batch STRING").json(f"{self.output}/{name}"))
        if rows is None:
            return None
        rows = rows.join(self.published(without), "batch", "left_semi")
        if self._versions().filter("replaces").isEmpty():
            return rows.select(*wanted, "batch")
        owners = self._latest("site_keys", "id", without).select(F.col("id").alias("_site"), F.col("batch").alias("_owner"))
        own = (F.substring_index(key, "_sub_", 1) == F.col("_site")) & (F.col("batch") == F.col("_owner"))
        return rows.join(owners, own, "left_semi").select(*wanted, "batch")

    def _latest(self, folder: str, key: str, without: str | None = None) -> DataFrame:
        """Rows of a stored key table, for each key those of the latest version only."""
        schema = f"{STORED[folder]}, batch STRING"
        rows = tables.or_none(lambda: self.spark.read.schema(schema).parquet(f"{self.path}/{folder}"))
        if rows is None:
            return local_table(self.spark, [], schema)
        order = self._versions().groupBy("batch").agg(F.max("version").alias("_version"))  # one row per batch
        rows = rows.join(order if without is None else order.filter(F.col("batch") != without), "batch")
        newest = rows.groupBy(key).agg(F.max("_version").alias("_version"))
        return rows.join(newest, [key, "_version"]).drop("_version")

    def page_hashes(self) -> DataFrame:
        """(url, content_hash) of the pages that the export was made from."""
        return self._latest("page_hashes", "url").select("url", "content_hash").distinct()

    def last_number(self, without: str | None = None) -> int:
        """Highest site number of the export."""
        sites = self.output_table("sites", "id STRING", without)
        if sites is None:
            return 0
        number = F.substring("id", len("site_") + 1, 20).cast("long")
        return sites.agg(F.max(number)).first()[0] or 0

    def save(
        self, site: DataFrame, progress: DataFrame, batch: str, version: int, pages: DataFrame | None = None, replaces: bool = False
    ) -> bool:
        """Write the batch's export, progress and page hashes, then publish it, unless the store is past ``version`` by now."""
        site = staged(site)
        for name, df in export.tables(site).items():
            df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{self.output}/{name}/batch={batch}")
        site.select("id", "url", "name").write.mode("overwrite").parquet(f"{self.path}/site_keys/batch={batch}")
        if pages is not None:
            pages.select("url", "content_hash").write.mode("overwrite").parquet(f"{self.path}/page_hashes/batch={batch}")
        progress.write.mode("overwrite").parquet(f"{self.path}/processed/batch={batch}")
        return self.publish(batch, version, replaces)

    def publish(self, batch: str, version: int | None = None, replaces: bool = False) -> bool:
        """Make a batch count as the version after ``version``; without one, as the next that is free."""
        while True:
            latest = self.version() if version is None else version
            text = json.dumps({"version": latest + 1, "batch": batch, "replaces": replaces}) + "\n"
            if tables.create_once(self.spark, f"{self.path}/versions/{latest + 1:020d}.json", text):
                return True
            if version is not None:
                return False

    def complete(self, page_type: str) -> None:
        row = local_table(self.spark, [(page_type,)], "page_type STRING")
        tables.append(row.withColumn("updated_at", F.current_timestamp()), f"{self.path}/completed")

    def adopt(self, path: str) -> None:
        """Take over the checkpoint documents of a file or folder as one batch; adopting the same path again replaces it."""
        documents = staged(tables.checkpoint_documents(tables.checkpoint_bodies(self.spark, path)))
        batch = f"checkpoint-{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        progress = tables.checkpoint_progress(documents).drop("batch")
        progress.write.mode("overwrite").parquet(f"{self.path}/processed/batch={batch}")
        tables.append(tables.checkpoint_types(documents), f"{self.path}/completed")  # read as distinct types
        self.publish(batch)

    def clear(self) -> None:
        """Forget progress and finished types; the export stays, and numbers go on from it."""
        tables.reset(self.spark, f"{self.path}/processed", partition="batch")
        tables.reset(self.spark, f"{self.path}/completed", S.COMPLETED_TYPE)


def run(
    crawl: Crawl,
    store: Store,
    page_types: list[str] | None = None,
    max_sites: int | None = None,
    skip_existing: bool = False,
    retry_failed: bool = False,
    mark_completed: bool = True,
    run_id: str | None = None,
    **options,
) -> None:
    """Research what is new and add it to the store, one page type after the other.

    Site ids go on from the stored maximum.  A site without a page is recorded as failed; it is tried
    again only on request.  ``run_id`` must be given only to replace an earlier run of that id.

    What is pending when the run begins is researched at once, but for the ids.  Each type's batch then takes those of its
    rows that are pending by then, numbers them and is published by itself.
    """
    name = run_id or uuid.uuid4().hex
    skipped = {row["page_type"] for row in store.completed().select("page_type").collect()}  # names of types
    types = [(rank, t) for rank, t in enumerate(page_types or page_types_of(crawl.listing)) if t not in skipped]
    if not types:
        return
    earlier = store.processed(retry_failed=retry_failed)
    if run_id:
        earlier = earlier.filter(~F.startswith("batch", F.lit(f"{name}-")))  # what this run did before is done again
    existing = store.existing() if skip_existing and not run_id else None
    chosen = crawl.listing.filter(reduce(or_, [F.col("page_type").eqNullSafe(F.lit(t).cast("string")) for _, t in types]))
    chosen = research.first_of_each_type(chosen, max_sites)
    found = _research_pending(replace(crawl, listing=chosen), earlier, existing, options)
    for rank, page_type in types:
        batch = f"{name}-{rank:03d}"
        while found and not _run_batch(found, store, page_type, batch, skip_existing, retry_failed):
            pass  # another run published since; each try means that some run got on
        if mark_completed:
            store.complete(page_type)


@dataclass(frozen=True)
class Found:
    """What a run has researched: its pending listing rows, its pages' contents, its site rows but for the ids, and its translations."""

    pending: DataFrame
    contents: DataFrame
    known: DataFrame
    dictionary: DataFrame


def _research_pending(crawl: Crawl, processed: DataFrame, existing: DataFrame | None, options: dict) -> Found | None:
    """Research the listing rows that are pending, all page types at once; None if there are none."""
    blank = research.blank_texts(crawl.listing)
    rows = pending_sites(research.shortened(blank), processed, existing)
    pending = staged(rows.withColumn("_row", F.monotonically_increasing_id()))
    if pending.isEmpty():
        return None
    # only what the run needs is read further on
    crawl = research.snapshot(replace(crawl, listing=pending))
    pages = hashed(crawl.pages.join(research.addresses(pending), "url", "left_semi"))
    contents = staged(research.page_contents(pages, "content_hash"))
    dictionary = research.dictionary_of(crawl)
    keep = ["_row", *[c for c in research.OF_LISTING if c != "id"]]
    known = research.research_rows(pending, contents.drop("content_hash"), crawl, dictionary, keep=keep, **options)
    return Found(pending, contents, staged(known), dictionary)


def _run_batch(found: Found, store: Store, page_type: str | None, batch: str, skip_existing: bool, retry_failed: bool) -> bool:
    """Number and publish what is pending of a page type; False if the store went on meanwhile."""
    version = store.version()  # before anything else is read
    existing = store.existing(batch) if skip_existing else None
    todo = staged(pending_sites(of_type(found.pending, page_type), store.processed(batch, retry_failed), existing))
    if todo.isEmpty():
        return True
    listed = staged(research.numbered(todo, found.contents, store.last_number(batch)).select("_row", "id"))
    known = of_type(found.known, page_type).join(listed, "_row")
    site = research.site_rows(known.withColumn("translations", glossary.lexicon_translations(found.dictionary)))
    pages = found.contents.select("url", F.lit(True).alias("_found")).distinct()
    progress = todo.join(pages, "url", "left").select(
        "url", "name", "page_type",
        F.when(F.col("_found"), F.lit("done")).otherwise(F.lit("failed")).alias("status"),
        F.current_timestamp().alias("updated_at"),
    )
    hashes = found.contents.select("url", "content_hash").join(research.addresses(todo), "url", "left_semi")
    return store.save(site, progress, batch, version, hashes)


def update(crawl: Crawl, store: Store, **options) -> None:
    """Research the stored sites whose English or Arabic page changed, is new, or was not hashed, again under their ids.

    The new batch replaces all rows of these sites in all five tables; other sites are not touched, and their pages are hashed
    but not parsed.  A page that the crawl no longer has changes nothing.
    """
    batch = f"update-{uuid.uuid4().hex}"
    while not _update_batch(crawl, store, batch, options):
        pass  # another run published since


def _update_batch(crawl: Crawl, store: Store, batch: str, options: dict) -> bool:
    version = store.version()
    pages = hashed(crawl.pages)
    changed = staged(changed_hashes(pages, store.page_hashes()).select("url").distinct())
    same = Window.partitionBy("url", "name")  # a listing row that is there more than once has as many ids
    keys = store._latest("site_keys", "id", batch)
    keys = keys.withColumn("_nth", F.row_number().over(same.orderBy(F.length("id"), "id"))).select("url", "name", "_nth", "id")
    twin = T.arabic_url(F.col("url"))
    stale = keys.select("id", F.explode(F.array("url", twin)).alias("url")).join(changed, "url", "left_semi").select("id").distinct()
    rows = crawl.listing.fillna("", ["name"]).withColumn("_nth", F.row_number().over(same.orderBy("pos")))
    todo = staged(rows.join(keys.join(stale, "id", "left_semi"), ["url", "name", "_nth"]).drop("_nth"))
    if todo.isEmpty():
        return True
    wanted = todo.select(F.explode(F.array("url", twin)).alias("url")).distinct()
    part = replace(crawl, listing=todo, pages=staged(crawl.pages.join(wanted, "url", "left_semi")))
    site = research.research_sites(part, **options)
    none = local_table(store.spark, [], S.PROCESSED).drop("batch")
    return store.save(site, none, batch, version, hashed(part.pages), replaces=True)
