"""Listing rows as a stream: what arrives is researched once."""

import hashlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteweave import schemas as S
from siteweave.plans import incremental
from siteweave.plans.incremental import Store
from siteweave.plans.research import Crawl
from siteweave.session import local_table, staged
from siteweave.sources import tables


def listing_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(S.LISTING).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, the one that is first in page order (combined before the shuffle)."""
    whole = F.struct(*rows.columns)
    order = F.struct("pos", "url")
    return rows.groupBy(key).agg(F.min_by(whole, order).alias("r")).select("r.*")


def batch_id(spark: SparkSession, checkpoint: str, number: int) -> str:
    """An id that a replayed batch has again and no batch of another query ever has."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha1(checkpoint.encode()).hexdigest()
    return f"{query}-{number}"


def research_stream(listing: DataFrame, crawl: Crawl, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """Research every listing row of the stream that no earlier batch has seen, then stop.

    Known rows are found by anti-joins with the stored progress, by address and by name, so no state
    grows inside the stream.  Batches write to folders of their own id, so a replay changes nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = staged(first_of_each(batch, "url"))
        name = batch_id(store.spark, checkpoint, number)
        incremental.run(replace(crawl, listing=rows), store, mark_completed=False, run_id=name, **options)

    return (
        listing.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def new_listing_rows(listing: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows with an unseen address and name to ``path``; no research.

    Each batch is compared with what the batches before it wrote.
    """
    spark = listing.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        name = batch_id(spark, checkpoint, number)
        seen = tables.or_none(lambda: spark.read.schema(f"{S.LISTING}, batch STRING").parquet(path))
        seen = local_table(spark, [], S.LISTING) if seen is None else seen.filter(F.col("batch") != name)
        rows = incremental.pending_sites(first_of_each(batch, "url"), seen)
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={name}")

    return (
        listing.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


FILTER_BITS = 1 << 24   # positions of the membership filter: at most 2 MB of bitmaps, whatever the stream


def _position(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1


def membership(rows: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a bitmap per 32,768 positions, set where some key's hash falls."""
    at = _position(key)
    return rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def with_membership(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: whether the filter holds the key's position.  False is certain, true is not."""
    at = _position(key)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", F.lit(1) + F.floor(bit / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(known, "bucket", "left")
    return joined.withColumn("_maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bits")


def distinct_addresses(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose address has not been written to ``path``, each once.

    No state grows in the stream.  What has been written is the memory, and a filter of bounded size (``FILTER_BITS``) stands
    before it: an address that the filter does not hold is new without looking, and only the others are compared with the
    written addresses, exactly.  The filter of batch n is made from that of batch n - 1 and kept in one of two folders by turns,
    so a replayed batch finds what it found before.  A query's first batch makes it from what the folder holds.
    """
    spark = rows.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        name = batch_id(spark, checkpoint, number)
        others = [c for c in batch.columns if c != "url"]
        fresh = batch.groupBy("url").agg(F.min(F.struct(*others)).alias("r")).select("url", "r.*").select(*batch.columns)
        written = tables.or_none(lambda: spark.read.schema("url STRING, batch STRING").parquet(path))
        written = local_table(spark, [], "url STRING, batch STRING") if written is None else written.filter(F.col("batch") != name)
        slots = f"{checkpoint.rstrip('/')}-filter"
        known = tables.or_none(lambda: spark.read.schema("bucket LONG, bits BINARY").parquet(f"{slots}/{(number - 1) % 2}")) if number else None
        known = staged(membership(written, "url")) if known is None else known
        marked = staged(with_membership(fresh, "url", known))
        maybe = marked.filter("_maybe").join(written.select("url"), marked["url"].eqNullSafe(written["url"]), "left_anti")
        new = staged(marked.filter("not _maybe").unionByName(maybe).drop("_maybe"))
        new.write.mode("overwrite").parquet(f"{path}/batch={name}")
        both = known.unionByName(membership(new, "url")).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        staged(both).write.mode("overwrite").parquet(f"{slots}/{number % 2}")

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
