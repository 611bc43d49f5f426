"""Scans: stored tables, lexicons, saved service answers, earlier output, progress."""

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteweave import lexicons as L
from siteweave import schemas as S
from siteweave.session import local_table


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def listing(spark: SparkSession, path: str, page_types: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Listing rows of the chosen page types; the filter prunes partitions or row groups."""
    rows = _read(spark, path, S.LISTING, fmt)
    return rows.filter(F.col("page_type").isin(page_types)) if page_types else rows


def pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, S.PAGE, fmt)


def articles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, S.ARTICLE, fmt)


def gazetteer(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Saved geocoder answers, one row per query and rank."""
    return _read(spark, path, S.GAZETTEER, fmt)


def geo_answers(saved: DataFrame, body: str = "body") -> DataFrame:
    """Decode saved geocoder bodies (a JSON array) into one row per query and rank."""
    answers = F.from_json(F.col(body), f"ARRAY<{S.GEO_ANSWER}>")
    return saved.select("query", F.posexplode(answers).alias("_pos", "_answer")).select(
        "query", (F.col("_pos") + 1).alias("rank"), "_answer.lat", "_answer.lon", "_answer.address"
    )


def search_hits(saved: DataFrame, body: str = "body") -> DataFrame:
    """Decode saved search bodies into one row per query and hit."""
    hits = F.coalesce(F.from_json(F.col(body), S.SEARCH_ANSWER)["query"]["search"], F.array())
    return saved.select("query", F.posexplode(hits).alias("_pos", "_hit")).select(
        "query",
        (F.col("_pos") + 1).alias("rank"),
        F.coalesce("_hit.title", F.lit("")).alias("title"),
        F.coalesce("_hit.snippet", F.lit("")).alias("snippet"),
    )


def or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The scan, or None if its path does not exist; any other fault is raised."""
    try:
        return read()
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return local_table(spark, [], schema)


def existing_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty site names of an earlier export; none if it is absent or malformed.

    ``path`` is an export folder (its ``sites`` table is read) or one small JSON document.
    """
    names = or_none(lambda: spark.read.schema("name STRING").json(path.rstrip("/") + "/sites"))
    if names is None:
        reader = spark.read.schema(S.EXISTING_OUTPUT).option("multiLine", True)
        document = or_none(lambda: reader.json(path))
        if document is None:
            return _empty(spark, "name STRING")
        names = document.select(F.explode("sites").alias("site")).select("site.name")
    return names.filter("name <> ''").distinct()


def processed(spark: SparkSession, path: str) -> DataFrame:
    """Progress rows; a fresh start if there are none, defaults for absent values."""
    rows = or_none(lambda: spark.read.schema(S.PROCESSED).parquet(path))
    if rows is None:
        return _empty(spark, S.PROCESSED)
    return rows.fillna({"url": "", "name": "", "page_type": "", "status": "done"})


def completed_types(spark: SparkSession, path: str) -> DataFrame:
    rows = or_none(lambda: spark.read.schema(S.COMPLETED_TYPE).parquet(path))
    if rows is None:
        return _empty(spark, S.COMPLETED_TYPE)
    return rows.groupBy("page_type").agg(F.max("updated_at").alias("updated_at"))


def checkpoint_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Texts of the checkpoint documents in a file or folder (one document each); none for an empty file or if the path does not exist."""
    rows = or_none(lambda: spark.read.text(path, wholetext=True))
    return _empty(spark, "body STRING") if rows is None else rows.withColumnRenamed("value", "body")


def checkpoint_documents(saved: DataFrame, body: str = "body") -> DataFrame:
    """Decode checkpoint documents: the other columns of ``saved``, the document's fields, and ``malformed``.

    Absent and null fields have their defaults.  A text that is no document gives the defaults alone, a fresh start; of a
    document with a field of another type the other fields are kept.  Both are marked as malformed.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rest"}
    decoded = F.from_json(F.coalesce(body, F.lit("")), f"{S.CHECKPOINT}, _rest STRING", options)
    none = F.array().cast("array<string>")
    lists = [F.coalesce(f"_d.{c}", none).alias(c) for c in ("processed_urls", "processed_names", "page_types_completed")]
    return saved.withColumn("_d", decoded).select(
        *[c for c in saved.columns if c != body], *lists,
        F.coalesce("_d.current_page_type", F.lit("")).alias("current_page_type"),
        F.coalesce("_d.total_processed", F.lit(0)).alias("total_processed"),
        F.coalesce("_d.last_updated", F.lit("")).alias("last_updated"),
        F.coalesce("_d.version", F.lit("1.0")).alias("version"),
        (F.col("_d").isNull() | F.col("_d._rest").isNotNull()).alias("malformed"),
    )


def _checkpoint_values(documents: DataFrame, values: str, name: str) -> DataFrame:
    """Distinct non-empty values of a list, with the latest time of a document that holds them."""
    rows = documents.select(F.explode(values).alias(name), F.try_to_timestamp("last_updated").alias("updated_at"))
    return rows.filter(F.col(name) != "").groupBy(name).agg(F.max("updated_at").alias("updated_at"))


def checkpoint_progress(documents: DataFrame) -> DataFrame:
    """Progress rows of decoded documents: one per address and one per name, as the two lists do not go in pairs."""
    blank, done = F.lit(""), F.lit("done").alias("status")
    none = F.lit(None).cast("string").alias("batch")
    urls = _checkpoint_values(documents, "processed_urls", "url")
    names = _checkpoint_values(documents, "processed_names", "name")
    return urls.select("url", blank.alias("name"), blank.alias("page_type"), done, none, "updated_at").unionByName(
        names.select(blank.alias("url"), "name", blank.alias("page_type"), done, none, "updated_at")
    ).to(StructType.fromDDL(S.PROCESSED))


def checkpoint_types(documents: DataFrame) -> DataFrame:
    """Finished page types of decoded documents."""
    return _checkpoint_values(documents, "page_types_completed", "page_type")


def append(rows: DataFrame, path: str) -> None:
    """Add progress rows; one write per batch, not one per site."""
    rows.write.mode("append").parquet(path)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content, unless there is one of that name; whether it was created.

    Of several that try at once exactly one succeeds: a mounted file system links a written file to its name, and others
    rename it, which on distributed file systems fails if the name is taken (on plain object stores it may not).
    """
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/_new-{uuid.uuid4().hex}"
    if "://" in path:
        paths = spark._jvm.org.apache.hadoop.fs.Path
        files = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
        out = files.create(paths(hidden), False)
        out.write(bytearray(text.encode()))
        out.close()
        won = not files.exists(paths(path)) and files.rename(paths(hidden), paths(path))
        if not won:
            files.delete(paths(hidden), False)
        return won
    folder = folder.removeprefix("file:")
    hidden = hidden.removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    with open(hidden, "x", encoding="utf-8") as f:
        f.write(text)
    try:
        os.link(hidden, f"{folder}/{name}")
        return True
    except FileExistsError:
        return False
    finally:
        os.remove(hidden)


def reset(spark: SparkSession, path: str, schema: str = S.PROCESSED, partition: str | None = None) -> None:
    """Clear progress by writing an empty table over it."""
    writer = _empty(spark, schema).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def lexicon(spark: SparkSession) -> DataFrame:
    """Every lexicon entry as a row: lexicon, pos, key, value."""
    tables = {
        "region_alias": list(L.REGION_ALIASES.items()),
        "known_place": L.KNOWN_PLACES,
        "pronunciation": list(L.PRONUNCIATION.items()),
        "era_rule": _rule_rows(L.ERA_RULES),
        "tourism_rule": _rule_rows(L.TOURISM_RULES),
        "place_rule": _rule_rows(L.PLACE_RULES),
        "era_rule_ext": _rule_rows(L.ERA_RULES_EXT),
        "place_rule_ext": _rule_rows(L.PLACE_RULES_EXT),
        "official_site": _rule_rows(L.OFFICIAL_SITE_RULES),
        "city_tip": list(L.CITY_TIPS_EXT.items()),
        **{f"term_{c}": [(w, c) for w in words] for c, words in L.TERM_CATEGORIES},
    }
    rows = [(name, pos, key, value) for name, entries in tables.items() for pos, (key, value) in enumerate(entries)]
    return local_table(spark, rows, "lexicon STRING, pos INT, key STRING, value STRING")


def _rule_rows(rules: list[tuple[list[str], str]]) -> list[tuple[str, str]]:
    return [(word, out) for words, out in rules for word in words]


def phrase_book(spark: SparkSession) -> DataFrame:
    """The declared phrases: place_type, pos, english, arabic, pronunciation."""
    rows = [
        (place, pos, *phrase) for place, phrases in L.PHRASE_BOOK_EXT.items() for pos, phrase in enumerate(phrases)
    ]
    return local_table(
        spark, rows, "place_type STRING, pos INT, english STRING, arabic STRING, pronunciation STRING"
    )


def dictionary(spark: SparkSession, article_pairs: DataFrame | None = None) -> DataFrame:
    """Translations by lower-cased term: the phrase book, then the title pairs of linked articles."""
    book = phrase_book(spark).select(F.lower("english").alias("term"), "arabic", F.lit(0).alias("_source"))
    if article_pairs is not None:
        pairs = article_pairs.select(
            F.lower(F.trim("english")).alias("term"), "arabic", F.lit(1).alias("_source")
        )
        book = book.unionByName(pairs)
    return book.groupBy("term").agg(F.min(F.struct("_source", "arabic"))["arabic"].alias("arabic"))
