"""The seasoned corpus: crawl tables that Spark derives from the given ones.

The given texts are invented syllables without a word of the domain, so every document is joined to one of
the seed rows (``doc_id % 24``) that carry the domain phrases.  Listing, pages, articles and geocoder
answers all have one row (or a few) per document and keep its whole text, so their size and the work on
them grow with ``documents``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import text as T
from siteweave.session import local_table

SITE_URL = "https://sites.example/en/"
AR_TITLE = "أثر"

# k, name, hint, phrase, article title ('#' becomes the doc_id; None: no article), Arabic name (None: no
# Arabic page), has a detail page, geocoder query (0 none, 1 with hint, 2 name only), state, province
SEEDS = [
    (0, "Karnak Temple", "Luxor", "The Temple of Amun was built in the New Kingdom by Ramesses II. It is the largest religious complex and covers about 200 acres. Its hypostyle hall and sacred lake are famous far away.", "Karnak Temple #", "معبد الكرنك", 1, 1, "Luxor Governorate", None),
    (1, "Giza Plateau", "Giza", "The Great Pyramid of Khufu dates back to the Old Kingdom. It is the oldest of the seven wonders, and many meters were lost from its first 146.", "Giza-Plateau-#", "هضبة الجيزة", 1, 1, "Giza", None),
    (2, "Valley of the Kings", "luxor", "The Tomb of Seti I! The Tomb of Ramesses II, discovered in this place. Rulers of the 18th dynasty rest here with Osiris and Anubis.", "Valley of the Kings #, luxor", "وادي الملوك", 1, 2, "Luxor", None),
    (3, "Kom el-Dikka", "Alexandria", "A Roman amphitheatre with a mosaic floor, uncovered by workers. It is the only one of its kind in the country.", "Kom El-Deka #", None, 1, 1, "unknown", "Alexandria Governorate"),
    (4, "Saint Catherine Monastery", "", "A coptic monastery and church founded about 530 AD. It is a UNESCO World Heritage site in the hills.", "Monastery # of Saint Catherine", "دير سانت كاترين", 1, 2, "South Sinai محافظة", None),
    (5, "Al-Azhar Mosque", "Cairo", "A fatimid mosque with a minaret and a mihrab. EGP 50 is asked at the gate.", "Al Azhar Mosque #", "جامع الأزهر", 1, 0, None, None),
    (6, "Abu Simbel", "aswan", "Ptolemaic visitors left marks[1] on the colossus[2] of Ramses. Hathor, Ra and Amun-Ra are shown.", "Temple of Abu Simbel #", "أبو سمبل", 1, 1, "Aswan Governorate", None),
    (7, "Qaitbay Citadel", "Alexandria", "A mamluk fortress constructed in 1477 AD where the lighthouse stood.", "Citadel # of Qaitbay", None, 1, 2, "Nowhere", None),
    (8, "Egyptian Museum", "Cairo", "The museum keeps a sarcophagus, a cartouche and a mummy room.", "Egyptian Museum # (Cairo)", "المتحف المصري", 1, 1, None, "Cairo"),
    (9, "Grand Egyptian Museum", "Giza", "A new museum near the plateau. Tickets cost 450 EGP for adults.", None, None, 1, 0, None, None),
    (10, "Beni Hasan", "al-minya", "Rock-cut graves of the middle kingdom, with a burial chamber and a false door. A cemetery of nobles from 2000 B.C. onwards.", "Beni Hasan # Temple", None, 1, 2, "al-Minya Governorate", None),
    (11, "Dendera", "Qena", "Dedicated to Hathor. The ptolemaic naos was carved for Cleopatra and her priest.", "Dendera light #", None, 1, 1, "Qena", None),
    (12, "Avenue of the Sphinx", "Luxor", "A long causeway lined with statues of the Late Period leads to the pylon.", None, None, 1, 0, None, None),
    (13, "Unknown Mound", "", "Nothing certain is known about this place.", None, None, 0, 0, None, None),
    (14, "Coptic Cairo", "Cairo", "Several churches and a basilica stand inside the walls of the old town.", "Coptic Cairo #", "القاهرة القبطية", 1, 1, "Cairo Governorate", None),
    (15, "Desert Shrine", "desert", "A small shrine to Set and Neith, rare and well preserved in the sand.", None, None, 1, 1, None, "New Valley"),
    (16, "Fayoum Pyramid", "lakeside", "A mud-brick pyramid with a mortuary temple and a valley temple, excavated long ago.", "Pyramid # of Fayoum", None, 1, 2, "Fayoum Governorate", None),
    (17, "Gem Hall", "", "A madrasa hall with a dome. Copyright notices hang on each wall of it.", None, None, 1, 2, "Sharkia", None),
    (18, "Deir-el-Bahari", "west bank", "Queen Hatshepsut ordered the colonnade during the new kingdom. The queen was a pharaoh and a king.", "Deir el Bahari #", "الدير البحري", 1, 0, None, None),
    (19, "The Sunken City", "matrouh", "A romance tells of a drowned greek town; 120 Egyptian pounds buy a boat ride.", "Sunken City #", None, 1, 1, "Matruh", None),
    (20, "Saqqara", "Giza", "Djoser and his vizier built the first great stone monument, the earliest of all.", "Saqqara # Pyramid", "سقارة", 1, 1, "Giza Governorate", None),
    (21, "Library of Alexandria", "old port", "A library and planetarium, renowned for its reading room and its shelves.", "Library of Alexandria #", None, 1, 0, None, None),
    (22, "Old Theater", "Port Said", "A greek theater and citadel district. Read more on the board next to the gate.", "Theater of Port Said", None, 1, 2, "Port Said", None),
    (23, "Kafr Harbour", "kafr el-sheikh", "Quays dating to 19th dynasty trade, with the Great Sphinx and Hypostyle Hall in relief.", None, None, 0, 0, None, None),
]
SEED_SCHEMA = (
    "k LONG, seed_name STRING, hint STRING, phrase STRING, article_title STRING, arabic_name STRING, "
    "has_page INT, geo INT, state STRING, province STRING"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its seed row."""
    return seeded_of(spark, table(spark, sf_dir, "documents"))


def seeded_of(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The same for any documents, also a stream (24 seed rows: Catalyst knows their size and broadcasts them)."""
    seeds = local_table(spark, SEEDS, SEED_SCHEMA)
    docs = documents.select("doc_id", "text", F.pmod("doc_id", F.lit(24)).alias("k"))
    return docs.join(seeds, "k").withColumn("unique_name", F.concat_ws(" ", "seed_name", "doc_id"))


def _page_type(doc_id: Column | None = None) -> Column:
    key = F.col("doc_id") if doc_id is None else doc_id
    slot = F.pmod(F.floor(key / 24), F.lit(4))
    return F.element_at(F.array(*[F.lit(t) for t in L.PAGE_TYPES]), (slot + 1).cast("int"))


def address_of(doc_id: Column) -> Column:
    """Address of a document's page."""
    return F.concat(F.lit(SITE_URL), _page_type(doc_id), F.lit("/"), doc_id)


def _url() -> Column:
    return address_of(F.col("doc_id"))


def _image() -> Column:
    return F.concat(F.lit("https://img.example/"), F.col("doc_id"), F.lit(".jpg"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described sites: names repeat (24 of them), texts do not."""
    full = F.concat_ws(" ", "phrase", "text")
    return seeded(spark, sf_dir).select(
        F.col("doc_id").alias("site_key"),
        _page_type().alias("page_type"),
        F.col("doc_id").alias("pos"),
        F.col("seed_name").alias("name"),
        "unique_name",
        F.col("hint").alias("location"),
        _url().alias("url"),
        full.alias("full_description"),
        full.alias("description"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows with unique names."""
    return listing_of(seeded(spark, sf_dir))


def listing_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        _url().alias("url"),
        F.col("unique_name").alias("name"),
        F.col("hint").alias("location"),
        F.concat_ws(" ", "phrase", "text").alias("description"),
        _image().alias("image"),
        _page_type().alias("page_type"),
        F.col("doc_id").alias("pos"),
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of three anchors: a full card, a card without address, and a menu link."""
    html = F.concat(
        F.lit('<html><body><a class="menu" href="/en/home">Home</a><a class="listItem box" href="'),
        _url(),
        F.lit('" title="'),
        F.col("unique_name"),
        F.lit('"><div class="location"><i></i><p> '),
        F.col("hint"),
        F.lit(' </p></div><div class="details"><p>'),
        F.concat_ws(" ", "phrase", "text"),
        F.lit('</p></div><img src="'),
        _image(),
        F.lit('"></a><a class="listItem" title="No address"><div class="details"><p>None</p></div></a></body></html>'),
    )
    return seeded(spark, sf_dir).select(_page_type().alias("page_type"), F.col("doc_id").alias("page_id"), html.alias("html"))


def _detail_html(heading: Column) -> Column:
    lines = F.replace(F.col("text"), F.lit("\n"), F.lit("</p><p>"))
    return F.concat(
        F.lit("<html><head><script>var t='<p>';</script></head><body><h1> "),
        heading,
        F.lit(' </h1><article><img src="https://img.example/logo.png"><img src="'),
        F.concat(F.lit("https://img.example/g/"), F.col("doc_id"), F.lit(".jpg")),
        F.lit('"><p>'),
        F.col("phrase"),
        F.lit("</p><p>"),
        lines,
        F.lit("</p></article><p>All rights reserved by the people who developed it.</p></body></html>"),
    )


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English and Arabic detail pages, one row per address."""
    rows = seeded(spark, sf_dir)
    english = rows.filter("has_page = 1").select(_url().alias("url"), _detail_html(F.col("unique_name")).alias("html"))
    arabic = rows.filter("arabic_name is not null").select(
        T.arabic_url(_url()).alias("url"), _detail_html(F.col("arabic_name")).alias("html")
    )
    return english.unionByName(arabic)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English articles under a spelling of their own, and Arabic twins for some of them."""
    rows = seeded(spark, sf_dir).filter("article_title is not null")
    title = F.concat_ws(
        " ", F.replace("article_title", F.lit("#"), F.col("doc_id").cast("string")),
        F.when(~F.contains("article_title", F.lit("#")), F.col("doc_id").cast("string")),
    )
    arabic_title = F.concat_ws(" ", F.lit(AR_TITLE), "doc_id")
    english = rows.select(
        F.lit("en").alias("lang"),
        title.alias("title"),
        F.col("phrase").alias("summary"),
        F.concat_ws(" ", "phrase", "text").alias("text"),
        F.concat(F.lit("https://en.wiki.example/"), F.replace(title, F.lit(" "), F.lit("_"))).alias("url"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.create_map(F.lit("ar"), arabic_title)).alias("langlinks"),
    )
    arabic = rows.filter("arabic_name is not null").select(
        F.lit("ar").alias("lang"),
        arabic_title.alias("title"),
        F.concat_ws("[1] ", "arabic_name", "text").alias("summary"),
        F.col("arabic_name").alias("text"),
        F.concat(F.lit("https://ar.wiki.example/"), "doc_id").alias("url"),
        F.lit(None).cast("map<string,string>").alias("langlinks"),
    )
    return english.unionByName(arabic)


def _lat_text() -> Column:
    return F.concat_ws(".", F.pmod("doc_id", F.lit(11)) + 21, F.lpad((F.col("doc_id") * 37 % 10000).cast("string"), 4, "0"))


def _lon_text() -> Column:
    number = F.concat_ws(".", F.pmod("doc_id", F.lit(13)) + 24, F.lpad((F.col("doc_id") * 91 % 10000).cast("string"), 4, "0"))
    return F.when(F.col("k") == 8, F.lit("east")).otherwise(number)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved geocoder answers, at most one (rank 1) per query string."""
    rows = seeded(spark, sf_dir)
    query = F.when(
        (F.col("geo") == 1) & (F.col("hint") != ""), F.concat_ws(", ", "unique_name", "hint", F.lit(L.COUNTRY))
    ).otherwise(F.concat_ws(", ", "unique_name", F.lit(L.COUNTRY)))
    address = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("state").alias("key"), F.col("state").alias("value")),
                F.struct(F.lit("province").alias("key"), F.col("province").alias("value")),
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    return rows.filter("geo > 0").select(
        query.alias("query"), F.lit(1).alias("rank"), _lat_text().alias("lat"), _lon_text().alias("lon"),
        address.alias("address"),
    )


def site_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with coordinates of their own."""
    return seeded(spark, sf_dir).select(
        F.col("doc_id").alias("site_key"),
        _lat_text().try_cast("double").alias("lat"),
        _lon_text().try_cast("double").alias("lon"),
    )


def reverse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved reverse-geocoder answers: those for the coordinates of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    fields = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in ("state", "province")])
    address = F.map_from_entries(F.filter(fields, lambda e: e["value"].isNotNull()))
    return seeded(spark, sf_dir).join(labels, "doc_id", "left_semi").select(
        _lat_text().try_cast("double").alias("lat"), _lon_text().try_cast("double").alias("lon"), address.alias("address")
    )


def gazetteer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known places with coordinates, one per customer."""
    regions = F.array(*[F.lit(r) for r in L.REGION_NAMES])
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat_ws(" ", F.lit("Place"), key).alias("place"),
        (F.lit(21) + (key * 17 % 1100) / 100.0).alias("lat"),
        (F.lit(24) + (key * 29 % 1300) / 100.0).alias("lon"),
        F.element_at(regions, (F.col("c_nationkey") + 1).cast("int")).alias("region"),
    )


def _told_hours(doc_id: Column, line: Column, number: Column) -> Column:
    """A line of the text with a notice before it, after it, or without one; all by the line's length, number and document."""
    size = F.length(line)
    day = F.element_at(F.array(*[F.lit(d) for d in L.WEEKDAYS]), (F.pmod(size + number, F.lit(7)) + 1).cast("int"))
    hour, minute = F.pmod(size, F.lit(12)) + 1, F.lpad(F.pmod(size * 7, F.lit(60)).cast("string"), 2, "0")
    notice = F.element_at(
        F.array(
            F.concat(day, F.lit(": "), hour, F.lit(":"), minute, F.lit(" AM - "), F.pmod(size, F.lit(7)) + 1, F.lit(" PM")),
            F.concat(day, F.lit(" closed")),
            F.concat(F.lower(day), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute, F.lit("–"), hour + 9, F.lit(":30")),
            F.concat(day, F.lit(" "), hour, F.lit(" am to "), F.pmod(size, F.lit(5)) + 3, F.lit(" PM")),
            F.concat(F.lit("Open daily from "), hour),
        ),
        (F.pmod(size, F.lit(5)) + 1).cast("int"),
    )
    place = F.pmod(doc_id + number, F.lit(3))
    return F.when(place == 0, F.concat_ws(" ", notice, line)).when(place == 1, F.concat_ws(" ", line, notice)).otherwise(line)


def _placed(doc_id: Column, text: Column, notice: Column) -> Column:
    """The whole text with a notice before it, after it or behind its first line, or without one."""
    place = F.pmod(doc_id, F.lit(4))
    behind = F.regexp_replace(text, r"^([^\n]*)", F.concat(F.lit("$1 "), notice))
    return (
        F.when(place == 0, F.concat_ws(" ", notice, text)).when(place == 1, F.concat_ws(" ", text, notice))
        .when(place == 2, behind).otherwise(text)
    )


def map_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured map-page texts, one per document: its whole text with notices whose values and places vary with it.

    The address is that of the page with the same number, if there is one, with coordinates from the sizes of the page.
    """
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    size = F.length(text)
    hours = F.array_join(F.transform(F.split(text, "\n"), lambda line, i: _told_hours(key, line, i)), "\n")
    rating = F.concat(F.pmod(F.floor(size / 10), F.lit(7)), F.lit("."), F.pmod(size, F.lit(10)), F.lit(" stars"))
    count = F.format_number(size * (F.pmod(key, F.lit(5)) + 1), 0)
    reviews = (
        F.when(F.pmod(size, F.lit(3)) == 0, F.concat(F.lit("("), count, F.lit(") Reviews")))
        .when(F.pmod(size, F.lit(3)) == 1, F.concat(count, F.lit(" reviews"))).otherwise(F.concat(count, F.lit("REVIEW")))
    )
    captured = table(spark, sf_dir, "documents").select(
        "doc_id", hours.alias("hours_text"), _placed(key, text, rating).alias("rating_text"),
        _placed(key + 1, text, reviews).alias("review_text"),
    )
    markup = F.length("html")
    point = F.concat(
        F.lit("/@"), F.pmod(markup, F.lit(32)), F.lit("."), markup, F.lit(",-"), F.pmod(markup, F.lit(60)), F.lit("."), F.length("url"), F.lit(",15z")
    )
    address = (
        F.when(F.pmod(markup, F.lit(10)) == 0, F.col("url")).when(F.pmod(markup, F.lit(2)) == 0, F.concat("url", point))
        .otherwise(F.regexp_replace("url", "^(https?://[^/]*)", F.concat(F.lit("$1"), point)))
    )
    addresses = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), address.alias("map_url"))
    return captured.join(addresses, "doc_id", "left")
