"""Bilingual glossary of a site."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.functions import extract as X
from siteweave.functions import text as T
from siteweave.operators.joins import lookup_join


def translate(terms: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """Add ``arabic`` to distinct terms; an empty string on a miss."""
    keyed = terms.withColumn("_key", F.lower(F.trim(term)))
    return (
        keyed.join(dictionary.select(F.col("term").alias("_key"), "arabic"), "_key", "left")
        .drop("_key").fillna("", ["arabic"])
    )


def translate_terms(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """A caller's term list as (english, arabic, pronunciation); repeated terms are looked up once."""
    known = translate(terms.select("english").distinct(), dictionary, "english")
    answers = known.withColumn("pronunciation", T.pronounce(F.col("english")))
    return lookup_join(terms, answers, ["english"], terms.columns)


def lexicon_translations(dictionary: DataFrame, categories: list[tuple[str, list[str]]] = L.TERM_CATEGORIES) -> Column:
    """The dictionary entries of the lexicon's own terms, as one map value.

    Terms come from the lexicon, so the map has at most one entry per lexicon word, however large the
    dictionary is.
    """
    known = sorted({w.lower() for _, ws in categories for w in ws})
    entries = dictionary.filter(F.col("term").isin(known)).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "arabic"))).alias("m")
    )
    return entries.scalar()


def glossary(text: Column, name: Column, name_arabic: Column, translations: Column, max_terms: int = L.MAX_TERMS) -> Column:
    """Glossary as array<struct<english, arabic, pronunciation, context>>.

    ``translations`` is a map column (see :func:`lexicon_translations`).

    Terms keep category priority; the site's own name comes first if there is room, it has a translation
    and that is not among the terms'.
    """
    own = F.struct(
        name.alias("english"),
        name_arabic.alias("arabic"),
        T.pronounce(name).alias("pronunciation"),
        F.lit("site_name").alias("context"),
    )

    def with_own_name(entries: Column) -> Column:
        room = (F.size(entries) < max_terms) & (F.coalesce(name, F.lit("")) != "")
        new = (name_arabic != "") & ~F.exists(entries, lambda e: e["arabic"] == name_arabic)
        return F.when(room & new, F.concat(F.array(own), entries)).otherwise(entries)

    return T.let(F.transform(F.slice(X.terms(text), 1, max_terms), _entry_of(translations)), with_own_name)


def _entry_of(translations: Column):
    def entry(t: Column) -> Column:
        word = t["term"]
        return F.struct(
            F.when(F.length(word) > 3, T.title_case(word)).otherwise(word).alias("english"),
            F.coalesce(F.try_element_at(translations, F.lower(word)), F.lit("")).alias("arabic"),
            T.pronounce(word).alias("pronunciation"),
            t["category"].alias("context"),
        )

    return entry


def name_translations(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct names with their translation (``name_arabic``)."""
    return translate(names.select("name").distinct(), dictionary, "name").withColumnRenamed("arabic", "name_arabic")
