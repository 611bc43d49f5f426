"""Title search: a stored inverted index with bounds, and its exact best hits.

The rank of a title for a query is: most shared words, then shorter title, then title.  The index has three tables.

* ``common``: the words with more than ``common_titles`` titles (at most ``COMMON_WORDS``, so it may be broadcast), with the
  number of their titles and of those that are long.
* ``blocks``: the postings of every word in blocks of about ``BLOCK`` titles, each with the greatest number of words of its
  titles, which bounds what any of them can share with a query.  Titles with more than ``combo_words`` common words ("long"
  ones) have blocks of their own.
* ``combos``: for every set of common words that some title which is not long holds, the first ``hits`` titles that hold it.

A query is answered in two steps.  First, its words that are not common lead to their blocks, of at most ``common_titles``
titles a word.  If that gives all the hits that are wanted, the last one shares some number of words, and the second step reads
only what can share as many: blocks by their bound, combos by their size.  It reads the blocks of long titles with a common
word of the query, and the combos of the query's common words.  The latter are enough: a title that is not long and shares
exactly the set S of common words with the query, but is not among the first titles of combo S, has as many titles before it as
are wanted, which all hold S.

Of a query with more than ``combo_words`` common words the most frequent ones are asked in sets; the others are treated as words
that are not common, through all of their blocks.

Number of (query, title) pairs looked at: at most ``common_titles`` for each word of a query that is not common, ``hits`` *
2**``combo_words`` for its combos, the long titles with its common words, and the titles of the words beyond ``combo_words``.
Neither all titles with a common word nor groups of them are paired with the queries that hold it.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave import lexicons as L
from siteweave.operators.joins import HOT_ROWS, lookup_join
from siteweave.session import staged

COMMON_TITLES = 200     # a word in more titles than this is common
COMMON_WORDS = 20_000   # most common words; bounds what is broadcast.  A word beyond them has less than 1/20,000 of all words
COMBO_WORDS = 6         # most common words of a title or query that are combined
BLOCK = 128             # titles of a block, about


@dataclass(frozen=True)
class TitleIndex:
    """The stored tables of an index and the settings that they were built with."""

    common: DataFrame
    blocks: DataFrame
    combos: DataFrame
    hits: int
    combo_words: int
    block: int


def words(c: Column) -> Column:
    """Distinct lower-cased words, sorted."""
    split = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(split, lambda w: w != "")))


def _subsets(array: Column) -> Column:
    """All non-empty sub-sequences of an array of words, joined by blanks (words hold none)."""
    nothing = F.array(F.lit(""))
    every = F.aggregate(array, nothing, lambda done, w: F.concat(done, F.transform(done, lambda s: F.ltrim(F.concat_ws(" ", s, w)))))
    return F.filter(every, lambda s: s != "")


def _blocks(titles: Column, block: int) -> Column:
    return F.ceil(titles / block)


def _first(rows: DataFrame, group: list[str], hits: int) -> DataFrame:
    """The first ``hits`` titles of each group; Spark applies the limit in each task before it shuffles."""
    order = Window.partitionBy(*group).orderBy(F.length("title"), "title")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= hits).drop("_n")


def build(
    titles: DataFrame, hits: int = L.SEARCH_HITS, common_titles: int = COMMON_TITLES, common_words: int = COMMON_WORDS,
    combo_words: int = COMBO_WORDS, block: int = BLOCK,
) -> TitleIndex:
    """Index the distinct values of the column ``title``."""
    rows = staged(titles.select("title").distinct().withColumn("title_words", words(F.col("title"))).filter(F.size("title_words") > 0))
    counts = rows.select(F.explode("title_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
    common = staged(counts.filter(F.col("titles") > common_titles).orderBy(F.desc("titles"), "word").limit(common_words))
    marked = rows.select("title", "title_words", F.explode("title_words").alias("word")).join(F.broadcast(common), "word", "left")
    holds = F.array_sort(F.collect_list(F.when(F.col("titles").isNotNull(), F.col("word"))))
    parted = staged(
        marked.groupBy("title", "title_words").agg(holds.alias("common_words")).withColumn("long", F.size("common_words") > combo_words)
    )
    long_titles = parted.filter("long").select(F.explode("common_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("long_titles"))
    common = staged(common.join(long_titles, "word", "left").fillna(0, ["long_titles"]))
    # blocks are dealt by a hash of the title, so no task sees all titles of a word
    posted = parted.select("title", "title_words", "long", F.explode("title_words").alias("word")).join(F.broadcast(common), "word", "left")
    many = F.when(F.col("long"), _blocks(F.col("long_titles"), block)).otherwise(_blocks(F.col("titles") - F.col("long_titles"), block))
    dealt = posted.withColumn("block", F.coalesce(F.pmod(F.xxhash64("title"), many), F.lit(0)).cast("int"))
    blocks = staged(
        dealt.groupBy("word", "long", "block").agg(
            F.max(F.size("title_words")).alias("bound"), F.collect_list(F.struct("title", "title_words")).alias("titles"))
    )
    short = parted.filter(~F.col("long") & (F.size("common_words") > 0))
    sets = short.select("title", "title_words", F.explode(_subsets(F.col("common_words"))).alias("combo"))
    combos = _first(sets, ["combo"], hits).groupBy("combo").agg(F.collect_list(F.struct("title", "title_words")).alias("titles"))
    return TitleIndex(common, blocks, staged(combos), hits, combo_words, block)


def _best(candidates: DataFrame, hits: int) -> DataFrame:
    """The first ``hits`` titles of each query; a title may come several times, with the same number of shared words."""
    order = Window.partitionBy("word_set").orderBy(F.desc("overlap"), F.length("title"), "title")
    ranked = candidates.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= hits)
    return ranked.groupBy("word_set", "rank", "title").agg(F.first("overlap").alias("overlap"))


def _met(asked: DataFrame, answers: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """(word_set, title, overlap) of the titles that the asked entries hold; what cannot reach ``least`` is not looked at."""
    found = lookup_join(asked, answers, keys, ["word_set"], min_rows).filter(F.col("bound") >= F.col("least"))
    return found.select("word_set", F.explode("titles").alias("t")).select(
        "word_set", "t.title", F.size(F.array_intersect("word_set", "t.title_words")).alias("overlap"))


def _asked(queries: DataFrame, index: TitleIndex) -> DataFrame:
    """Each distinct query's words: ``listed`` are not common, ``sets`` are asked in sets, ``beyond`` are too many for that."""
    words_of = queries.select("word_set").distinct().select("word_set", F.explode("word_set").alias("word"))
    marked = words_of.join(F.broadcast(index.common), "word", "left")
    gathered = marked.groupBy("word_set").agg(
        F.collect_list(F.when(F.col("titles").isNull(), F.col("word"))).alias("listed"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("titles").isNotNull(), F.struct("titles", "word", "long_titles"))))).alias("frequent"),
    )
    sets, beyond = F.slice("frequent", 1, index.combo_words), F.slice("frequent", index.combo_words + 1, 1_000_000)
    return gathered.select("word_set", "listed", sets.alias("sets"), beyond.alias("beyond")).withColumn("combined", F.array_sort("sets.word"))


def _listed(asked: DataFrame) -> DataFrame:
    """The entries that the first step reads: the only block, of either kind, of each word that is not common."""
    words_of = asked.select("word_set", F.explode("listed").alias("word"))
    return words_of.select("word_set", "word", F.explode(F.array(F.lit(False), F.lit(True))).alias("long"), F.lit(0).alias("block"), F.lit(1).alias("least"))


def _others(asked: DataFrame, index: TitleIndex) -> DataFrame:
    """The blocks that the second step reads: long titles with a common word, and all titles of the words beyond the sets."""
    def numbered(w: Column, is_long: bool, titles: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), _blocks(titles, index.block).cast("int")), lambda n: n < _blocks(titles, index.block))
        return F.transform(numbers, lambda n: F.struct(w["word"].alias("word"), F.lit(is_long).alias("long"), n.alias("block")))

    long_ones = F.flatten(F.transform(F.concat("sets", "beyond"), lambda w: numbered(w, True, w["long_titles"])))
    rest = F.flatten(F.transform("beyond", lambda w: numbered(w, False, w["titles"] - w["long_titles"])))
    return asked.select("word_set", "least", F.explode(F.concat(long_ones, rest)).alias("e")).select("word_set", "least", "e.*")


def _sets(asked: DataFrame) -> DataFrame:
    """The combos that the second step reads, with their size as bound."""
    combos = asked.select("word_set", "least", F.explode(_subsets(F.col("combined"))).alias("combo"))
    return combos.filter(F.size(F.split("combo", " ")) >= F.col("least"))


def candidates(queries: DataFrame, index: TitleIndex, min_rows: int = HOT_ROWS) -> DataFrame:
    """(word_set, title, overlap) that hold the best hits of each query."""
    asked = staged(_asked(queries, index))
    place = ["word", "long", "block"]
    first = staged(_best(_met(_listed(asked), index.blocks, place, min_rows), index.hits))
    reached = first.filter(F.col("rank") == index.hits).select("word_set", F.col("overlap").alias("least"))
    bounded = asked.join(reached, "word_set", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    others = _met(_others(bounded, index), index.blocks, place, min_rows)
    sets = _met(_sets(bounded), index.combos.withColumn("bound", F.size(F.split("combo", " "))), ["combo"], min_rows)
    return first.select("word_set", "title", "overlap").unionByName(others).unionByName(sets)


def ranked_hits(queries: DataFrame, index: TitleIndex, min_rows: int = HOT_ROWS) -> DataFrame:
    """word_set to its best titles: rank, title, overlap.  ``queries`` has a column ``word_set`` (see ``words``)."""
    found = _best(candidates(queries, index, min_rows), index.hits)
    return found.select("word_set", "rank", "title", "overlap")
