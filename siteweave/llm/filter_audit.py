"""Filter interaction audit: what every filter does in every order of the filters, by counting paths in the subset lattice.

A document's failures are a bit mask, so per part of the corpus only the counts of at most 2**k masks matter, whatever the
corpus.  The states of the lattice are the sets of filters already applied; an edge applies one more filter.  ``lattice``
counts forward the orders that reach a state and backward those that leave it.  Each edge's removals are read once from
the mask counts; weighted with (orders reaching its start) * (orders leaving its end) and summed by filter they give the
removals over all orders, and divided by k! the Shapley value.  The steps of a single order are k of the same edges.

The five filters of ``FAILURES`` look at the text; ``repeated`` looks for the same text (SHA-256) with a smaller id in the
whole table.  No group of equal texts ever meets in one task: rows are narrow, are counted first by (id, text, part, mask),
and are then joined on (first id, text).

Defined cases: null texts are empty, a null part is the empty string.  Equal ids are not smaller than each other.  A null
id is larger than all others (and no null id than another), and has no labels.  A document with several labels is good
or toxic if one of them says so; null labels say nothing.  An empty table has no parts, so no rows.  Very long texts are
counted whole.  Other columns are not looked at.
"""

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions.text import let
from siteweave.session import local_table, staged

WORD = r"[^\x20\x09-\x0D]+"
MASK = "mask"


@dataclass(frozen=True)
class Edge:
    """Applying ``filter`` (a bit number) after the filters in ``state`` (a mask); ``paths`` orders take it."""

    state: int
    filter: int
    paths: int


def lattice(k: int) -> list[Edge]:
    """All edges of the lattice of ``k`` filters with the number of orders through each."""
    full = (1 << k) - 1
    reaching, leaving = {0: 1}, {full: 1}
    for state in range(full + 1):  # a state is larger than all states below it
        for f in range(k):
            if not state >> f & 1:
                reaching[state | 1 << f] = reaching.get(state | 1 << f, 0) + reaching[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if state >> f & 1:
                leaving[state ^ 1 << f] = leaving.get(state ^ 1 << f, 0) + leaving[state]
    assert reaching[full] == leaving[0] == factorial(k)
    return [Edge(s, f, reaching[s] * leaving[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def edges(counts: DataFrame, k: int) -> DataFrame:
    """Per part and edge: what the filter does there, and ``shapley``, its removals over all orders.

    ``counts`` has (part, mask, n, good, toxic), at most 2**k rows a part.
    """
    masks = counts.groupBy("part").agg(F.collect_list(F.struct(MASK, "n", "good", "toxic")).alias("masks"))
    listed = F.array(*[F.struct(F.lit(e.state).alias("state"), F.lit(e.filter).alias("filter"), F.lit(e.paths).cast("long").alias("paths")) for e in lattice(k)])
    rows = masks.select("part", "masks", F.explode(listed).alias("e")).select("part", "masks", "e.*")
    bit = F.expr("shiftleft(1, filter)")

    def before(m: Column) -> Column:
        return m[MASK].bitwiseAND(F.col("state")) != 0

    def fails(m: Column) -> Column:
        return m[MASK].bitwiseAND(bit) != 0

    def total(value: str, which) -> Column:
        return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda acc, m: acc + m[value])

    found = rows.select(
        "part", "state", "filter", "paths",
        total("n", lambda m: ~before(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: ~before(m) & fails(m)).alias("removed"),
        total("n", lambda m: before(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m[MASK] == bit).alias("unique_fails"),
        total("good", lambda m: ~before(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: ~before(m) & fails(m)).alias("toxic_lost"),
    )
    # one window group has the 2**(k-1) edges of one filter in one part
    return found.withColumn("shapley", F.sum(F.col("paths") * F.col("removed")).over(Window.partitionBy("part", "filter")))


def steps(found: DataFrame, names: str) -> DataFrame:
    """Per part, order of the filters (a string of their one-letter names) and step: the edge that the order takes there."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    table = local_table(found.sparkSession, rows, "filter_order string, step int, state int, filter int")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.join(table, ["state", "filter"]).select("part", "filter_order", "step", *columns)


def failures(text: Column) -> Column:
    """Bits 0 to 3 of a document's mask: few words, few distinct words, many capitals, marks."""
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    few = let(words, lambda w: F.when(w["n"] < 200, 1).otherwise(0) + F.when(100 * w["d"] < 50 * w["n"], 2).otherwise(0))
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
    marks = F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return (few + capitals + marks).cast("int")


NAMES = "ABCDE"
REPEATED = 16  # the bit of the filter on texts that a smaller id has too


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and how many are labelled good or toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        failures(text).alias(MASK), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = staged(rows.groupBy("doc_id", "digest", "part", MASK).agg(F.count(F.lit(1)).alias("n")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumnRenamed("digest", "of").withColumn("is_first", F.lit(True))
    marked = rows.join(firsts, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    repeated = F.when(F.col("is_first"), 0).otherwise(REPEATED)
    by_id = marked.select("doc_id", "part", F.col(MASK).bitwiseOR(repeated).alias(MASK), "n").groupBy("doc_id", "part", MASK).agg(F.sum("n").alias("n"))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    labelled = by_id.join(said, "doc_id", "left")
    return labelled.groupBy("part", MASK).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return steps(edges(mask_counts(docs, labels), len(NAMES)), NAMES)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (
  SELECT doc_id, part,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM w
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step) g),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
