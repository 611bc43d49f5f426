"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words.  Document rates start at 1 (once each) and are tilted exponentially,
``rate = min(most, exp(lambda * x))``, where x is the document's size as a share of its source's largest: among all rates
up to ``most`` that reach the targets these are the ones nearest to 1 in relative entropy.  The multipliers solve the convex
dual.  Its Newton steps are Spark aggregations over (source, size) counts, which hold every document but are far smaller
than the table; a bracket keeps each step inside the interval that must hold the root.

Rates become copies in blocks of about ``BLOCK_ROWS`` documents of one source, so a hot source is spread over tasks.  Within
a block, documents go from large to small and each takes the floor or the ceiling of its rate, whichever keeps the
words taken nearer to the sum of rates times sizes.  What is left over then moves single documents by one copy, from
large to small again, wherever that comes nearer to the sum.

Defined cases: null, empty and blank texts have size 0 and take nothing; a null source is a source of its own, last in
order; a source of size 0 has target 0; repeated rows and null ids are documents of their own; ties in size go by
hash and id, so reruns agree; an empty table gives an empty mix; other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.rows import answer_join, keyed, numbered
from siteweave.llm.words import Words, slices
from siteweave.session import staged

WEIGHTS = (5, 2, 1)     # of the sources in order, repeating
SHARE = 1.5             # words of the mix, as a multiple of all words
MOST = 2                # most copies of a document; so a source gives at most this multiple of its size
BLOCK_ROWS = 2_000
NEWTON_STEPS = 60
NEAR = 1e-9             # relative distance from the target at which a multiplier is settled


def word_counts(docs: DataFrame, source: str = "source") -> DataFrame:
    """(_row, doc_id, source, size) of every document; size is its number of words."""
    rows = docs.select("_row", "doc_id", F.col(source).cast("string").alias("source"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), batch.column("source"), pa.array(Words(texts).count.astype(np.int64))],
                ["_row", "doc_id", "source", "size"],
            )

    return rows.mapInArrow(run, "_row long, doc_id long, source string, size long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Sources (source, source_size, ...) with their ``target``.

    The whole is divided by weight; sources above ``most`` times their size stop there and the rest is divided anew
    among the others, until none is above.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = staged(numbered(sources, [F.col("source").asc_nulls_last()], "_rank").withColumn("_weight", cycle[F.pmod("_rank", F.lit(len(weights))).cast("int")]))
    whole = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    limit = F.col("source_size") * most
    unit = 0.0  # words per unit of weight; grows from round to round, so whoever stopped has stopped for good
    while True:
        stops = F.col("_weight") * unit > limit
        sums = ranked.agg(
            F.sum(F.when(stops, limit)).alias("stopped"), F.sum(F.when(~stops, F.col("_weight"))).alias("open"), F.count(F.when(stops, 1)).alias("n")
        ).first()
        new = (whole - float(sums["stopped"] or 0)) / sums["open"] if sums["open"] else unit
        if new <= unit * (1 + 1e-12):
            break
        unit = new
    return ranked.withColumn("target", F.least(F.col("_weight") * unit, limit.cast("double"))).drop("_weight")


def multipliers(counts: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with the multiplier ``lam`` of each, by Newton's method on the dual of all sources at once.

    ``counts`` has the number ``n`` of documents by (_rank, size).  Each step is one aggregation of the words that the
    present rates reach and of their slope.  A step that would leave the bracket (or has no slope) halves it instead;
    a side that has not been met yet moves outward.  A source whose target is its limit has a null multiplier: every
    rate is ``most``.
    """
    full = (F.col("target") >= F.col("source_size") * most) & (F.col("source_size") > 0)
    known = staged(counts.filter("size > 0").join(sources.select("_rank", "largest"), "_rank").withColumn("x", F.col("size") / F.col("largest")))
    nothing = F.lit(None).cast("double")
    state = sources.select("_rank", "target", F.lit(0.0).alias("lam"), nothing.alias("low"), nothing.alias("high"), full.alias("done"))
    rate = F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("x")))
    words, gap, lam = F.col("n") * F.col("size"), F.col("reached") - F.col("target"), F.col("lam")
    for _ in range(NEWTON_STEPS):
        sums = known.join(state.filter("not done").select("_rank", "lam"), "_rank").groupBy("_rank").agg(
            F.sum(words * rate).alias("reached"), F.sum(F.when(rate < most, words * F.col("x") * rate).otherwise(0.0)).alias("slope")
        )
        settled = F.col("done") | F.col("reached").isNull() | (F.abs(gap) <= F.col("target") * NEAR)
        step = state.join(sums, "_rank", "left").withColumns({
            "low": F.when(gap < 0, lam).otherwise(F.col("low")), "high": F.when(gap > 0, lam).otherwise(F.col("high")), "done": settled,
        })
        low = F.coalesce("low", lam - 2 * F.greatest(F.lit(1.0), F.abs(lam)))
        high = F.coalesce("high", lam + 2 * F.greatest(F.lit(1.0), F.abs(lam)))
        newton = F.when(F.col("slope") > 0, lam - gap / F.col("slope"))
        moved = F.when(F.col("done"), lam).when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = staged(step.select("_rank", "target", moved.alias("lam"), "low", "high", "done"))
        if state.filter("not done").isEmpty():
            break
    return sources.join(state.select("_rank", "lam"), "_rank").withColumn("lam", F.when(~full, F.col("lam")))


def rounded(rates: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (_row, _rank, _block, size, rate, ...) with ``copies``: whole numbers near the rates whose words sum up alike."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "_mix", "_row"], ascending=[False, True, True], kind="stable")
        owed, copies = 0.0, []
        for size, rate in zip(block["size"].tolist(), block["rate"].tolist()):
            least = int(min(rate, most))
            owed += (rate - least) * size
            more = owed * 2 >= size and rate > least
            copies.append(least + more)
            owed -= size * more
        for i, size in enumerate(block["size"].tolist()):  # what is left over goes to the first documents it fits
            step = 1 if owed > 0 else -1
            if size and abs(owed) * 2 > size and 0 <= copies[i] + step <= most:
                copies[i] += step
                owed -= size * step
        return block.assign(copies=np.array(copies, np.int64))[["_row", "doc_id", "size", "source_size", "target", "copies"]]

    schema = "_row long, doc_id long, size long, source_size long, target double, copies long"
    return rates.groupBy("_rank", "_block").applyInPandas(run, schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_row, doc_id, size, source_size, target, copies) of every document of ``docs`` (keyed: _row, doc_id, source, text)."""
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    sizes = staged(word_counts(docs).withColumn("_source", key))
    counts = staged(sizes.groupBy("_source", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = counts.groupBy("_source", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.max("size").alias("largest"), F.sum("n").alias("docs"))
    ranked = staged(targets(sources, weights, share, most))
    by_rank = counts.join(ranked.select("_source", "_rank"), "_source").select("_rank", "size", "n")
    solved = staged(multipliers(by_rank, ranked, most))
    facts = solved.select("_source", "_rank", "source_size", "target", "largest", "lam", "docs")
    joined = answer_join(sizes.select("_row", "doc_id", "size", "_source"), facts, ["_source"], "docs", sizes.count())
    tilted = F.exp(F.col("lam") * F.col("size") / F.greatest("largest", F.lit(1)))
    rates = joined.withColumns({
        "rate": F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), tilted)),
        "_mix": F.xxhash64("_row"),
        "_block": F.pmod(F.xxhash64("_row", F.lit("block")), F.ceil(F.col("docs") / BLOCK_ROWS)),
    })
    return rounded(rates, most)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document."""
    rows = keyed(docs, F.col("source").cast("string").alias("source"), "text")
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def documents_mixed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns), each as often as the mix takes it."""
    rows = keyed(docs.select("doc_id", "source", "text", F.struct("*").alias("_all")), "source", "text", "_all")
    taken = mix(rows).filter("copies > 0").select("_row", "copies")
    repeated = rows.select("_row", "_all").join(taken, "_row").select("_all", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return repeated.select("_all.*")
