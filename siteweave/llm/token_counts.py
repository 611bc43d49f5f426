"""Token counts from an exact length histogram.

Documents are encoded whole and counted by their encoded length.  The histogram with its suffix sums answers every question
about totals, quantiles and truncated totals for any context limit, without another pass over the texts: a limit of L
keeps all ids of shorter documents and L ids of each other one.

Defined cases: null and empty texts have length 0 and are counted; repeated rows count as often as they occur; an empty
table gives an empty histogram; other columns, ids included, are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.encode import encoder, tokenizer_path
from siteweave.llm.words import slices
from siteweave.session import staged

BLOCK = 4_096  # lengths of a block of the suffix sums


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) partial counts: one row per length and task."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        encode = encoder(path)
        for _, texts in slices(batches):
            found, n = np.unique(encode.lengths(texts), return_counts=True)
            for length, count in zip(found.tolist(), n.tolist()):
                total[length] = total.get(length, 0) + count
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) of all documents."""
    return lengths(docs, tokenizer).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram with, for each length: documents and ids of that length or more, and ids left by a limit of it.

    Lengths are summed in blocks of ``BLOCK``, and the blocks' totals (few) are summed across, so no task gets all lengths.
    """
    block = F.floor(F.col("n_tokens") / BLOCK).alias("block")
    ids = F.col("n_tokens") * F.col("n_docs")
    rows = staged(counts.select("n_tokens", "n_docs", ids.alias("n_ids"), block))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("i"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    behind = totals.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("i").over(later), F.lit(0)).alias("i"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"di": F.sum("n_docs").over(inside), "ii": F.sum("n_ids").over(inside)}).join(behind, "block")
    total = totals.agg(F.sum("i")).first()[0] or 0
    docs_from, ids_from = F.col("di") + F.col("d"), F.col("ii") + F.col("i")
    return summed.select(
        "n_tokens", "n_docs", docs_from.alias("docs_at_least"), ids_from.alias("ids_at_least"),
        (F.lit(total) - ids_from + F.col("n_tokens") * docs_from).alias("ids_within"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Ids that are left if every document is cut to ``limit``: from the suffix sums alone."""
    total = sums.agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).first()[0] or 0
    longer = sums.filter(F.col("n_tokens") >= limit).orderBy("n_tokens").select("docs_at_least", "ids_at_least").first()
    return total if longer is None else total - longer["ids_at_least"] + limit * longer["docs_at_least"]


def quantile(sums: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents do not exceed."""
    docs = sums.agg(F.sum("n_docs")).first()[0]
    if not docs:
        return None
    reached = sums.filter(docs - F.col("docs_at_least") + F.col("n_docs") >= F.lit(share) * docs)
    return reached.agg(F.min("n_tokens")).first()[0]


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs, docs_at_least, ids_at_least, ids_within), one row per length that occurs."""
    return suffix_sums(histogram(docs, tokenizer))
