"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. ``signatures``: one hash of every shingle; the hash range is cut into ``bands * rows`` bins and each bin keeps
   its least hash.  Empty bins borrow from a full bin chosen by a fixed random sequence of the bin (optimal
   densification), so short texts work too.
2. Documents with the same shingle set are folded into one first, so a group of copies costs one row per bucket.
3. Every bucket of a band is a star: its least document is linked with each member, so a bucket of n documents gives
   n - 1 candidate pairs.  Pairs are confirmed on full shingle sets.
4. Stars alone could miss a link between two members that are not alike to the centre.  So buckets whose members are
   not yet in one component are completed: each member outside the bucket's largest component is compared with the
   members of other components.  The parity of a set's hashes on a bit map differs in at most as many bits as two sets
   have elements that are not common, so most of these pairs are ruled out for certain by their bit maps.

With the default 32 bands of 5 rows, a pair at the threshold of 0.85 shares no bucket with probability 7e-9 (0.8: 3e-6).

Defined cases: null, empty and blank texts have empty sets and are linked with nothing; a text shorter than a shingle
is one shingle; repeated rows and null ids are documents of their own (``rows.keyed``); ties go to the least id; an
empty table gives an empty result; other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.components import components
from siteweave.llm.rows import answer_join, keyed
from siteweave.llm.words import Words, longs, mix, signed, slices, text_bytes
from siteweave.session import staged

BANDS, ROWS = 32, 5
SALTS = 16
_U = np.uint64


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill empty bins of each row from the first full bin in the bin's own random sequence.

    The sequence is the same for every document, so equal sets stay equal and the chance that a bin agrees stays the
    similarity of the sets.  Rows without any full bin are left alone.
    """
    bins = values.shape[1]
    order = np.random.default_rng(bins).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)
    out = values.copy()
    todo = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    missing = ~full[todo]
    for step in range(bins):
        if not len(todo):
            break
        source = order[:, step]
        take = missing & full[todo][:, source]
        r, c = np.nonzero(take)
        out[todo[r], c] = values[todo[r], source[c]]
        missing &= ~take
        left = missing.any(axis=1)
        todo, missing = todo[left], missing[left]
    return out


def one_permutation(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Densified least hashes by bin, one row per text, from sorted shingle hashes."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    # bins are ranges of the hash, so the sorted order already groups them
    bin_of = ((hashes >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    new = np.ones(len(hashes), bool)
    new[1:] = (text[1:] != text[:-1]) | (bin_of[1:] != bin_of[:-1])
    values, full = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    values[text[new], bin_of[new]] = hashes[new]
    full[text[new], bin_of[new]] = True
    return densify(values, full)


def band_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    """One hash per text and band, which also holds the number of the band."""
    parts = values.reshape(len(values), bands, -1)
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for j in range(parts.shape[2]):
        total = mix(total * _U(0x9E3779B97F4A7C15) ^ parts[:, :, j])
    return total


def parity_maps(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bit maps of each set, as lists of longs: a bit is set if an odd number of hashes falls on it.

    A map has a power of two of bits, at least 64 and at least 1.5 for each element; a map of half the bits is the
    exclusive or of its halves.
    """
    size = np.diff(offsets)
    bits = 1 << np.ceil(np.log2(np.maximum(64, 1.5 * size))).astype(np.int64)
    start = np.cumsum(bits) - bits
    place = np.repeat(start, size) + (mix(hashes) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    longs_ = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(bits // 64)].astype(np.int32)), pa.array(longs_))


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(signed(matrix).reshape(-1)), matrix.shape[1]).cast(pa.list_(pa.int64()))


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_row, n_shingles, set_a, set_b, bands, parity) of keyed documents; empty sets have null hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            hashes, offsets = Words(texts).shingle_sets(k)
            size = np.diff(offsets)
            values = one_permutation(hashes, offsets, bands * rows)
            sums = [np.r_[_U(0), np.cumsum(mix(hashes ^ _U(seed)))] for seed in (0x51ED270B, 0xA24BAED4963EE407)]
            total = [mix(s[offsets[1:]] - s[offsets[:-1]] + size.astype(np.uint64)) for s in sums]
            empty = size == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), pa.array(size), pa.array(signed(total[0]), mask=empty), pa.array(signed(total[1]), mask=empty),
                    _lists(band_hashes(values, bands)), parity_maps(hashes, offsets),
                ],
                ["_row", "n_shingles", "set_a", "set_b", "bands", "parity"],
            )

    schema = "_row long, n_shingles long, set_a long, set_b long, bands array<long>, parity array<long>"
    return docs.select("_row", "text").mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    ``a`` is the centre of a star and may be hot; its text goes to one row per salt of its members, so that no task
    gets a whole large star.
    """
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    centres = salted.select("a", "_salt").distinct().join(texts.select(F.col("_row").alias("a"), F.col("text").alias("text_a")), "a")
    members = salted.join(texts.select(F.col("_row").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, right in slices(batches, "text_b"):
            left = text_bytes(batch.column("text_a"))
            a = longs(batch.column("a"))
            new = np.r_[True, a[1:] != a[:-1]]  # a run of pairs with the same centre takes its set once
            ha, oa = Words([left[i] for i in np.flatnonzero(new)]).shingle_sets(k)
            hb, ob = Words(right).shingle_sets(k)
            at = np.cumsum(new) - 1
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = ha[oa[at[i]]:oa[at[i] + 1]], hb[ob[i]:ob[i + 1]]
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and len(x):
                    both = np.sort(np.concatenate((x, y)))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = members.join(centres, ["a", "_salt"]).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _may_link(x: str, y: str, nx: str, ny: str, percent: int) -> Column:
    """Whether the parity maps leave it open that two sets reach the threshold (never false for sets that do)."""
    allowed = (F.col(nx) + F.col(ny)) * (100 - percent) / (100 + percent)
    n = F.least(F.size(x), F.size(y))

    def folded(name: str) -> Column:
        halves = F.zip_with(F.slice(name, 1, n), F.slice(name, n + 1, n), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(name) > n, halves).otherwise(F.col(name))

    differing = F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    close = (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (F.greatest(F.size(x), F.size(y)) <= n * 2)
    return close & (F.aggregate(differing, F.lit(0), lambda total, d: total + d) <= allowed)


def _completion(members: DataFrame, labels: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs inside buckets that hold more than one component, beyond the stars."""
    known = members.join(labels, members["row"] == labels["node"], "left")
    marked = staged(known.select("bucket", "row", "centre", F.coalesce("label", "row").alias("label")))
    sizes = marked.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).filter("labels > 1")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    unresolved = staged(marked.join(mixed.select("bucket", "main"), "bucket").join(heads.select("row", "n", "parity"), "row"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    outside = unresolved.filter("label <> main").select("bucket", every, F.col("row").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("parity").alias("px"))
    inside = unresolved.select("bucket", salt.cast("int").alias("salt"), F.col("row").alias("y"), F.col("label").alias("ly"), "main", "centre", F.col("n").alias("ny"), F.col("parity").alias("py"))
    once = (F.col("ly") == F.col("main")) | (F.col("x") < F.col("y"))
    untested = (F.col("x") != F.col("centre")) & (F.col("y") != F.col("centre"))
    joined = outside.join(inside, ["bucket", "salt"]).filter((F.col("lx") != F.col("ly")) & once & untested & _may_link("px", "py", "nx", "ny", percent))
    return joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, by_row: bool = False
) -> DataFrame:
    """(_row, doc_id, n_shingles, component) of every document; ``component`` is the least ``_row`` reachable by links.

    ``docs`` has ``doc_id`` and ``text``; with ``by_row`` it comes from :func:`siteweave.llm.rows.keyed` and has its ``_row``,
    which otherwise is a column like any other and not looked at.
    """
    texts = docs.select("_row", "doc_id", "text") if by_row else keyed(docs, "text")
    marks = staged(signatures(texts, k, bands, rows))
    total = marks.count()
    sets = marks.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = staged(sets)
    heads = marks.join(firsts.select(F.col("first").alias("_row")), "_row", "left_semi")
    heads = staged(heads.select(F.col("_row").alias("row"), F.col("n_shingles").alias("n"), "bands", "parity"))

    buckets = heads.select("row", F.explode("bands").alias("bucket"))
    stars = staged(buckets.groupBy("bucket").agg(F.min("row").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = staged(answer_join(buckets, stars, ["bucket"], "n", total * bands).select("bucket", "row", "centre"))
    pairs = members.filter("row <> centre").select(F.col("centre").alias("a"), F.col("row").alias("b")).distinct()
    links = staged(confirmed(pairs, texts, k, percent))
    labels = components(links)
    extra = staged(confirmed(_completion(members, labels, heads, percent), texts, k, percent))
    if not extra.isEmpty():
        labels = components(links.unionByName(extra))

    answers = firsts.join(labels, firsts["first"] == labels["node"], "left")
    answers = answers.select("set_a", "set_b", "copies", F.coalesce("label", "first").alias("component"))
    slim = marks.select("_row", "n_shingles", "set_a", "set_b")
    found = answer_join(slim.filter("n_shingles > 0"), answers, ["set_a", "set_b"], "copies", total).select("_row", "n_shingles", "component")
    empty = slim.filter("n_shingles = 0").select("_row", "n_shingles", F.col("_row").alias("component"))
    return found.unionByName(empty).join(texts.select("_row", "doc_id"), "_row")


def documents_kept(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (all columns), one document of each group of near-duplicates."""
    rows = keyed(docs.select("doc_id", "text", F.struct("*").alias("_all")), "text", "_all")
    found = near_duplicates(rows, k, percent, by_row=True)
    return rows.join(found.filter("_row = component").select("_row"), "_row", "left_semi").select("_all.*")


def report(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """The near-duplicate classes as (doc_id, n_shingles, component_id, kept)."""
    found = near_duplicates(docs, k, percent)
    if docs.select("doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        named = found.withColumn("component_id", F.col("component"))
    else:
        found = staged(found)
        names = found.filter("_row = component").select("component", F.col("doc_id").alias("component_id"))
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        named = answer_join(found, names.join(sizes, "component"), ["component"], "n", found.count())
    return named.select("doc_id", "n_shingles", "component_id", (F.col("_row") == F.col("component")).alias("kept"))
