"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

For a benchmark item of n words, every n-word window of a document is a candidate, provided that it holds one of the
item's rarest shingles: of the item's ``b`` shingles at least ``t = percent * b / 100`` must be in the window, so one of any
``b - t + 1`` is, repeats counted.  The rarest in the benchmark are taken; this loses nothing.  A document with fewer
words than the item is one window, the whole document, where its size can still reach the threshold.

1. ``hits``: shingles of all documents are joined with the (few, counted) rarest shingles of the benchmark's items.
2. Each hit names the windows around it.  Documents are cut into segments of window starts, with the shingles that their
   windows reach, so no row grows with the document.  A window's SimHash has 128 bits: per bit, the shingles' votes are
   summed, each shingle voting as often as it occurs.  Votes of 64 bits are summed in 32 numbers of two 32-bit fields.
3. Multi-index Hamming search: fingerprints are cut into ``radius + 1`` blocks; two fingerprints within the radius agree in
   at least one block, so windows and items of the same length are joined on (length, block, value).  All fingerprints
   within the radius are found.  Whole documents that are shorter than the item need no fingerprint: the item's rarest
   shingles are joined with the document's.  This is exact at every size.
4. The weighted similarity of window and item, sum of least over sum of greatest multiplicities of their shingles,
   is computed exactly and must reach the threshold.

At a similarity of 0.8, fingerprints of 128 bits differ in 19.4 bits on average (standard deviation 4.1); the radius
of 40 lies five deviations above.

Defined cases: null, empty and blank texts match nothing, nor do such items; an item with fewer words than a shingle is one
shingle; items with equal text are reported separately; ``n_words`` is the
window's length, so that of the document where it is shorter than the item; repeated rows and null ids are documents of their own; of equally
similar windows the first is reported; empty tables give an empty result; other columns are not looked at.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.text import let
from siteweave.llm.rows import answer_join, keyed
from siteweave.session import staged

SHINGLE = 5
PERCENT = 80
RADIUS = 40
BROADCAST_ROWS = 2_000_000  # most benchmark shingles or blocks that are broadcast (two or three numbers each)
SEGMENT = 1_024  # window starts in one row
SEEDS = (625079441, 1812991333)  # of the two words of a fingerprint
_FIELDS = 0x0000000100000001


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def hashed_words(text: str) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def shingles_of(w: Column, k: int) -> Column:
    """Hashes of all ``k``-word shingles by place, of hashed words (a lambda variable); the whole sequence where there are fewer."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))


def fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash (``f0``, ``f1``) of the rows (keys, h, size) of each key; ``size`` is their number."""
    hashed = shingles.selectExpr(*keys, "size", *[f"xxhash64(h, {seed}) g{s}" for s, seed in enumerate(SEEDS)])
    votes = [F.expr(f"sum(shiftrightunsigned(g{s}, {i}) & {_FIELDS}L) v{s}_{i}") for s in range(2) for i in range(32)]
    summed = hashed.groupBy(*keys).agg(F.max("size").alias("size"), *votes)

    def packed(s: int) -> str:
        low = [f"if((v{s}_{i} & 4294967295L) * 2 > size, {1 << i}L, 0L)" for i in range(32)]
        high = [f"if(shiftrightunsigned(v{s}_{i}, 32) * 2 > size, shiftleft(1L, {i + 32}), 0L)" for i in range(32)]
        return " | ".join(low + high)

    return summed.selectExpr(*keys, *[f"{packed(s)} f{s}" for s in range(2)])


def block_values(radius: int) -> Column:
    """The ``radius + 1`` blocks of a 128-bit fingerprint, none across its two words, as an array of (block, value)."""
    half = (radius + 2) // 2
    parts = []
    for word, blocks in (("f0", half), ("f1", radius + 1 - half)):
        bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
        for start, end in zip(bounds, bounds[1:]):
            parts.append(f"named_struct('block', {len(parts)}, 'value', shiftrightunsigned({word}, {start}) & {(1 << (end - start)) - 1}L)")
    return F.expr(f"array({', '.join(parts)})")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows allow it; a shuffle join otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _short(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Matches of items of ``n`` words, fewer than a shingle: such an item is one shingle and matches its equals only."""
    def each(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<long>"))

    spread = texts.select("_row", F.posexplode_outer(let(hashed_words("text"), each)).alias("place", "h"))
    wanted = items.filter(F.col("n_words") == n).select("item_id", "item", F.col("sh")[0].alias("h"))
    first = spread.join(wanted, "h").groupBy("_row", "item", "item_id").agg(F.min("place").alias("start_word"))
    return first.select("_row", "item_id", "start_word", F.lit(n).alias("n_words"), F.lit(1.0).alias("similarity"))


def _rarest(items: DataFrame, percent: int) -> DataFrame:
    """(item, n_words, h): of each item's shingles, the rarest in the benchmark, so many that a shorter document which is alike holds one."""
    each = staged(items.select("item", "n_words", F.size("sh").alias("size"), F.explode("sh").alias("h")))
    held = staged(each.groupBy("h").agg(F.count(F.lit(1)).alias("held")))
    placed = answer_join(each, held, ["h"], "held", each.count())
    ordered = placed.groupBy("item", "n_words", "size").agg(F.array_sort(F.collect_list(F.struct("held", "h"))).alias("o"))
    needed = F.expr(f"size - ({percent} * size + 99) div 100 + 1").cast("int")
    return ordered.select("item", "n_words", F.explode(F.slice("o", F.lit(1), needed)).alias("o")).select("item", "n_words", F.col("o.h").alias("h")).distinct()


def _segments(k: int, longest: int) -> Column:
    """Of a document's shingles ``s.sh``: (seg, part), each with the shingles of all windows that start in the segment."""
    def segment(g: Column) -> Column:
        last = F.least((g + 1) * SEGMENT - 1 + (longest - k), F.size("s.sh") - 1)
        return F.struct(g.alias("seg"), F.transform(F.sequence(g * SEGMENT, last), lambda i: F.get("s.sh", i)).alias("part"))

    return F.transform(F.expr(f"sequence(0, (size(s.sh) - 1) div {SEGMENT})").cast("array<int>"), segment)


def _windows(k: int, percent: int) -> Column:
    """The windows (start, n_words, ws) of a segment around its hits: places, items' lengths and their shingles, each once.

    A document shorter than the item is one window with fewer shingles, if they suffice.
    """
    base = F.col("seg") * SEGMENT

    def reach(hit: Column) -> Column:
        # a window's shingles start at most n - k places earlier
        first = F.greatest(base, hit["place"] - (hit["n_words"] - k))
        last = F.least(base + (SEGMENT - 1), hit["place"], F.col("doc_words") - hit["n_words"])
        starts = F.transform(F.sequence(first, last), lambda x: F.shiftleft(x.cast("long"), 31).bitwiseOR(hit["n_words"].cast("long")))
        suffices = (F.col("doc_words") - (k - 1)) * 100 >= (hit["n_words"] - (k - 1)) * percent
        whole = (F.col("doc_words") < hit["n_words"]) & suffices & (F.col("seg") == 0)
        return F.when(first <= last, starts).when(whole, F.array(hit["n_words"].cast("long"))).otherwise(F.array().cast("array<long>"))

    def window(key: Column) -> Column:
        start, n = F.shiftright(key, 31).cast("int"), key.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        last = F.least(start + n, F.col("doc_words")) - k
        # by place: a slice would copy the whole segment for each window
        shingles = F.transform(F.sequence(start, last), lambda i: F.get("part", i - base))
        return F.struct(start.alias("start"), n.alias("n_words"), shingles.alias("ws"))

    return F.transform(F.array_distinct(F.flatten(F.transform("hits", reach))), window)


def contaminated(texts: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(_row, item_id, start_word, n_words, similarity): the best window of every matching document and item.

    ``texts`` holds the text and a unique ``_row`` for each document, as :func:`rows.keyed` gives them.
    """

    def both(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), shingles_of(w, k).alias("sh"))

    every = staged(benchmark.select("item_id", let(hashed_words("text"), both).alias("s")))
    every = staged(every.select("item_id", "s.n_words", "s.sh").filter("n_words > 0").withColumn("item", F.monotonically_increasing_id()))
    short = [r["n_words"] for r in every.filter(F.col("n_words") < k).select("n_words").distinct().collect()]  # fewer than k numbers
    items = every.filter(F.col("n_words") >= k)
    rarest = staged(_rarest(items, percent))
    by_shingle = staged(rarest.select("n_words", "h").distinct())

    spread = texts.select("_row", F.posexplode_outer(let(hashed_words("text"), lambda w: shingles_of(w, k))).alias("place", "h"))
    hits = staged(spread.join(_sized(by_shingle, by_shingle.count()), "h").select("_row", "place", "n_words").distinct())
    # the same plan at every size: the number of documents with hits has no bound, so they are never broadcast
    asked = hits.select("_row").distinct()
    shingled = staged(texts.select("_row", "text").join(asked.hint("merge"), "_row").select("_row", let(hashed_words("text"), both).alias("s")))
    longest = items.agg(F.max("n_words")).first()[0] or k
    segments = shingled.select("_row", F.col("s.n_words").alias("doc_words"), F.explode(_segments(k, longest)).alias("g")).select("_row", "doc_words", "g.*")
    segs = F.expr(f"sequence(greatest(0, place - n_words + {k}) div {SEGMENT}, place div {SEGMENT})").cast("array<int>")
    placed = hits.select("_row", "place", "n_words", F.explode(segs).alias("seg"))
    placed = placed.groupBy("_row", "seg").agg(F.collect_list(F.struct("place", "n_words")).alias("hits"))  # places within reach of one segment
    windows = staged(segments.join(placed.hint("merge"), ["_row", "seg"]).select("_row", F.explode(_windows(k, percent)).alias("w")).select("_row", "w.*"))
    keys = ["_row", "start", "n_words"]
    whole = F.size("ws") < F.col("n_words") - (k - 1)
    # written, so that the long expressions of the bits are not repeated in every block
    prints = staged(fingerprints(windows.filter(~whole).select(*keys, F.size("ws").alias("size"), F.explode("ws").alias("h")), keys))
    item_prints = staged(fingerprints(items.select("item", "n_words", F.size("sh").alias("size"), F.explode("sh").alias("h")), ["item", "n_words"]))
    item_blocks = staged(item_prints.select("item", "n_words", F.col("f0").alias("i0"), F.col("f1").alias("i1"), F.explode(block_values(radius)).alias("b")).select("item", "n_words", "i0", "i1", "b.*"))

    blocks = prints.select(*keys, "f0", "f1", F.explode(block_values(radius)).alias("b")).select(*keys, "f0", "f1", "b.*")
    distance = F.bit_count(F.col("f0").bitwiseXOR(F.col("i0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("i1")))
    near = blocks.join(_sized(item_blocks, item_blocks.count()), ["n_words", "block", "value"]).filter(distance <= radius)
    shorter = windows.filter(whole).select(*keys, F.explode(F.array_distinct("ws")).alias("h")).join(_sized(rarest, rarest.count()), ["n_words", "h"])
    near = near.select(*keys, "item").unionByName(shorter.select(*keys, "item")).distinct()

    pairs = near.hint("merge").join(windows, keys).join(_sized(items.select("item", "item_id", "sh"), items.agg(F.sum(F.size("sh"))).first()[0] or 0), "item")
    common = F.aggregate(
        F.array_distinct("ws"), F.lit(0),
        lambda total, h: total + F.least(F.size(F.filter("ws", lambda x: x == h)), F.size(F.filter("sh", lambda x: x == h))),
    )
    exact = pairs.select(*keys, "item", "item_id", common.alias("common"), F.size("ws").alias("a"), F.size("sh").alias("b"))
    union = F.col("a") + F.col("b") - F.col("common")
    alike = exact.filter(F.col("common") * 100 >= union * percent).select("_row", "item", "item_id", "start", (F.col("a") + (k - 1)).alias("n_words"), (F.col("common") / union).alias("similarity"))
    best = alike.groupBy("_row", "item", "item_id").agg(F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start"))).alias("w"))
    found = best.select("_row", "item_id", F.col("w.start").alias("start_word"), F.col("w.n_words").alias("n_words"), F.col("w.similarity").alias("similarity"))
    for n in short:
        found = found.unionByName(_short(texts, every, n))
    return found


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents: (doc_id, item_id, start_word, n_words, similarity), one row per document and item."""
    rows = keyed(docs, "text")
    return contaminated(rows, benchmark).join(rows.select("_row", "doc_id"), "_row").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def documents_kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) without a benchmark passage."""
    rows = keyed(docs.select("doc_id", "text", F.struct("*").alias("_all")), "text", "_all")
    found = contaminated(rows.select("_row", "text"), benchmark).select("_row").distinct()
    return rows.select("_row", "_all").join(found, "_row", "left_anti").select("_all.*")
