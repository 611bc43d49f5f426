"""Removal of repeated byte strings with a sparse suffix array, built by a distributed merge sort.

A byte goes if it lies in a ``length``-byte string that also starts earlier (smaller row, or same row and earlier start).

Which suffixes are sorted.  Sorting the suffix at every byte would move many times the input.  Of every ``length``-byte
string, the ``GRAM``-byte substring with the least hash is an anchor; it depends on the string alone, so equal strings have
equal anchors at equal places.  An anchor's context (all strings around it that hold it) settles most cases by
itself: if the same whole context occurs earlier, all its strings are repeats; if no other context has the same anchor,
there is nothing to compare.  Contexts are counted by 128-bit hashes, folded within each task first, so a passage with
any number of copies gives one row per task.  Only first contexts whose anchor also occurs in other contexts are sorted.

The sort.  Each task sorts its suffixes and sends every partition one front-coded run: per suffix the length of the
prefix shared with the one before it, and the rest.  A partition merges its runs with a loser tree that knows, for each
waiting suffix, the prefix it shares with the last one output; it compares bytes only beyond that, and returns the
shared prefix lengths of the merged order.  With these, and the sorted bytes before the anchors, strings are
grouped at each distance from the anchor, and all but the first of a group are repeats.

A gram with more than ``HOT`` different contexts (a common line between different neighbours) is split: all
its strings enter the sort as suffixes of their own, placed by the hash of the whole string.

Defined cases: null is the empty text; texts shorter than ``length`` keep all bytes; repeated rows and null ids are
documents of their own, in the order of ``rows.keyed``, and the later ones lose their repeated strings; an empty table
gives an empty result; other columns are not looked at.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.rows import keyed
from siteweave.llm.words import between, longs, mix, prefix, signed, slices, text_bytes
from siteweave.session import staged

LENGTH = 100
GRAM = 50
CHUNK = 24 << 20        # bytes of text whose contexts a task folds at once
RUN = 150_000           # suffixes a task sorts at once
PARTITION = 100_000     # suffixes merged by one task
HOT = 10_000            # contexts of a gram from which it is split
_U = np.uint64


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest value of each ``width`` neighbours, by doubling."""
    pick, span, out = np.minimum if least else np.maximum, 1, values
    while span < width:
        step = min(span, width - span)
        out = pick(out[:-step], out[step:])
        span += step
    return out


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, gram hash, context hash) of every anchor of the texts."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length or not (sizes >= length).any():
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix(data)
    place = np.arange(len(data) - gram + 1)
    grams = between(sums, place, place + gram)
    end = np.cumsum(sizes)
    valid = np.zeros(len(data) - length + 1, bool)  # strings that lie within one text
    for e, n in zip(end.tolist(), sizes.tolist()):
        if n >= length:
            valid[e - n:e - length + 1] = True
    width = length - gram + 1
    least = np.where(valid, _sliding(grams, width, True), _U(0))
    around = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero((_sliding(around, width, False) == grams) & (grams > 0))
    text = np.searchsorted(end, at, "right")
    start, stop = (end - sizes)[text], end[text]
    left, right = np.maximum(start, at - (length - gram)), np.minimum(stop, at + length)
    context = mix(between(sums, left, at) * _U(0x9E3779B97F4A7C15) ^ between(sums, at, right))
    return text, at - start, grams[at], context


def _contexts(length: int, gram: int):
    """Anchor rows of a partition; repeats inside a chunk become spans at once."""

    def fold(parts: list[tuple]) -> pa.RecordBatch:
        row, place, grams, context = (np.concatenate(x) for x in zip(*parts))
        if (np.diff(row) < 0).any():
            order = np.lexsort((place, row))
            row, place, grams, context = row[order], place[order], grams[order], context[order]
        order = np.argsort(mix(grams) ^ context, kind="stable")
        g, c = grams[order], context[order]
        first = np.ones(len(order), bool)
        first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        repeat = np.sort(order[~first])
        r, start = row[repeat], np.maximum(place[repeat] - (length - gram), 0)
        end = place[repeat] + length
        if len(r):  # spans of one row that touch are joined; they come in order
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (start[1:] > end[:-1])
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(r) - 1]
            r, start, end = r[new], start[new], end[last]
        keep = np.sort(order[first])
        n, m = len(keep), len(r)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.zeros(n, np.int8), np.ones(m, np.int8)]), pa.array(np.r_[signed(grams[keep]), signed(mix(r.astype(np.uint64)))]),
                pa.array(np.r_[signed(context[keep]), np.zeros(m, np.int64)]), pa.array(np.r_[row[keep], r]),
                pa.array(np.r_[place[keep], start].astype(np.int64)), pa.array(np.r_[np.zeros(n, np.int64), end]),
            ],
            ["kind", "gram", "context", "row", "place", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, texts in slices(batches):
            text, place, grams, context = anchors(texts, length, gram)
            if len(text):
                parts.append((longs(batch.column("_row"))[text], place, grams, context))
            held += sum(map(len, texts))
            if held >= CHUNK and parts:
                yield fold(parts)
                parts, held = [], 0
        if parts:
            yield fold(parts)

    return run


def marks(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Repeats by whole context, as spans (kind 1: row, place, end), and the contexts to sort (kind 0: row, place, gram, hot)."""
    found = texts.select("_row", "text").mapInArrow(_contexts(length, gram), "kind byte, gram long, context long, row long, place long, end long")
    same = Window.partitionBy("kind", "gram")
    ordered = same.orderBy("context", "row", "place")
    ranked = found.withColumn("before", F.lag("context").over(ordered)).withColumns(
        {"n": F.count(F.lit(1)).over(same), "several": F.min("context").over(same) != F.max("context").over(same)}
    )
    span = F.col("kind") == 1
    repeat = ~span & F.col("before").eqNullSafe(F.col("context"))
    return ranked.filter(span | repeat | F.col("several")).select(
        F.when(span | repeat, 1).otherwise(0).cast("byte").alias("kind"), "row",
        F.when(repeat, F.greatest(F.lit(0), F.col("place") - (length - gram))).otherwise(F.col("place")).alias("place"),
        F.when(repeat, F.col("place") + length).when(span, F.col("end")).alias("end"),
        F.when(~span & ~repeat, F.col("gram")).alias("gram"), (F.col("n") > HOT).alias("hot"),
    )


def front_code(suffixes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared prefix lengths of sorted neighbours, and the remaining bytes of all, from a matrix of padded suffixes."""
    shared = np.zeros(len(suffixes), np.int64)
    if len(suffixes) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
        shared[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    column = np.arange(suffixes.shape[1])
    return shared, suffixes[(column >= shared[:, None]) & (column < sizes[:, None])]


def decode(shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, last, at = [], b"", 0
    for h, n in zip(shared.tolist(), sizes.tolist()):
        last = last[:h] + rest[at:at + n - h]
        at += n - h
        out.append(last)
    return out


def _compare(a: bytes, b: bytes, h: int) -> tuple[bool, int]:
    """Whether a <= b, and their shared prefix length, given that they share ``h`` bytes."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h:h + 16] == b[h:h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return (len(a) <= len(b) if h == n else a[h] < b[h]), h


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs with a loser tree; (run of each output, prefix shared with the output before).

    A node keeps the loser of its match with the prefix length it shares with the last output.  A suffix that shares
    more with the last output than another is smaller, without looking at bytes; with equal lengths, comparison starts
    behind them, and the loser remembers the prefix it shares with the winner.  An empty run waits with length -1.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    place = [0] * leaves
    current = [run[0] if run else b"" for run in runs] + [b""] * (leaves - len(runs))
    known = [0 if run else -1 for run in runs] + [-1] * (leaves - len(runs))
    loser, loser_known = [0] * leaves, [-1] * leaves
    winners = list(range(leaves))
    while len(winners) > 1:  # first round of matches, from the leaves to the root
        base, following = len(winners) // 2, []
        for i in range(base):
            a, b = winners[2 * i], winners[2 * i + 1]
            ha, hb = known[a], known[b]
            if ha == hb and ha >= 0:
                less, h = _compare(current[a], current[b], ha)
                if not less:
                    a, b = b, a
                hb = h
            elif ha < hb:
                a, b, hb = b, a, ha
            loser[base + i], loser_known[base + i] = b, hb
            following.append(a)
        winners = following
    best = winners[0]
    best_known = known[best]
    order, prefixes = [], []
    while best_known >= 0:
        order.append(best)
        prefixes.append(best_known)
        at = place[best] = place[best] + 1
        run = runs[best]
        if at < len(run):
            current[best] = run[at]
            best_known = shared[best][at]
        else:
            best_known = -1
        node = (best + leaves) >> 1
        while node:
            other_known = loser_known[node]
            if other_known > best_known:
                other = loser[node]
                loser[node], loser_known[node] = best, best_known
                best, best_known = other, other_known
            elif other_known == best_known and best_known >= 0:
                other = loser[node]
                less, h = _compare(current[best], current[other], best_known)
                if less:
                    loser_known[node] = h
                else:
                    loser[node], loser_known[node] = best, h
                    best = other
            node >>= 1
    return order, prefixes


RUNS = "part int, shared binary, sizes binary, rest binary, left_sizes binary, left binary, row binary, place binary"


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Matrix of the byte strings from ``start``, padded with zeros behind ``size``."""
    column = np.arange(width)
    return np.where(column < size[:, None], data[np.minimum(start[:, None] + column, len(data) - 1)], np.uint8(0))


def _runs(length: int, gram: int, parts: int):
    """Front-coded sorted runs of the contexts of a partition of joined rows (_row, text, found)."""
    reach = length - gram

    def code(entries: list[tuple]) -> pa.RecordBatch:
        right, size, left, left_size, row, place, part = (np.concatenate(x) for x in zip(*entries))
        order = np.lexsort((place, row, size, np.ascontiguousarray(right).view(f"S{length}").reshape(-1), part))
        right, size, left, left_size, row, place, part = (x[order] for x in (right, size, left, left_size, row, place, part))
        out = []
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            shared, rest = front_code(right[s:e], size[s:e])
            before = left[s:e][np.arange(reach) < left_size[s:e, None]]
            small = [x.astype(np.uint16).tobytes() for x in (shared, size[s:e])]
            out.append((int(part[s]), *small, rest.tobytes(), left_size[s:e].astype(np.uint16).tobytes(), before.tobytes(), row[s:e].tobytes(), place[s:e].tobytes()))
        names = [f.split()[0] for f in RUNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out))], names)

    def entries(row: int, text: bytes, place: np.ndarray, grams: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        at = place[~hot]
        if len(at):
            size, left_size = np.minimum(length, n - at), np.minimum(reach, at)
            left = np.where(np.arange(reach) < left_size[:, None], data[np.maximum(at[:, None] - 1 - np.arange(reach), 0)], np.uint8(0))
            part = mix(grams[~hot].view(np.uint64)) % _U(parts)
            yield _gather(data, at, size, length), size, left, left_size, np.full(len(at), row), at, part.astype(np.int64)
        split = np.unique(place[hot][:, None] - np.arange(reach + 1))  # starts of all strings around the hot anchors
        split = split[(split >= 0) & (split + length <= n)]
        for i in range(0, len(split), RUN):
            at = split[i:i + RUN]
            part = between(prefix(data), at, at + length) % _U(parts)
            size = np.full(len(at), length)
            yield _gather(data, at, size, length), size, np.zeros((len(at), reach), np.uint8), size * 0, np.full(len(at), row), at, part.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            found = batch.column("found")
            for i, (row, text) in enumerate(zip(batch.column("_row").to_pylist(), text_bytes(batch.column("text")))):
                marked = found[i].values
                place, grams = longs(marked.field("place")), longs(marked.field("gram"))
                hot = marked.field("hot").to_numpy(zero_copy_only=False)
                for entry in entries(row, text, place, grams, hot):
                    waiting.append(entry)
                    held += len(entry[1])
                    if held >= RUN:
                        yield code(waiting)
                        waiting, held = [], 0
        if waiting:
            yield code(waiting)

    return run


def repeats(right_shared: np.ndarray, size: np.ndarray, left: np.ndarray, left_size: np.ndarray, row: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in sorted order: greatest and least distance before the anchor of a string seen earlier (-1: none).

    A string at distance ``o`` is the ``o`` bytes before the anchor and ``length - o`` bytes from it, so two are equal
    if their suffixes share that prefix and their reversed left sides share ``o`` bytes.
    """
    m, reach = left.shape
    by_left = np.lexsort((left_size, np.ascontiguousarray(left).view(f"S{reach}").reshape(-1))) if reach else np.arange(m)
    left_shared, _ = front_code(left[by_left], left_size[by_left])
    in_order = np.lexsort((place, row))
    far, near = np.full(m, -1), np.full(m, -1)
    group = np.empty(m, np.int64)
    for o in range(reach + 1):
        group[by_left] = np.cumsum(left_shared < o) if o else 0
        key = np.cumsum(right_shared < length - o) * (m + 1) + group
        fits = in_order[(left_size[in_order] >= o) & (size[in_order] >= length - o)]
        _, first = np.unique(key[fits], return_index=True)
        later = np.ones(len(fits), bool)
        later[first] = False
        later = fits[later]
        near[later[near[later] < 0]] = o
        far[later] = o
    return far, near


def _merged(length: int, gram: int):
    """Merge the runs of one partition and return the repeated spans."""
    reach = length - gram

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        small = {name: [np.frombuffer(r[name], np.uint16).astype(np.int64) for r in rows] for name in ("shared", "sizes", "left_sizes")}
        suffixes = [decode(h, n, r["rest"]) for h, n, r in zip(small["shared"], small["sizes"], rows)]
        order, shared = merge(suffixes, [h.tolist() for h in small["shared"]])
        del suffixes
        order = np.array(order, np.int64)
        # a run's suffixes come out in its own order: the i-th output of a run is its i-th suffix
        stable = np.argsort(order, kind="stable")
        at = np.empty(len(order), np.int64)
        at[stable] = np.arange(len(order))
        size, left_size = (np.concatenate(small[name])[at] for name in ("sizes", "left_sizes"))
        row, place = (np.concatenate([np.frombuffer(r[name], np.int64) for r in rows])[at] for name in ("row", "place"))
        before = np.frombuffer(b"".join(r["left"] for r in rows), np.uint8)
        sizes = np.concatenate(small["left_sizes"])
        start = (np.cumsum(sizes) - sizes)[at]
        left = _gather(before, start, left_size, reach) if len(before) else np.zeros((len(at), reach), np.uint8)
        far, near = repeats(np.array(shared, np.int64), size, left, left_size, row, place, length)
        hit = far >= 0
        return pa.table({"row": row[hit], "place": (place - far)[hit], "end": (place - near + length)[hit]})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remaining bytes of each text, as counts and a hash."""
    for batch in batches:
        spans = batch.column("spans")
        out = []
        for i, text in enumerate(text_bytes(batch.column("text"))):
            found, kept, at, removed = spans[i].values, [], 0, 0
            merged: list[list[int]] = []
            if found is not None and len(found):
                pairs = sorted(zip(longs(found.field("place")).tolist(), np.minimum(longs(found.field("end")), len(text)).tolist()))
                for s, e in pairs:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
            for s, e in merged:
                kept.append(text[at:s])
                removed += e - s
                at = e
            kept.append(text[at:])
            out.append((len(text), removed, len(merged), hashlib.sha256(b"".join(kept)).hexdigest(), [s for s, _ in merged], [e for _, e in merged]))
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        arrays = [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"])


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends) of every document; spans are byte ranges."""
    texts = keyed(docs, "text").filter("_row is not null")  # the filter makes both uses below the same exchange
    marked = staged(marks(texts, length, gram))
    sort = marked.filter("kind = 0")
    counts = sort.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hot"), 1)).alias("hot")).first()
    parts = max(12, math.ceil((counts["n"] + counts["hot"] * (length - gram)) / PARTITION))
    places = sort.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("place", "gram", "hot")).alias("found"))  # of one document
    runs = texts.select("_row", "text").join(places, "_row").mapInArrow(_runs(length, gram, parts), RUNS)
    sorted_spans = runs.groupBy("part").applyInArrow(_merged(length, gram), "row long, place long, end long")
    spans = marked.filter("kind = 1").select("row", "place", "end").unionByName(sorted_spans)
    by_row = spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("place", "end")).alias("spans"))  # of one document
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"
    return texts.join(by_row, "_row", "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return removed_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
