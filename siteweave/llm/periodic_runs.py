"""Periodic runs: stretches of words that repeat with some period, found online by catchers over dyadic blocks.

``RunCatcher`` reads a stream of words.  On every level l it keeps the blocks of 2**l words that begin at multiples of 2**l.  A
completed block is a catcher: it waits for the windows that begin 2**(l+1) - 1 up to 2**(l+2) - 2 words behind it, and a
window equal to it gives away a possible square with their distance as its period.  Every period belongs to one level, and
the first half of a square of that period contains a whole block of that level, so no square is missed.  Each appended word
completes one window a level, which exactly two catchers wait for, so the search costs O(log n) per word.

A catch is extended to the left and, with each word appended from then on, to the right, as long as words one period apart are
equal (the suffix comparisons).  A stretch as long as its period is a square; adjacent and overlapping catches of one period
belong to the same stretch, and a stretch that a word ends is a run: it reaches as far as its period does.  Of several periods
with the same stretch (multiples of the least) the least counts.

Words are compared by 64-bit hashes (see ``words``), and blocks by hashes built from those of their halves.

``report`` feeds all texts of a slice to one catcher, each behind a word of its own that occurs nowhere else, so no run crosses
texts; a text is never cut.  No shuffle: a document is a row, and memory follows the longest text, not the table.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows, null and
repeated ids are documents of their own; an empty table gives an empty result; other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.text import let
from siteweave.llm.words import Words, mix, slices

LEAST = 12         # words of the shortest run
PIECE = 1 << 18    # words searched at once; bounds the working arrays, not the texts
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_PAIR = _U(0x9E3779B97F4A7C15)


class RunCatcher:
    """Runs of a stream of words (64-bit hashes) with at least ``least`` words and twice their period.

    ``longest``, if given, is a bound on the length of any run in the stream.
    """

    def __init__(self, least: int = LEAST, longest: int | None = None):
        self.least, self.longest = least, longest
        self.x = np.zeros(0, np.uint64)
        self.windows: list[np.ndarray] = []            # by level: hash of the window from each word
        self.open: dict[int, tuple[int, int]] = {}     # period: stretch [a, b) of words equal to the one a period behind, up to the end
        self.closed: dict[tuple[int, int], int] = {}   # (start, end) of a run: its period

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Read further words; returns (end, period) of the first square of each stretch that now has one.

        Squares whose period is a multiple of another's in the same stretch may be left out.
        """
        found = []
        for at in range(0, len(words), PIECE):
            found += self._append(words[at:at + PIECE])
        return found

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of all runs in the words so far, by start and period."""
        found = dict(self.closed)
        for p, (a, b) in self.open.items():
            if b - a >= self._need(p):
                found[a, b + p] = min(p, found.get((a, b + p), p))
        return sorted(((a, e, p) for (a, e), p in found.items()), key=lambda r: (r[0], r[2]))

    def _need(self, p):
        return np.maximum(p, self.least - p)

    def _forward(self, b: int, p: int) -> int:
        """Where words stop being equal to those ``p`` behind them, from ``b``."""
        n, step = len(self.x) - p, 16
        while b < n:
            k = min(step, n - b)
            same = self.x[b:b + k] == self.x[b + p:b + p + k]
            if not same.all():
                return b + int(same.argmin())
            b, step = b + k, step * 2
        return b

    def _back(self, a: int, p: int) -> int:
        step = 16
        while a > 0:
            k = min(step, a)
            same = (self.x[a - k:a] == self.x[a - k + p:a + p])[::-1]
            if not same.all():
                return a - int(same.argmin())
            a, step = a - k, step * 2
        return a

    def _settle(self, p: int, a: int, b: int) -> None:
        """Keep a stretch as open, or as a run if a word has ended it and it is long enough."""
        if b + p == len(self.x):
            self.open[p] = a, b
        elif b - a >= self._need(p):
            self.closed[a, b + p] = min(p, self.closed.get((a, b + p), p))

    def _append(self, words: np.ndarray) -> list[tuple[int, int]]:
        self.x = np.concatenate((self.x, words))
        n, longest = len(self.x), min(len(self.x), self.longest or len(self.x))
        squares = []
        latest: dict[int, tuple[int, int]] = {}
        periodic: list[tuple[int, int, int]] = []   # (start, end, period) of stretches with several periods
        waiting, self.open = self.open, {}

        def note(p: int, a: int, b: int, had: bool) -> None:
            latest[p] = a, b
            if b - a >= p and not had:
                squares.append((a + 2 * p, p))
            if b - a >= 3 * p:
                periodic.append((a, b + p, p))

        for p, (a, b) in waiting.items():
            note(p, a, self._forward(b, p), b - a >= p)
        level = 0
        while 2 * ((2 << level) - 1) <= longest:
            size, near = 1 << level, (2 << level) - 1
            first, last, p = self._catches(level, size, near)
            ending = last + 2 * size + p > n  # the next block's window is not complete
            keep = ending | (last - first + size + 2 * (size - 1) >= self._need(p))
            first, last, p = first[keep], last[keep], p[keep]
            if len(p) and periodic:
                first, last, p = self._primitive(first, last, p, size, periodic)
            for s, e, q in zip(first.tolist(), (last + size).tolist(), p.tolist()):
                known = latest.get(q)
                if known and s < known[1]:
                    continue
                if known:
                    self._settle(q, *known)
                note(q, self._back(s, q), self._forward(e, q), False)
            level += 1
        for p, (a, b) in latest.items():
            self._settle(p, a, b)
        return squares

    def _catches(self, level: int, size: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Catches of the new windows of a level: first and last block of each row of blocks with one period, and the period."""
        n = len(self.x)
        if level == len(self.windows):
            self.windows.append(np.zeros(0, np.uint64))
        old = len(self.windows[level])
        if level == 0:
            new = self.x[old:]
        else:
            half = self.windows[level - 1]
            left = half[old:n - size + 1]
            new = mix(left * _PAIR + half[old + size // 2:old + size // 2 + len(left)])
        hashes = self.windows[level] = np.concatenate((self.windows[level], new))
        place = np.arange(old, len(hashes))
        latest = ((place - near) >> level) << level
        blocks, periods = [], []
        for block in (latest, latest - size):
            some = block >= 0
            t, b = place[some], block[some]
            hit = hashes[t] == hashes[b]
            blocks.append(b[hit])
            periods.append(t[hit] - b[hit])
        s, p = np.concatenate(blocks), np.concatenate(periods)
        order = np.lexsort((s, p))
        s, p = s[order], p[order]
        cut = np.flatnonzero((np.diff(s) != size) | (np.diff(p) != 0))
        if not len(s):
            return s, s, p
        return s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]], p[np.r_[0, cut + 1]]

    def _primitive(self, first, last, p, size, periodic) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leave out most catches inside a stretch whose period divides theirs: they would give the same run again."""
        a, e, q = np.array(sorted(periodic, key=lambda r: (r[0], r[1], -r[2])), np.int64).T  # of equal stretches the least period
        at = np.searchsorted(a, first, "right") - 1
        a, e, q = a[at], e[at], q[at]
        inside = (at >= 0) & (last + size + p <= e) & (p % q == 0) & (p > q) & (e - a >= p + q)
        return first[~inside], last[~inside], p[~inside]


def slice_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of all texts, by text, start and period."""
    n, texts = len(words), words.texts
    stream = np.zeros(n + texts, np.uint64)
    at = np.arange(n) + words.text + 1  # one word of its own before each text
    stream[at] = words.hash
    own = words.first + np.arange(texts)
    stream[own] = mix(np.arange(1, texts + 1, dtype=np.uint64) << _U(32))
    catcher = RunCatcher(longest=int(words.count.max(initial=0)))
    catcher.append(stream)
    found = np.array(catcher.runs(), np.int64).reshape(-1, 3)
    text = np.searchsorted(own, found[:, 0], "right") - 1
    return text, found[:, 0] - own[text] - 1, found[:, 1] - found[:, 0], found[:, 2]


def _collapsed(words: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """Each text's words without those that a run holds behind its first period, joined by blanks."""
    steps = np.zeros(len(words) + 1, np.int64)
    at = words.first[text] + start
    np.add.at(steps, at + period, 1)
    np.add.at(steps, at + length, -1)
    kept = np.cumsum(steps[:-1]) == 0
    size = words.end[kept] - words.start[kept] + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    joined = np.full(total, 0x20, np.uint8)
    place = np.arange(total) + np.repeat(words.start[kept] - (ends - size), size)
    blank = np.zeros(total, bool)
    blank[ends - 1] = True
    joined[~blank] = words.data[place[~blank]]
    raw = joined.tobytes()
    cuts = np.r_[0, np.cumsum(np.bincount(words.text[kept], size, minlength=words.texts).astype(np.int64))].tolist()
    return [raw[a:max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document; ``runs`` is an array of (start, length, period)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words = Words(texts, lower=False)
            text, *columns = slice_runs(words)
            offsets = np.searchsorted(text, np.arange(words.texts + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(offsets), rows)
            collapsed = pa.array(_collapsed(words, text, *columns), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count.astype(np.int64)), runs.cast(RUNS), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where each tenth text, by the hash h of its id, goes on periodically from a word chosen by h."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return let(F.struct(a.alias("a"), p.alias("p")), lambda k: F.array_join(
            F.transform(places, lambda i: F.get(words, F.when(i < k["a"], i).otherwise(k["a"] + (i - k["a"]) % k["p"]).cast("int"))), " "))

    changed = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.when(F.size(w) > 0, planted(w)))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), changed).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The runs of each document in short: their number, the longest, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
