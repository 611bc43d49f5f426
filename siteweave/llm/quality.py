"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and keeps the measurements and one bit per failed rule.  A policy is a
named, versioned set of rules, stored as a mask: a document is kept if no bit of the mask is set.  Policies, comparisons
of policies and ablations therefore need no text: they are bitwise operations on the ledger.

Base measurements, of the words ``[^\\x20\\x09-\\x0D]+`` of a whole text: n_words; word_chars (code points in words); n_symbols
(characters of ``#*$%&|<>``); n_dup_lines (lines with a word that equal an earlier line); n_repeat_words (words in 8-word
windows found twice or more in the text, the first included).

Defined cases: null, empty and blank texts have 0 everywhere and fail the rule on length alone; repeated rows and null
ids are judged like any other row; an empty table gives an empty ledger; other columns are not looked at.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.words import Words, mix, piece_hashes, slices

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A rule by its bit; ``fails`` is a SQL condition on the measurements."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A named version of what must not fail."""

    name: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "many_words", "n_words > 100000"),
)
POLICIES = (
    Policy("base", ("few_words", "repeated_passages")),
    Policy("web-1", ("few_words", "repeated_passages", "symbols", "repeated_lines", "short_words", "long_words")),
    Policy("web-2", ("few_words", "repeated_passages", "symbols", "repeated_lines", "short_words", "long_words", "many_words")),
)
CURRENT = "web-1"


def mask_of(policy: str, rules: tuple[Rule, ...] = RULES, policies: tuple[Policy, ...] = POLICIES) -> int:
    """The bits of a policy's rules."""
    names = next(p.rules for p in policies if p.name == policy)
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in names)


def _repeated(words: Words) -> np.ndarray:
    """By text: words inside 8-word windows that occur twice or more in it."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(words.texts, np.int64)
    first = np.flatnonzero(words.text[:n - WINDOW + 1] == words.text[WINDOW - 1:])
    key = mix(words.sequence_hash(first, WINDOW) ^ mix(words.text[first].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(first), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first[again], 1)
    np.add.at(steps, first[again] + WINDOW, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return np.bincount(words.text[covered], minlength=words.texts)


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """By text: lines with a word, and how many of them equal an earlier one."""
    data = words.data
    breaks = np.flatnonzero(data == 10)  # the texts are joined by line breaks, so none spans two
    start, end = np.r_[0, breaks + 1], np.r_[breaks, len(data)]
    has_word = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end = start[has_word], end[has_word]
    text = np.searchsorted(words.text_start, start, "right") - 1
    key = mix(piece_hashes(data, start, end) ^ mix(text.astype(np.uint64) + np.uint64(1)))
    _, seen = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[seen] = False
    return np.bincount(text, minlength=words.texts), np.bincount(text[later], minlength=words.texts)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    for batch, texts in slices(batches):
        words = Words(texts, lower=False)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]  # code points up to each byte
        chars = np.bincount(words.text, points[words.end] - points[words.start], minlength=len(texts)).astype(np.int64)
        marks = np.r_[0, np.cumsum(symbol[words.data])]
        symbols = marks[words.text_start + lengths] - marks[words.text_start]
        lines, dup_lines = _lines(words)
        columns = (words.count, chars, symbols, dup_lines, _repeated(words), lines)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns]], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, measurements, fail_bits) of every document: one pass, no shuffle."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measured, schema)
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return found.withColumn("fail_bits", bits)


def passes(mask: int, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def judged(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger entries with one column ``kept_<policy>`` per policy version."""
    return entries.withColumns({"kept_" + p.name.replace("-", "_"): passes(mask_of(p.name, rules, policies)) for p in policies})


def ablation(entries: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule of a policy does: (rule, failed, only_this, kept_without), from one count per bit pattern.

    ``only_this`` documents fail no other rule of the policy, so they would be kept without it.  The counts by pattern (at
    most two to the number of rules, whatever the input) are all that is aggregated.
    """
    mask = mask_of(policy, rules, policies)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in rules if mask >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen])).alias("r")
    spread = patterns.select("pattern", "n", each).select("pattern", "n", "r.rule", "r.bit")
    without = F.col("pattern").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return spread.groupBy("rule").agg(
        F.sum(F.when(F.col("pattern").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def report(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The contract columns, the ledger bits and the verdict of the current policy."""
    kept = passes(mask_of(policy))
    base_failed = ~passes(mask_of("base"))
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"), "n_lines", "fail_bits")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)
),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM again) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT doc_id, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id
),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 100000 THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (fail_bits & 63) = 0 AS kept, n_lines, fail_bits
FROM f
"""
