"""Subword lattice language model: the marginal probability of a text over all its segmentations.

The pieces and their first scores come from an existing public vocabulary.  A word, written with the blank before it, can be
cut into pieces in many ways; its lattice probability is the sum over all of them of the product of the pieces'
probabilities, by the forward recursion in log space.  A blank starts a new word, so the lattice probabilities of all
words sum to one.  Every single byte is a piece, so every word has a probability.

Learning: the vocabulary's scores are ranks, so they give a starting distribution (1 / rank).  ``ROUNDS`` rounds of
expectation maximisation over all different training words, weighted by their counts, give the piece probabilities.
A text's tokens are its words and its end.  A token is the end with the
end's share of the training tokens, and else a word with its lattice probability; a text's score is the sum over its tokens.
So every score is the marginal over all segmentations, whether or not the word was in the training texts.

``word_arcs`` (off) adds arcs from end to end of the lattice for the words of the training texts: their counts, less ``DISCOUNT``
each, are their share, and all that is discounted goes to the lattice, so a token's probability is
``max(c - DISCOUNT, 0) / N + DISCOUNT * V / N * lattice``.

How it runs: documents are read once, in slices.  A slice gives one row with the word numbers of its documents and one
row per different word.  Counts are summed per word, so the recursion runs once per different word of the corpus, not
once per token; answers go back to the slices by word, and each slice adds up its documents.  A frequent word has at
most one row per slice, and no text is shuffled.

Defined cases: null, empty and blank texts are the end piece alone; null ids are training rows (crc32 of the empty text);
repeated rows are documents of their own; without training rows the base probability is log10(1 / 1) per token and the
model keeps its starting distribution; an empty table gives an empty result; other columns are not looked at.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.rows import keyed
from siteweave.llm.words import Words, longs, slices
from siteweave.session import staged

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
SLICE = 8 << 20         # bytes of text whose words are numbered together
VECTOR = 64             # longest word (bytes) that is handled together with others
WORDS_AT_ONCE = 20_000
SMOOTHING = 0.1         # added to every piece's expected count
DISCOUNT = 0.75         # of a training word's count, given to the lattice
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces as byte strings (a blank marks the start of a word), sorted by hash for lookup."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks: dict[bytes, float] = {}
        for number in range(model.get_piece_size()):
            if model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
                continue
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                text, rank = bytes([int(piece[1:-1], 16)]), float(model.get_piece_size())
            else:
                text, rank = piece.replace("▁", " ").encode(), 1.0 - model.get_score(number)
            if b" " not in text[1:]:
                ranks[text] = min(rank, ranks.get(text, math.inf))
        self.pieces = sorted(ranks)
        self.start = np.array([1.0 / (ranks[p] + 1.0) for p in self.pieces])
        self.widest = max(map(len, self.pieces))
        self.number = {p: i for i, p in enumerate(self.pieces)}
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have the same hash")
        self.lengths = np.bincount([len(p) for p in self.pieces], minlength=self.widest + 1)

    @staticmethod
    def _hash(piece: bytes) -> int:
        total = 0
        for b in piece:
            total = ((total + b + 1) * int(_MUL)) & 0xFFFFFFFFFFFFFFFF
        return total

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def lattice(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Arcs of equally long words (one per row): (from, to, rows, pieces), by end and then start."""
        width = words.shape[1]
        x = words.astype(np.uint64) + np.uint64(1)
        by_end: list[list] = [[] for _ in range(width + 1)]
        for i in range(width):
            total = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(width, i + self.widest) + 1):
                total = (total + x[:, j - 1]) * _MUL
                if self.lengths[j - i]:
                    piece = self.find(total)
                    rows = np.flatnonzero(piece >= 0)
                    if len(rows):
                        by_end[j].append((i, j, rows, piece[rows]))
        return [arc for arcs in by_end for arc in arcs]

    def forward(self, arcs: list, n: int, width: int, scores: np.ndarray) -> np.ndarray:
        """Log probability of all ways to each place."""
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, piece in arcs:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + scores[piece])
        return alpha

    def backward(self, arcs: list, n: int, width: int, scores: np.ndarray) -> np.ndarray:
        beta = np.full((width + 1, n), -np.inf)
        beta[width] = 0.0
        for i, j, rows, piece in sorted(arcs, key=lambda a: (-a[0], -a[1])):
            beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + scores[piece])
        return beta

    def long_arcs(self, word: bytes) -> list[list[tuple[int, int]]]:
        """Of one long word: for each place, the (start, piece) of the pieces that end there."""
        by_end: list[list] = [[] for _ in range(len(word) + 1)]
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.widest) + 1):
                piece = self.number.get(word[i:j])
                if piece is not None:
                    by_end[j].append((i, piece))
        return by_end

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Word numbers with their bytes as a matrix, by length; long words one by one, without a matrix."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for width in np.unique(size).tolist():
            at = np.flatnonzero(size == width)
            for s in range(0, len(at), WORDS_AT_ONCE):
                some = at[s:s + WORDS_AT_ONCE]
                if width <= VECTOR:
                    yield some, np.frombuffer(b"".join(words[i] for i in some.tolist()), np.uint8).reshape(-1, width)
                else:
                    yield from ((np.array([i]), None) for i in some.tolist())

    def log_probability(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        out = np.empty(len(words))
        for at, matrix in self.groups(words):
            if matrix is not None:
                out[at] = self.forward(self.lattice(matrix), len(at), matrix.shape[1], scores)[-1]
            else:
                out[at] = _long_forward(self.long_arcs(words[int(at[0])]), scores.tolist())[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` times each word."""
        total = np.zeros(len(self.pieces))
        for at, matrix in self.groups(words):
            if matrix is not None:
                arcs, n, width = self.lattice(matrix), len(at), matrix.shape[1]
                alpha, beta = self.forward(arcs, n, width, scores), self.backward(arcs, n, width, scores)
                for i, j, rows, piece in arcs:
                    share = np.exp(alpha[i, rows] + scores[piece] + beta[j, rows] - alpha[width, rows]) * counts[at[rows]]
                    total += np.bincount(piece, share, minlength=len(total))
            else:
                arcs, plain, count = self.long_arcs(words[int(at[0])]), scores.tolist(), float(counts[at[0]])
                alpha = _long_forward(arcs, plain)
                beta = [-math.inf] * len(alpha)
                beta[-1] = 0.0
                for j in range(len(alpha) - 1, 0, -1):
                    for i, piece in arcs[j]:
                        beta[i] = _add(beta[i], beta[j] + plain[piece])
                for j in range(1, len(alpha)):
                    for i, piece in arcs[j]:
                        total[piece] += math.exp(alpha[i] + plain[piece] + beta[j] - alpha[-1]) * count
        return total


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _long_forward(arcs: list, scores: list[float]) -> list[float]:
    alpha = [0.0] + [-math.inf] * (len(arcs) - 1)
    for j in range(1, len(arcs)):
        for i, piece in arcs[j]:
            alpha[j] = _add(alpha[j], alpha[i] + scores[piece])
    return alpha


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pack(*arrays: np.ndarray) -> list[bytes]:
    coder = zstandard.ZstdCompressor(level=3)
    return [coder.compress(a.tobytes()) for a in arrays]


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


SLICES = "slice long, word string, number int, trained long, rows binary, ids binary, held binary, sizes binary, tokens binary"


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of documents (one row with word null) and their different words, numbered."""
    names = [f.split()[0] for f in SLICES.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, ids, held, sizes, hashes = (np.concatenate([p[k] for p in parts]) for k in range(5))
        keys, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        base = np.cumsum([0] + [len(p[4]) for p in parts])
        part = np.searchsorted(base, first, "right") - 1
        words = []
        for p, at in zip(part.tolist(), (first - base[part]).tolist()):
            start, end, raw = parts[p][5:]
            words.append(raw[start[at]:end[at]])
        owner = np.repeat(np.arange(len(rows)), sizes)
        trained = np.bincount(numbers, held[owner] & 1 == 0, minlength=len(keys)).astype(np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)  # sorted words pack well
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        packed = _pack(rows, ids, held, sizes, place[numbers].astype(np.uint32))
        key = int(rows[0])
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, None, None, None, *packed), types)], names)
        text_array = pa.array([words[i] for i in order], pa.binary()).cast(pa.string())
        nothing = [pa.nulls(len(order), pa.binary())] * 5
        for s in range(0, len(order), 100_000):
            n = min(100_000, len(order) - s)
            columns = [pa.array(np.full(n, key)), text_array.slice(s, n), pa.array(np.arange(s, s + n, dtype=np.int32)), pa.array(trained[order][s:s + n])]
            yield pa.RecordBatch.from_arrays([*columns, *[x.slice(s, n) for x in nothing]], names)

    parts, size = [], 0
    for batch, texts in slices(batches):
        w = Words(texts)
        ids = longs(batch.column("doc_id").fill_null(0))
        missing = np.array(batch.column("doc_id").is_null())
        held = np.array(batch.column("held_out").to_numpy(zero_copy_only=False), np.uint8)
        raw = w.data.tobytes()
        parts.append((longs(batch.column("_row")), ids, held | missing.astype(np.uint8) << 1, w.count.astype(np.int64), w.hash, w.start.astype(np.int32), w.end.astype(np.int32), raw))
        size += sum(map(len, texts))
        if size >= SLICE:
            yield from emit(parts)
            parts, size = [], 0
    if parts:
        yield from emit(parts)


def held_out() -> F.Column:
    """Documents the model may not learn from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def learn(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, from the counts (word, c) of the training texts."""
    known = vocabulary(path)
    scores = np.log(known.start / known.start.sum())
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(scores)  # one number per piece of the vocabulary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = vocabulary(path)
            total = np.zeros(len(own.pieces))
            for batch in batches:
                texts = [b" " + t for t in batch.column("word").cast(pa.binary()).to_pylist()]
                total += own.expected(texts, longs(batch.column("c")).astype(float), shared.value)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

        found = words.filter("c > 0").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()  # at most one row per piece
        uses = np.full(len(known.pieces), SMOOTHING)
        uses[found["piece"].to_numpy(np.int64)] += found["uses"].to_numpy(float)
        scores = np.log(uses / uses.sum())
    return scores


def token_score(lattice: np.ndarray, n: int, ends: int) -> np.ndarray:
    """log10 probability of words with log lattice probability ``lattice``; ``n``: training tokens, ``ends`` of them ends.

    Without training tokens, words and the end share the probability equally.  Where no training text has a word, a word counts
    as one token more, so it has a probability.
    """
    return (lattice + math.log(word_share(n, ends))) / math.log(10)


def word_share(n: int, ends: int) -> float:
    if not n:
        return 0.5
    return (n - ends) / n if n > ends else 1 / (n + 1)


def arc_score(c: np.ndarray, lattice: np.ndarray, n: int, v: int) -> np.ndarray:
    """The same with arcs for training words; ``c``: the word's training count, ``v``: distinct training tokens."""
    if not n:
        return (lattice - math.log(2)) / math.log(10)
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(c - DISCOUNT, 0) / n)
    return np.logaddexp(own, math.log(DISCOUNT * v / n) + lattice) / math.log(10)


def scores(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, word_arcs: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    path = path or vocabulary_path()
    rows = keyed(docs, "text").withColumn("held_out", held_out())
    table = staged(rows.select("_row", "doc_id", "held_out", "text").mapInArrow(_sliced, SLICES))
    listed = table.filter("word is not null").select("slice", "word", "number", "trained")
    words = staged(listed.groupBy("word").agg(F.sum("trained").alias("c")))
    ends = docs.select("doc_id").filter(~held_out()).count()
    sums = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0)
    pieces = learn(words, path, rounds)
    if word_arcs and n:
        end = math.log10(max(ends - DISCOUNT, 0.25) / n)
    else:
        end = math.log10(1 - word_share(n, ends))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts = [b" " + t for t in batch.column("word").cast(pa.binary()).to_pylist()]
            lattice = own.log_probability(texts, shared.value)
            found = arc_score(longs(batch.column("c")), lattice, n, v) if word_arcs else token_score(lattice, n, ends)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(found)], ["word", "c", "score"])

    answers = listed.select("slice", "word", "number").join(words.mapInArrow(score, "word string, c long, score double"), "word").select(F.col("slice").alias("of"), "number", "c", "score")

    def add(documents: pa.Table, known: pa.Table) -> pa.Table:
        size = known.num_rows
        base, model, seen = np.zeros(size), np.zeros(size), np.zeros(size)
        at = known.column("number").to_numpy()
        c = known.column("c").to_numpy()
        base[at], model[at], seen[at] = np.log10((c + 1) / (n + v + 1)), known.column("score").to_numpy(), c > 0
        row = documents.to_pylist()[0]
        ids, held, sizes = _unpack(row["ids"], np.int64), _unpack(row["held"], np.uint8), _unpack(row["sizes"], np.int64)
        tokens = _unpack(row["tokens"], np.uint32)
        owner = np.repeat(np.arange(len(ids)), sizes)
        total = [np.bincount(owner, x[tokens], minlength=len(ids)) for x in (base, model, seen)]
        return pa.table({
            "doc_id": pa.array(ids, mask=held & 2 > 0), "held_out": pa.array(held & 1 > 0), "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(total[2].astype(np.int64) + (ends > 0)), "train_tokens": pa.array(np.full(len(ids), n)),
            "base_score": pa.array(total[0] + math.log10((ends + 1) / (n + v + 1))), "score": pa.array(total[1] + end),
        })

    documents = table.filter("word is null").select("slice", "ids", "held", "sizes", "tokens")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return documents.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(add, schema)


def report(docs: DataFrame) -> DataFrame:
    return scores(docs)
