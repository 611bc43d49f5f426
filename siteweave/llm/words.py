"""Words and shingles of many texts at once, as numpy arrays.

Texts are UTF-8 bytes.  A word is ``[^\\x20\\x09-\\x0D]+``; those bytes never occur inside a longer UTF-8
sequence, so bytes and characters give the same words.  Words and shingles are compared by 64-bit hashes: a polynomial
hash up to ``LONG`` bytes, and BLAKE2b from there on, where regular texts (Thue-Morse words, say) of 1,024 letters and
more would cancel out in a polynomial modulo 2**64.  Among n different pieces two meet with a probability of about
n**2 / 2**65, so 10**8 different pieces within one comparison give one chance in 3,700.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes hashed at once; bounds the working arrays, not the texts
LONG = 256       # bytes from which a piece is hashed by BLAKE2b

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose bits all depend on all bits of the input."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``between`` gives the hash of any byte range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[1], out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end); equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[0][start] + (end - start).astype(np.uint64))


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the pieces [start, end) of ``data``, safe for long regular pieces."""
    found = between(prefix(data), start, end)
    for i in np.flatnonzero(end - start >= LONG).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]], digest_size=8).digest(), "little")
    return found


def _cut(data: np.ndarray, start: int) -> int:
    """Where the block from ``start`` ends: at a separator, so that no word is split."""
    end = start + BLOCK
    while end < len(data):
        found = np.flatnonzero(SEPARATOR[data[end:end + 4096]])
        if len(found):
            return end + int(found[0])
        end += 4096
    return len(data)


class Words:
    """Words of a list of texts: byte ranges in ``data``, hashes, and the text each belongs to."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        self.texts = len(texts)
        self.data = LOWER[raw] if lower else raw
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.cumsum(np.r_[0, lengths[:-1] + 1]) if len(texts) else np.zeros(0, np.int64)
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(self.data):
            stop = _cut(self.data, at)
            block = self.data[at:stop]
            first, last = self.bounds(block)
            hashes.append(piece_hashes(block, first, last))
            starts.append(first + at)
            ends.append(last + at)
            at = stop
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.texts)
        self.first = np.r_[0, np.cumsum(self.count)[:-1]] if self.texts else self.count

    def bounds(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a block begin and end."""
        edge = np.diff(np.r_[True, SEPARATOR[block], True].astype(np.int8))
        return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)

    def __len__(self) -> int:
        return len(self.hash)

    def sequence_hash(self, first: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each of ``first``."""
        total = np.full(len(first), n, np.uint64)
        for j in range(n):
            total = mix(total ^ self.hash[first + j]) * _BASE + _U(j)
        return mix(total)

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``k``-word shingles of all texts, by text and hash: (hashes, offsets by text).

        A text with fewer words has its whole sequence as its only shingle; one without words has none.
        """
        hashes, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if len(self) >= k:
            first = np.flatnonzero(self.text[:len(self) - k + 1] == self.text[k - 1:])
            hashes.append(self.sequence_hash(first, k))
            texts.append(self.text[first])
        for n in range(1, k):
            short = np.flatnonzero(self.count == n)
            hashes.append(self.sequence_hash(self.first[short], n))
            texts.append(short)
        h, t = np.concatenate(hashes), np.concatenate(texts)
        order = np.lexsort((h, t))
        h, t = h[order], t[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        h, t = h[new], t[new]
        return h, np.searchsorted(t, np.arange(self.texts + 1))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row slices of about ``limit`` bytes of text (a longer text is a slice of its own, and whole)."""
    for batch in batches:
        texts = text_bytes(batch.column(text))
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
