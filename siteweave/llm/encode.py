"""Encoding whole texts with a public word tokenizer, each different unit once per worker.

The tokenizer never lets a token cross white space, nor a border between a plain letter (a-z or a Latin-1 letter) and
an ASCII mark other than the apostrophe.  So the ids of a text are those of the units between such borders, in order.
Units of plain letters are encoded many to a call; the end of each shows in its last piece.  All others go into one
batch call.  Texts that hold the start of a special token are encoded as they are.  A worker process keeps the ids of
the last units it has seen, up to a fixed number; units are told apart by 64-bit hashes (see ``words``).
"""

import os
from itertools import chain

import numpy as np

from siteweave.llm.words import SEPARATOR, Words

KEPT_WORDS = 500_000     # units whose ids a worker keeps (about 40 bytes each)
JOINED = 64              # units encoded in one string
CALL = 512               # strings encoded in one call, which bounds what the tokenizer holds at once
TOKENIZER = "word_bpe_49k.json"
_encoders: dict[str, "Encoder"] = {}

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LATIN = np.zeros(256, bool)   # second bytes of letters U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False   # the multiplication and division signs


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to plain letters."""
    found = _ASCII_LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    found[lead] = found[lead + 1] = True
    return found


class Units(Words):
    """The units of texts."""

    def bounds(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap, letter, mark = SEPARATOR[block], _letters(block), _MARK[block]
        first, last = ~gap, ~gap
        first[1:] &= gap[:-1] | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        last[:-1] &= gap[1:] | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        return np.flatnonzero(first), np.flatnonzero(last) + 1


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of ranges of the given sizes, one range behind another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Encoder:
    """Ids of texts by a tokenizers file whose pieces end words with ``</w>``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for piece, number in self.tokenizer.get_vocab().items():
            self.ends[number] = piece.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)      # sorted hashes of the known units
        self.offsets = np.zeros(0, np.int64)    # where their ids begin in the pool
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind another, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), CALL):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + CALL], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units [start, end) of ``data``, one behind another, and how many each has."""
        size = end - start
        strange = np.r_[0, np.cumsum(~_letters(data))]
        lettered = strange[end] == strange[start]
        sizes = np.zeros(len(start), np.int64)
        parts = []
        plain = np.flatnonzero(lettered)
        if len(plain):
            gathered = np.full(int(size[plain].sum()) + len(plain), 0x20, np.uint8)
            to = np.cumsum(size[plain] + 1) - size[plain] - 1
            gathered[_gather(to, size[plain])] = data[_gather(start[plain], size[plain])]
            raw, cuts = gathered.tobytes(), [*to[::JOINED].tolist(), len(gathered)]
            ids, _ = self._batch([raw[a:b - 1].decode() for a, b in zip(cuts, cuts[1:])])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(plain):
                sizes[plain] = np.diff(np.r_[-1, last])
                parts.append((plain, ids))
            else:  # another kind of tokenizer file: units one by one
                lettered[:] = False
        other = np.flatnonzero(~lettered)
        if len(other):
            raw = data.tobytes()
            ids, sizes[other] = self._batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[other].tolist(), end[other].tolist())])
            parts.append((other, ids))
        at = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        for units, ids in parts:
            flat[_gather(at[units], sizes[units])] = ids
        return flat, sizes

    def learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Add the units [start, end) of ``data`` by their (sorted, new) hashes."""
        ids, sizes = self.encode_units(data, start, end)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[self.used:self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        offsets = self.used + np.cumsum(sizes) - sizes
        self.keys, self.offsets, self.sizes = np.insert(self.keys, at, keys), np.insert(self.offsets, at, offsets), np.insert(self.sizes, at, sizes)
        self.used += len(ids)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys

    def _places(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        """Units of the texts and where each stands among the known ones."""
        units = Units(texts, lower=True)
        keys, first, inverse = np.unique(units.hash, return_index=True, return_inverse=True)
        new = ~self._known(keys)
        if len(self.keys) + int(new.sum()) > KEPT_WORDS:
            self.clear()
            new[:] = True
        if new.any():
            at = first[new]
            self.learn(keys[new], units.data, units.start[at], units.end[at])
        return units, np.searchsorted(self.keys, keys)[inverse]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of each text."""
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        units, place = self._places([b"" if b"<|" in t else t for t in texts] if special else texts)
        total = np.bincount(units.text, self.sizes[place], minlength=len(texts)).astype(np.int64)
        for i in special:
            total[i] = len(self.plain(texts[i].decode("utf-8", "replace")))
        return total

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind another, and how many each has."""
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        units, place = self._places([b"" if b"<|" in t else t for t in texts] if special else texts)
        sizes = self.sizes[place]
        flat = self.pool[_gather(self.offsets[place], sizes)]
        total = np.bincount(units.text, sizes, minlength=len(texts)).astype(np.int64)
        if special:
            whole = {i: self.plain(texts[i].decode("utf-8", "replace")) for i in special}
            at = np.cumsum(total)
            flat = np.insert(flat, np.repeat(at[special], [len(whole[i]) for i in special]), np.concatenate([whole[i] for i in special]))
            total[special] = [len(whole[i]) for i in special]
        return flat, total

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        flat, sizes = self.flat(texts)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
