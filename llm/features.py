"""Text statistics and hashed n-gram features of whole texts, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import LOWER, mix, text_chunks, windows, word_hashes, words

#: Hashed dimensions; word unigrams, word bigrams and byte trigrams share them.
DIMENSIONS = 2048
DENSE = 12
GRAM_BYTES = 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True


def _per_text(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending positions lie in each text."""
    return np.diff(np.searchsorted(positions, offsets))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where the key occurs more than once with its owner."""
    if not len(keys):
        return np.zeros(0, bool)
    _, inverse, counts = np.unique(mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _later(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where the key has occurred before with its owner."""
    if not len(keys):
        return np.zeros(0, bool)
    _, first = np.unique(mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    return out


class Chunk:
    """One chunk of texts with its words; every count is an array with one entry for each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.stops, self.of = words(data, offsets)
        self.texts = len(offsets) - 1
        self.n_words = np.diff(self.of)
        self.owner = np.repeat(np.arange(self.texts), self.n_words)
        self.hashes = word_hashes(data, self.starts, self.stops)

    def word_chars(self) -> np.ndarray:
        points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return _sums(points[self.stops] - points[self.starts], self.of)

    def count(self, table: np.ndarray) -> np.ndarray:
        return _per_text(np.flatnonzero(table[self.data]), self.offsets)

    def within(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``size`` words inside texts, and the index of their first word."""
        grams = windows(self.hashes, size)
        inside = np.flatnonzero(self.owner[: len(grams)] == self.owner[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
        return grams[inside], inside

    def repeat_words(self, size: int = 3) -> np.ndarray:
        grams, at = self.within(size)
        at = at[_repeats(grams, self.owner[at])]
        covered = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
        return _sums(np.cumsum(covered[:-1]) > 0, self.of)

    def dup_lines(self) -> np.ndarray:
        breaks = np.flatnonzero(self.data == 10)
        starts = np.union1d(self.offsets[:-1], breaks + 1)
        owner = np.searchsorted(self.offsets, starts, "right") - 1
        inside = (owner < self.texts) & (starts < self.offsets[-1])
        starts, owner = starts[inside], owner[inside]
        if not len(starts):
            return np.zeros(self.texts, np.int64)
        last = np.minimum(np.append(starts[1:], self.offsets[-1]), self.offsets[owner + 1])
        after = np.searchsorted(breaks, starts)
        stop = last.copy()
        has = after < len(breaks)
        stop[has] = np.minimum(last[has], breaks[after[has]])
        worded = np.searchsorted(self.starts, stop) > np.searchsorted(self.starts, starts)
        starts, stop, owner = starts[worded], stop[worded], owner[worded]
        later = _later(word_hashes(self.data, starts, stop), owner)
        return np.bincount(owner[later], minlength=self.texts)

    def dense(self) -> np.ndarray:
        """Rates of a text, all between 0 and about 1."""
        n, size = np.maximum(self.n_words, 1), np.maximum(np.diff(self.offsets), 1)
        letters = self.word_chars()
        distinct = np.bincount(self.owner[~_later(self.hashes, self.owner)], minlength=self.texts)
        return np.stack(
            [
                np.log1p(self.n_words) / 10,
                letters / n / 20,
                self.count(_SYMBOL) / n,
                self.count(_UPPER) / size,
                self.count(_DIGIT) / size,
                self.count(_PUNCT) / n,
                self.dup_lines() / np.maximum(1, _per_text(np.flatnonzero(self.data == 10), self.offsets) + 1),
                self.repeat_words() / n,
                distinct / n,
                (self.n_words < 20).astype(float),
                (self.n_words == 0).astype(float),
                np.minimum(1, _per_text(np.flatnonzero(self.data == 10), self.offsets) / n * 5),
            ],
            1,
        ).astype(np.float32)

    def hashed(self, dimensions: int = DIMENSIONS) -> np.ndarray:
        """Square roots of hashed counts, of unit length: words, word pairs and byte trigrams, lower case."""
        lower = LOWER[self.data]
        hashes = word_hashes(lower, self.starts, self.stops)
        pairs = windows(hashes, 2)
        inside = self.owner[: len(pairs)] == self.owner[1:] if len(pairs) else np.zeros(0, bool)
        counts = np.zeros((self.texts, dimensions))

        def add(keys: np.ndarray, of: np.ndarray, salt: int, into: np.ndarray) -> None:
            slot = (mix(keys + np.uint64(salt * 0x1234567)) % np.uint64(dimensions)).astype(np.int64)
            into += np.bincount(of * dimensions + slot, minlength=into.size).reshape(into.shape)

        for keys, of, salt in ((hashes, self.owner, 1), (pairs[inside], self.owner[: len(pairs)][inside], 2)):
            own = np.zeros_like(counts)
            add(keys, of, salt, own)
            counts += np.sqrt(own)
        own = np.zeros_like(counts)
        for a in range(0, max(0, len(lower) - 2), GRAM_BYTES):  # a long text's trigrams in runs
            part = lower[a : a + GRAM_BYTES + 2].astype(np.uint64)
            owner = np.searchsorted(self.offsets, np.arange(a, a + len(part)), "right") - 1
            same = owner[:-2] == owner[2:]
            grams = (part[:-2] << np.uint64(16)) | (part[1:-1] << np.uint64(8)) | part[2:]
            add(grams[same], owner[:-2][same], 3, own)
        counts += np.sqrt(own)
        return (counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def features(self) -> np.ndarray:
        return np.concatenate([self.dense(), self.hashed()], 1)


def chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, Chunk]]:
    """Chunks of bounded bytes and of at most 512 texts."""
    at = 0
    while at < len(texts):
        for first, data, offsets in text_chunks(texts[at : at + 512], limit):
            yield at + first, Chunk(data, offsets)
        at += 512
