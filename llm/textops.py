"""Word and shingle hashing over whole Arrow batches with numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are single ASCII bytes, so words can be cut on
the UTF-8 bytes. Texts are handled in chunks of bounded size; a single text longer than the chunk
makes a chunk of its own, so memory follows the largest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, _M, 256, dtype=np.uint64)
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if "up" not in _POW or len(_POW["up"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out, have = np.ones(n, np.uint64), 1
            while have < n:
                take = min(have, n - have)
                out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
                have += take
            _POW[key] = out
    return _POW["up"][:n], _POW["down"][:n]


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of first text, bytes, offsets) of runs of texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    gap = SEPARATOR[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets < len(data))]
    before[inner] = True
    ends = offsets[offsets > 0] - 1
    after[ends] = True
    starts = np.flatnonzero(~gap & before)
    stops = np.flatnonzero(~gap & after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; a long text is hashed in runs of words of about CHUNK_BYTES."""
    if len(data) <= 2 * CHUNK_BYTES:
        return _hash_run(data, starts, stops)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + CHUNK_BYTES, "right")))
        first = starts[at]
        out[at:end] = _hash_run(data[first : stops[end - 1]], starts[at:end] - first, stops[at:end] - first)
        at = end
    return out


def _hash_run(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts])


_SLOT = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (across text borders too: cut them off by position)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 16:
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += hashes[k : k + n] * _SLOT[k]
    else:
        up, down = _powers(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        total = (sums[size:] - sums[: n]) * down[:n]
    return mix(total + np.uint64(size))


def shingle_sets(texts: pa.Array, size: int = 5, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(index, ascending distinct shingle hashes) of each text; with fewer words, the whole sequence is one."""
    for first, data, offsets in text_chunks(texts):
        if lower:
            data = LOWER[data]
        starts, stops, of = words(data, offsets)
        hashes = word_hashes(data, starts, stops)
        grams = windows(hashes, size)
        for k in range(len(offsets) - 1):
            a, b = of[k], of[k + 1]
            if b - a >= size:
                own = np.sort(grams[a : b - size + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                own = windows(hashes[a:b], int(b - a))
            else:
                own = np.zeros(0, np.uint64)
            yield first + k, own
