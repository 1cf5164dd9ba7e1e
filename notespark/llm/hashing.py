"""Vectorised 64-bit word and shingle hashes over Arrow string batches.

All words of a batch are hashed by a handful of numpy passes over the raw UTF-8 buffer (a polynomial prefix sum modulo 2^64,
then a finaliser), so no Python code runs per word. The work arrays are bounded: a batch is cut into segments of about
SEGMENT bytes at white space, and long texts are cut the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_M1, _M2, _PRIME = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

#: Byte classes that separate words. Bytes from 128 on always belong to words.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, 2 * SEGMENT)
        inverse = pow(_PRIME, -1, 1 << 64)
        for name, base in (("p", _PRIME), ("i", inverse)):
            t = np.full(size, base & (2**64 - 1), np.uint64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["p"], _powers["i"]


def _segment_words(b: np.ndarray, starts: np.ndarray, separators: np.ndarray, codes: np.ndarray = _BYTE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in the bytes b; a word also ends where a text starts."""
    word = ~separators[b]
    edge = np.empty(len(b) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    first = np.flatnonzero(edge[:-1] & word)
    last = np.flatnonzero(edge[1:] & word) + 1
    inner = starts[(starts > 0) & (starts < len(b))]
    inner = inner[word[inner] & word[inner - 1]]
    if len(inner):
        first, last = np.union1d(first, inner), np.union1d(last, inner)
    p, inverse = _power_tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(codes[b] * p[: len(b)], out=sums[1:])
    return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)), first


def word_hashes(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased if lower), text after text, and the offsets of the texts in them. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    hashes, places = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + SEGMENT, end)
        if stop < end:  # cut where a text starts or before white space, so that no word is cut
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:
                limit = int(offsets[k + 1])
                cut = np.flatnonzero(separators[raw[at + 1 : stop]])
                if len(cut):
                    stop = at + 1 + int(cut[-1])
                else:
                    more = np.flatnonzero(separators[raw[stop:limit]])
                    stop = stop + int(more[0]) if len(more) else limit
        lo, hi = np.searchsorted(offsets, [at, stop])
        h, first = _segment_words(raw[at:stop], offsets[lo:hi] - at, separators, _BYTE_LOWER if lower else _BYTE)
        hashes.append(h)
        places.append(first + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


_STEPS = mix(np.arange(11, 75, dtype=np.uint64) * np.uint64(_PRIME)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row of one text; none where the text has fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1] * _STEPS[0]
    for i in range(1, n):
        out = out + words[i : len(words) - n + 1 + i] * _STEPS[i]
    return mix(out)


def short_text_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a whole text of fewer words than a shingle; it also depends on their number."""
    return mix((words * _STEPS[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _STEPS[32 + len(words)])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: pa.Array, n: int, separators: np.ndarray = SPACES, short: bool = True):
    """For each text its sorted distinct shingle hashes; a text of 1 to n-1 words is one shingle if short, else none."""
    words, offsets = word_hashes(texts, separators)
    every = shingle_hashes(words, n)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            yield distinct(every[a : b - n + 1])
        elif b > a and short:
            yield short_text_hash(words[a:b])
        else:
            yield np.zeros(0, np.uint64)
