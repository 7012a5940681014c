"""Word shingles of Arrow string columns as sorted 64-bit hashes, straight from the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from geoloom.llm.arrow import emptied_after_tasks, pieces, utf8

AT_ONCE = 1 << 20            # bytes worked on at once; a longer text stands alone
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = emptied_after_tasks({})


def _power(n: int) -> np.ndarray:
    """``BASE`` to the powers 0 to n - 1, modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        p = np.full(max(n, AT_ONCE), BASE, np.uint64)
        p[0] = 1
        _powers["up"] = np.multiply.accumulate(p)
    return _powers["up"][:n]


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of other than ASCII white space, A-Z in lower case), and each row's range of them.

    A word's hash is that of its bytes as a polynomial, by differences of one running sum.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = np.unique(offsets[:-1])
    cut = cut[cut < n]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    stop = np.zeros(n + 1, bool)
    stop[1:-1] = inside[:-1] & ~inside[1:]
    stop[cut[cut > 0]] |= inside[cut[cut > 0] - 1]
    stop[n] = inside[-1]
    ends = np.flatnonzero(stop)
    up = _power(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    # scaled to one common power, so that equal words at different places agree
    value = (total[ends] - total[starts]) * up[n - starts]
    h = mix(value * _inverse(n) + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


_inverses: dict[int, np.uint64] = emptied_after_tasks({})


def _inverse(n: int) -> np.uint64:
    """The inverse of ``BASE`` to the power n, modulo 2^64."""
    if n not in _inverses:
        if len(_inverses) > 100_000:
            _inverses.clear()
        _inverses[n] = np.uint64(pow(int(BASE), -n, 1 << 64))
    return _inverses[n]


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles of ``words`` words, rising; a text of fewer words has all of them as one, none has none."""
    data, offsets = utf8(texts)
    for a, b in pieces(offsets, AT_ONCE):
        h, rows = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        long = len(h) - words + 1
        s = np.zeros(max(long, 0), np.uint64)
        for k in range(words):
            s = mix(s * np.uint64(3) + h[k:k + len(s)] + np.uint64(k + 1))
        for x, y in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if y - x >= words:
                yield np.unique(s[x:y - words + 1])
            elif y > x:
                one = np.array([np.uint64(y - x)], np.uint64)      # the number of words sets it apart from full shingles
                for k in range(x, y):
                    one = mix(one * np.uint64(5) + h[k] + np.uint64(11))
                yield one
            else:
                yield np.empty(0, np.uint64)
