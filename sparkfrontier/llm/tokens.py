"""Hashes of words and word windows over whole batches of texts, in numpy.

A word's hash is a polynomial over its UTF-8 bytes, taken from prefix sums modulo 2**64; a window's hash is a polynomial over
the hashes of its words. Both end in a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut at white space.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1 << 40, 1 << 63, 256, dtype="u8") | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, "u8"), np.full(size, pow(base, -1, 1 << 64), "u8")
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of word windows, and their inverses."""
    return _power(_Q, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _hash_chunk(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends; breaks: positions where a word can't go on (starts of texts)."""
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[breaks] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _power(_P, len(data) + 1)
    total = np.zeros(len(data) + 1, "u8")
    np.add.accumulate(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype("u8")), starts, ends


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each row; null rows have no words."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi == lo:
            yield from ((i, np.zeros(0, "u8")) for i in range(row, last))
        elif last > row + 1 or hi - lo <= CHUNK:
            hashes, starts, _ = _hash_chunk(data[lo:hi], offsets[row:last] - lo)
            at = np.searchsorted(starts, offsets[row : last + 1] - lo)
            for i in range(row, last):
                yield i, hashes[at[i - row] : at[i - row + 1]]
        else:  # one long text: cut where white space is
            parts = []
            while lo < hi:
                end = min(hi, lo + CHUNK)
                if end < hi:
                    spaces = np.flatnonzero(_SPACE[data[lo:end]])
                    more = end
                    while not len(spaces) and more < hi:  # a word longer than a chunk
                        more = min(hi, more + CHUNK)
                        spaces = np.flatnonzero(_SPACE[data[lo:more]])
                    end = lo + int(spaces[-1]) + 1 if len(spaces) else hi
                parts.append(_hash_chunk(data[lo:end], np.zeros(1, "i8"))[0])
                lo = end
            yield row, np.concatenate(parts)
        row = last


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words; a shorter text that has words is one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, "u8")
    k = min(k, n)
    up, down = _power(_Q, n + 1)
    total = np.zeros(n + 1, "u8")
    np.add.accumulate(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + np.uint64(k))
