"""Words and word shingles straight from Arrow string buffers, with numpy only.

No Python string is made: a column of texts is one byte array with offsets, words are
runs of bytes other than ``[\\x20\\x09-\\x0D]``, and hashes are 64 bits wide.  Work goes in
chunks of about ``CHUNK`` bytes, so memory does not follow the batch size; one text longer
than that makes a chunk of its own.

A word's hash is multilinear: its bytes as 32-bit numbers, and their count, times keys that are
drawn once, summed modulo 2**64, of which the upper half is kept; two such sums with keys of
their own make 64 bits.  Whatever two different words are, the share of keys that let them meet
is 2**-64; no words are alike by their pattern, as they are under a polynomial modulo a power of
two.  Words of more than ``LONG_WORD`` bytes are hashed by keyed BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

#: Longer words are hashed one by one.
LONG_WORD = 128

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Keys of each 8 bytes of a word: of their lower and upper half, for either sum.
LOW_KEY, HIGH_KEY = _rng.integers(0, 2**64, (2, 2, LONG_WORD // 8), dtype=np.uint64)
SIZE_KEY, FIRST_KEY = _rng.integers(0, 2**64, (2, 2), dtype=np.uint64)
LONG_KEY = _rng.bytes(16)
PLACE = _rng.integers(1, 2**63, 5, dtype=np.uint64) | np.uint64(1)
SHORT = _rng.integers(1, 2**63, 5, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (one more at the end)."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    word = ~space[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = off[1:] > off[:-1]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a] = word[a]
    last[b] = word[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    one, two = (np.uint64(first) + size.astype(np.uint64) * np.uint64(key) for first, key in zip(FIRST_KEY, SIZE_KEY, strict=True))
    if not len(starts):
        return one
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    # 8 bytes from any place on; the pad is never part of a word
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(raw),), "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    for t in range(LONG_WORD // 8):
        left = size[live] - 8 * t
        if t:
            live, left = live[left > 0], left[left > 0]
        if not len(live):
            break
        block = blocks[starts[live] + 8 * t]
        part = left < 8
        block[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        a, b = block & low, block >> half
        one[live] += a * LOW_KEY[0, t] + b * HIGH_KEY[0, t]
        two[live] += a * LOW_KEY[1, t] + b * HIGH_KEY[1, t]
    out = mix((one >> half << half) | (two >> half))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].data, digest_size=8, key=LONG_KEY).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` words, and the first of each row; a shorter row with words has one."""
    counts = np.diff(at)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(begin[-1], np.uint64)
    if len(words) >= width:
        whole = words[: len(words) - width + 1] * PLACE[0]
        for k in range(1, width):
            whole += words[k : len(words) - width + 1 + k] * PLACE[k]
        whole = mix(whole)
        keep = np.zeros(len(words) + 1, np.int64)
        long = counts >= width
        np.add.at(keep, at[:-1][long], 1)
        np.add.at(keep, at[1:][long] - width + 1, -1)
        inside = np.cumsum(keep[: len(whole)]) > 0
        place = np.zeros(begin[-1] + 1, np.int64)
        np.add.at(place, begin[:-1][long], 1)
        np.add.at(place, begin[1:][long], -1)
        out[np.cumsum(place[:-1]) > 0] = whole[inside]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[at[r] : at[r + 1]]
        out[begin[r]] = mix((w * PLACE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + SHORT[len(w)])[0]
    return out, begin


def shingle_sets(column: pa.Array, wanted: np.ndarray | None = None, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row, or of each wanted one; A-Z are lower-cased."""
    if wanted is not None:
        rows = np.flatnonzero(wanted)
        column = column.take(pa.array(rows))
    for i, j, raw, off in chunks(column):
        raw = LOWER[raw]
        starts, ends, at = spans(raw, off)
        hashes, begin = shingle_hashes(word_hashes(raw, starts, ends), at, width)
        for r in range(j - i):
            h = np.sort(hashes[begin[r] : begin[r + 1]])
            if len(h) > 1:
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
            yield (i + r if wanted is None else int(rows[i + r])), h


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed integers."""
    a = mix(h + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    b = mix(h ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
