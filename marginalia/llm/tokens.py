"""Words of whole Arrow string columns as 64-bit hashes, without a Python object for each word.

A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix sums over a slice of the
column's buffer and then mixed. Slices are cut between words, so memory is bounded by SLICE bytes
or the longest word, whatever the length of a text. Two words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words between white space, letters A-Z folded: the bytes that part words are 9 to 13 and 32.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE * 2), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts have length 0."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words begin: one entry more than texts)."""
    begin, stop = int(offsets[0]), int(offsets[-1])
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at = begin
    while at < stop:
        end = min(at + SLICE, stop)
        while end < stop and in_word[data[end]]:  # on to the end of the word
            gap = np.nonzero(~in_word[data[end : end + 4096]])[0]
            end = end + int(gap[0]) if len(gap) else min(end + 4096, stop)
        raw = data[at:end]
        n = end - at
        inside = in_word[raw]
        fresh = np.zeros(n + 1, bool)
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        fresh[own] = True
        fresh[0] = fresh[n] = True
        starts, ends = inside.copy(), inside
        starts[1:] &= ~inside[:-1] | fresh[1:-1]
        closed = np.ones(n, bool)
        closed[:-1] = ~inside[1:] | fresh[1:-1]
        first, last = np.nonzero(starts)[0], np.nonzero(ends & closed)[0] + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((FOLD[raw].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * powers(INVERSE, n)[first]))
        places.append(first + at)
        at = end
    where = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(where, offsets)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= np.uint64(BASE)
        out += words[i : i + n]
    return mixed(out + np.uint64(size))


def inner_windows(bounds: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """For each window of `size` words over a batch: whether it lies within one text."""
    ok = np.ones(max(n_words - size + 1, 0), bool)
    ends = bounds[1:-1]
    for i in range(1, size):  # windows that begin up to size - 1 words before a text's end
        hit = ends - i
        ok[hit[(hit >= 0) & (hit < len(ok))]] = False
    return ok
