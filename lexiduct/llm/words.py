"""Words, shingles and their 64-bit hashes from Arrow text columns, in numpy.

Texts are handled as UTF-8 bytes straight from the Arrow buffers: a batch is cut
into groups of rows of about a megabyte, A-Z are lowered by a table, and the
words of a whole group are found and hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GROUP_BYTES = 1 << 20
HASH_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that holds True for the bytes in the given ranges, both ends included."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Word bytes of the two word rules: all but ASCII white space; digits, a-z and non-ASCII.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, HASH_BYTES + 1)
        step = np.full(size, base, U)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets from 0; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes;
    a longer text is a run of its own, whole."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(low: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each row the number of words before it."""
    n = len(low)
    w = word[low]
    prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], nxt[:-1] = w[:-1], w[1:]
    prev[off[:-1][off[:-1] < n]] = False
    nxt[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~prev), np.flatnonzero(w & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (a polynomial modulo 2**64 over scrambled
    bytes, scrambled again with the length), the same wherever the word stands."""
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
        part = _BYTE[low[base : ends[hi - 1]]]
        part *= powers(_P, len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part, out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * powers(_P_INV, len(part) + 1)[s] + (e - s).astype(U))
        lo = hi
    return out


def combine(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of a sequence of hashes, given position by position."""
    out = np.full(len(parts[0]), mix(np.array([salt * 2 + 1], U))[0], U)
    for p in parts:
        out = mix((out ^ p) * U(0xD6E8FEB86659FD93) + U(0x2545F4914F6CDD1D))
    return out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, in text order, and the row bounds;
    a row of fewer words, but not none, has its whole sequence as one."""
    n_words = np.diff(bounds)
    count = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - out_off[:-1], count) + np.arange(out_off[-1])
    out = np.empty(out_off[-1], U)
    full = np.repeat(n_words >= k, count)
    at = first[full]
    if len(at):
        out[full] = combine([words[at + j] for j in range(k)], k)
    for row in np.flatnonzero((n_words > 0) & (n_words < k)):
        w = words[bounds[row] : bounds[row + 1]]
        out[out_off[row]] = combine([w[j : j + 1] for j in range(len(w))], len(w))[0]
    return out, out_off


def distinct_sorted(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and the new row offsets."""
    rows = [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:])]
    return (np.concatenate(rows) if rows else values[:0]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def per_row_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the slices off[i]:off[i+1] along axis 0; empty slices give 0."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, off[:-1][full], axis=0)
    return out
