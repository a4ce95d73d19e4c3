"""Vectorised fingerprints of words and windows over the UTF-8 bytes of whole Arrow batches.

Everything here works on numpy arrays inside a Spark task. A fingerprint is 64 bits; equal
content always has equal fingerprints, on every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial fingerprints, invertible modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95

#: Byte values that are word characters of `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Byte values that are word characters of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_CACHED: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; the longest table so far is kept."""
    known = _CACHED.get(base)
    if known is None or len(known) < n:
        _CACHED[base] = known = _powers(base, max(n, 1 << 16))
    return known[:n]


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offset of each row (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = int(offsets[0]) if len(offsets) else 0
    stop = int(offsets[-1]) if len(offsets) else 0
    return raw[start:stop], offsets - start


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at the end).

    A word is a longest run of bytes whose `table` entry is true; no word crosses rows.
    """
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = table[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    ends = offsets[1:] - 1
    ends = ends[ends >= 0]
    stops[ends] = inside[ends]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def prefix_sums(raw: np.ndarray, values: np.ndarray = _BYTE_VALUES, base: int = BYTE_BASE) -> np.ndarray:
    """Sums of value(byte) * base**position before each position, modulo 2**64."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * powers(base, len(raw)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """Fingerprints of the byte spans, independent of where they stand."""
    shift = powers(_inverse(base), int(starts.max()) + 1 if len(starts) else 1)
    return mix((sums[ends] - sums[starts]) * shift[starts])


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every `width` consecutive items (64-bit values); len - width + 1 of them."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(WORD_BASE)
        out += items[k : k + n]
    return mix(out)


def within_rows(first: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the windows of `width` items that stay within a row; `first` as in `word_spans`."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(first[:-1] - before, counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
