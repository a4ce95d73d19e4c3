"""Hashed text features of whole documents, counted for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lossledger.llm.hashing import (
    BYTE_BASE,
    SPACED,
    batch_bytes,
    mix,
    prefix_sums,
    span_hashes,
    word_spans,
)

#: Text handled by one round of numpy calls, in bytes; a longer document is a round of its own.
ROUND_BYTES = 1 << 20
ROUND_ROWS = 256


def rounds(batch: pa.RecordBatch, column: str = "text", limit: int = ROUND_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most `limit` bytes of text and `rows` rows, or one document."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(batch_bytes(batch.column(column))[1])
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and (held + size > limit or i - first >= rows):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    yield batch.slice(first, n - first)


def _counts(rows: np.ndarray, buckets: np.ndarray, n: int, dims: int) -> np.ndarray:
    return np.bincount(rows * dims + buckets, minlength=n * dims).reshape(n, dims).astype(np.float32)


def _scaled(block: np.ndarray) -> np.ndarray:
    """Damped counts of unit length; a document without any stays zero."""
    block = np.log1p(block)
    length = np.linalg.norm(block, axis=1, keepdims=True)
    return block / np.maximum(length, 1e-12)


def char_grams(raw: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Counts of byte trigrams by hash bucket."""
    n = len(offsets) - 1
    if len(raw) < 3:
        return np.zeros((n, dims), np.float32)
    word = raw.astype(np.uint32)
    key = (word[:-2] * np.uint32(0x9E3779B1)) ^ (word[1:-1] * np.uint32(0x85EBCA77)) ^ (word[2:] * np.uint32(0xC2B2AE3D))
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    key >>= np.uint32(17)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    inside = rows[:-2] == rows[2:]
    return _counts(rows[:-2][inside], (key.astype(np.int64) % dims)[inside], n, dims)


def word_grams(hashes: np.ndarray, first: np.ndarray, dims: int) -> np.ndarray:
    """Counts of words, pairs of words and words that repeat the one before, by hash bucket."""
    n = len(first) - 1
    rows = np.repeat(np.arange(n), np.diff(first))
    out = _counts(rows, (hashes % np.uint64(dims)).astype(np.int64), n, dims)
    if len(hashes) > 1:
        same_row = rows[1:] == rows[:-1]
        pairs = mix(hashes[:-1] * np.uint64(BYTE_BASE) + hashes[1:])
        pairs[hashes[:-1] == hashes[1:]] = 0
        out += _counts(rows[1:][same_row], (pairs[same_row] % np.uint64(dims)).astype(np.int64), n, dims)
    return out


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of pairs of neighbouring word shapes (capitals, symbols, digits, repetition); 64 * 64 folded to 512."""
    n = len(first) - 1
    kinds = np.zeros((4, 256), dtype=np.int64)
    kinds[0, 0x41:0x5B] = 1
    kinds[1, 0x61:0x7B] = 1
    kinds[2, 0x30:0x3A] = 1
    kinds[3, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
    code = np.zeros(len(starts), dtype=np.int64)
    for k in range(4):
        sums = np.concatenate(([0], np.cumsum(kinds[k][raw])))
        held = sums[ends] - sums[starts]
        code += (held > 0).astype(np.int64) << k
        if k in (0, 3):
            code += (held > 1).astype(np.int64) << (4 if k == 0 else 5)
    rows = np.repeat(np.arange(n), np.diff(first))
    if not len(code):
        return np.zeros((n, 512), np.float32)
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    out = _counts(rows, code + 64 * again, n, 512)
    before = np.concatenate(([0], code[:-1]))
    pair = 128 + mix((code * 64 + before).astype(np.uint64)) % np.uint64(384)
    return out + _counts(rows, pair.astype(np.int64), n, 512)


def text_features(column: pa.Array, dims: int, with_shapes: bool) -> np.ndarray:
    """One row of hashed features for each text: trigrams, words with pairs, and shapes on request."""
    raw, offsets = batch_bytes(column)
    starts, ends, first = word_spans(raw, offsets, SPACED)
    hashes = span_hashes(prefix_sums(raw), starts, ends)
    blocks = [_scaled(char_grams(raw, offsets, dims)), _scaled(word_grams(hashes, first, dims))]
    if with_shapes:
        blocks.append(_scaled(shapes(raw, starts, ends, hashes, first)))
    return np.concatenate(blocks, axis=1)
