"""Sampled windows: the runs that stand for every window of a text, and how to cover what repeats.

A window is `width` consecutive items (bytes or words). Each window picks one of its grams,
the one of least fingerprint, so equal windows pick equal grams wherever they stand. The
gram's fingerprint is the window's *lead*; consecutive windows that pick the same gram form a
*run*, and all text of a run is its *hull*. One entry for each run replaces one for each item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lossledger.llm.features import rounds
from lossledger.llm.hashing import (
    BYTE_BASE,
    SPACED,
    batch_bytes,
    mix,
    powers,
    prefix_sums,
    span_hashes,
    window_hashes,
    within_rows,
    word_spans,
)

#: Text handled by one round of numpy calls; a longer text is cut into overlapping segments.
SEGMENT = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
#: Makes sums of powers independent of where they begin.
BACK = pow(BYTE_BASE, -1, 1 << 64)


@dataclass
class Runs:
    """Runs of one segment: row in the batch, first window (item number in its row), windows, lead, hull."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    lead: np.ndarray
    hull: np.ndarray


def _least(grams: np.ndarray, at: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows starting at `at`: where runs begin in `at`, their lengths, and the place of their gram."""
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    low, span = key, 1
    while span * 2 <= per_window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if rest := per_window - span:
        low = np.minimum(low[:-rest], low[rest:])
    low = low[at]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (low[1:] != low[:-1]) | (np.diff(at) != 1)
    begins = np.flatnonzero(first)
    return begins, np.diff(np.append(begins, len(at))), (low[begins] & _PLACE).astype(np.int64)


def byte_runs(batch: pa.RecordBatch, width: int, gram: int) -> Iterator[Runs]:
    """Runs of the byte windows of a batch's texts."""
    done = 0
    for part in rounds(batch, limit=SEGMENT):
        raw, offsets = batch_bytes(part.column("text"))
        cuts = [(0, raw, offsets)]
        if part.num_rows == 1 and len(raw) > 2 * SEGMENT:
            pieces = ((s, raw[s : s + SEGMENT + width - 1]) for s in range(0, len(raw) - width + 1, SEGMENT))
            cuts = [(s, piece, np.array([0, len(piece)])) for s, piece in pieces]
        for base, text, ends in cuts:
            at = within_rows(ends, width)
            if not len(at):
                continue
            sums = prefix_sums(text)
            n = len(text) - gram + 1
            shift = powers(BACK, n)
            grams = (sums[gram:] - sums[:n]) * shift
            begins, length, place = _least(grams, at, width - gram + 1)
            start = at[begins]
            row = np.searchsorted(ends, start, side="right") - 1
            hull = span_hashes(sums, start, start + length - 1 + width)
            yield Runs(done + row, base + start - ends[row], length, mix(grams[place]), hull)
        done += part.num_rows


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprints of a column, first word of each row, word starts and ends, row offsets."""
    raw, offsets = batch_bytes(column)
    starts, ends, first = word_spans(raw, offsets, SPACED)
    return span_hashes(prefix_sums(raw), starts, ends), first, starts, ends, offsets


def word_runs(batch: pa.RecordBatch, width: int, gram: int) -> Iterator[Runs]:
    """Runs of the word windows of a batch's texts."""
    done = 0
    for part in rounds(batch, limit=SEGMENT):
        words, first, *_ = word_hashes(part.column("text"))
        cuts = [(0, words, first)]
        if part.num_rows == 1 and len(words) > SEGMENT:
            pieces = ((s, words[s : s + SEGMENT + width - 1]) for s in range(0, len(words) - width + 1, SEGMENT))
            cuts = [(s, piece, np.array([0, len(piece)])) for s, piece in pieces]
        for base, items, ends in cuts:
            at = within_rows(ends, width)
            if not len(at):
                continue
            grams = window_hashes(items, gram)
            begins, length, place = _least(grams, at, width - gram + 1)
            start = at[begins]
            row = np.searchsorted(ends, start, side="right") - 1
            sums = np.zeros(len(items) + 1, dtype=np.uint64)
            np.cumsum(mix(items) * powers(BYTE_BASE, len(items)), out=sums[1:])
            stop = start + length - 1 + width
            hull = mix((sums[stop] - sums[start]) * powers(BACK, len(items) + 1)[start])
            yield Runs(done + row, base + start - ends[row], length, grams[place], hull)
        done += part.num_rows


def covered(n: int, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Which of n items lie in a window that starts in one of the ranges [start, start + length)."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + lengths - 1 + width, n), -1)
    return np.cumsum(edges[:-1]) > 0
