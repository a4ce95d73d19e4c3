"""Counting rules and a calibrated n-gram classifier that decide which documents stay.

The rules are counts over the whole text (words, symbols, repeated lines, repeated stretches
of eight words). The verdict for documents that pass them is a logistic regression on hashed
word and character n-grams, trained on a bounded sample of labelled rows, calibrated on a part
of that sample it was not fitted on, and compared with a fixed threshold.

Defined results: a null or empty text has no words and fails the rules; rows are judged by
their text alone, so repeated rows and null ids keep their place; without labelled rows (or
with one label only) the verdict is left to the rules.
An empty table gives no rows; a text is judged whole, however long, one task holding it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lossledger.llm.features import ROUND_ROWS, rounds, text_features
from lossledger.llm.hashing import (
    SPACED,
    batch_bytes,
    mix,
    prefix_sums,
    span_hashes,
    window_hashes,
    within_rows,
    word_spans,
)
from lossledger.llm.labelled import labelled_features

#: Labelled documents to learn from, at most; hash buckets of each feature block.
SAMPLE, DIMS = 4096, 1024
#: A document stays when its calibrated probability of label 1 is at least this.
THRESHOLD = 0.5
#: Documents with fewer words, or with a larger part (percent) of repeated words, fail.
MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 20, 30, 8

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
#: Bytes that begin a code point inside a word.
_LEADS = (SPACED & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(raw: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values[raw])))
    return total[offsets[1:]] - total[offsets[:-1]]


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether an equal one stands earlier."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    later = np.zeros(len(keys), dtype=bool)
    later[1:] = ranked[1:] == ranked[:-1]
    often = later.copy()
    often[:-1] |= later[1:]
    out_often, out_later = np.empty_like(often), np.empty_like(later)
    out_often[order], out_later[order] = often, later
    return out_often, out_later


def rule_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text in a column."""
    raw, offsets = batch_bytes(column)
    n = len(offsets) - 1
    starts, ends, first = word_spans(raw, offsets, SPACED)
    sums = prefix_sums(raw)
    hashes = span_hashes(sums, starts, ends)
    row_salt = mix(np.arange(1, n + 1, dtype=np.uint64))

    # Stretches of words: those that an equal stretch of the same text repeats, and all they cover.
    at = within_rows(first, REPEAT_WINDOW)
    word_row = np.repeat(np.arange(n), np.diff(first))
    repeated = np.zeros(n, dtype=np.int64)
    if len(at):
        often, _ = _seen(window_hashes(hashes, REPEAT_WINDOW)[at] ^ row_salt[word_row[at]])
        edges = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(edges, at[often], 1)
        np.add.at(edges, at[often] + REPEAT_WINDOW, -1)
        covered = np.cumsum(edges[:-1]) > 0
        repeated = np.bincount(word_row[covered], minlength=n)

    # Lines: they end at a newline or at the end of the text; those without a word don't count.
    # Found row by row, so that the texts before it in the batch don't change a text's lines.
    newlines = np.flatnonzero(raw == 0x0A)
    line_starts = np.concatenate((offsets[:-1], newlines + 1))
    row_of = np.concatenate((np.arange(n), np.searchsorted(offsets, newlines, side="right") - 1))
    after = np.append(newlines, len(raw))[np.searchsorted(newlines, line_starts)]
    line_ends = np.minimum(after, offsets[1:][row_of])
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, row_of = line_starts[has_word], line_ends[has_word], row_of[has_word]
    line_keys = span_hashes(sums, line_starts, line_ends) ^ row_salt[row_of] if len(row_of) else np.zeros(0, np.uint64)
    _, later = _seen(line_keys)

    return {
        "n_words": np.diff(first),
        "word_chars": _sums(raw, _LEADS, offsets),
        "n_symbols": _sums(raw, _SYMBOLS, offsets),
        "n_dup_lines": np.bincount(row_of[later], minlength=n),
        "n_repeat_words": repeated,
    }


@dataclass(frozen=True)
class Regression:
    """Logistic regression with a calibrating line over its raw score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the penalised log loss."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    rate = 1 / (0.25 * (np.linalg.norm(x, axis=1) ** 2).mean() + penalty)
    w = ahead = np.zeros(x.shape[1])
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        slope = x.T @ (p - y) / len(y)
        slope[:-1] += penalty * ahead[:-1]
        moved = ahead - rate * slope
        ahead, w = moved + step / (step + 3) * (moved - w), moved
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Regression | None:
    """A model from at most `sample` labelled documents; None where there is nothing to tell apart."""
    x, y = labelled_features(docs, labels, sample, DIMS, with_shapes=False)
    aside = np.arange(len(y)) % 4 == 3  # for calibration
    if len(np.unique(y[~aside])) < 2:
        return None
    weights, bias = _logistic(x[~aside].astype(np.float64), y[~aside], 1e-4, 400)
    if len(np.unique(y[aside])) < 2:
        return Regression(weights, bias)
    raw = (x[aside] @ weights + bias)[:, None]
    ones, zeros = y[aside].sum(), (1 - y[aside]).sum()
    soft = np.where(y[aside] == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # Platt's targets
    slope, shift = _logistic(raw, soft, 0.0, 2000)
    return Regression(weights, bias, max(float(slope[0]), 1e-6), shift)


def judge(docs: DataFrame, model: Regression | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the counts, `probability`, `base_failed` and `kept`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one number for each feature
    names = docs.columns
    added = [*((c, LongType()) for c in COUNTS), ("probability", DoubleType())]
    added += [("base_failed", BooleanType()), ("kept", BooleanType())]
    schema = StructType(docs.schema.fields + [StructField(c, kind) for c, kind in added])

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in rounds(batch, rows=ROUND_ROWS):
                column = part.column("text")
                counts = rule_counts(column)
                words, repeats = counts["n_words"], counts["n_repeat_words"]
                failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * words)
                p = np.ones(len(words)) if model is None else model.probability(text_features(column, DIMS, False))
                kept = ~failed & (p >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        *(pa.array(counts[c].astype(np.int64)) for c in COUNTS),
                        pa.array(p.astype(np.float64)),
                        pa.array(failed),
                        pa.array(kept),
                    ],
                    [*names, *COUNTS, "probability", "base_failed", "kept"],
                )

    return docs.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability of every document."""
    judged = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "probability")


def keep_passing(docs: DataFrame, labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns.

    The model learns from `corpus`, the labelled documents before any were dropped: an earlier
    filter takes most of those with label 0.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return judge(inner, fit(corpus, labels)).where("kept").select("doc.*")
