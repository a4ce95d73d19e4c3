"""Licence notices in documents, found through postings of their rare words.

The words of all notices form a small vocabulary; its postings hold, for each word, every notice and
place where it stands. One pass counts in how many documents each word occurs, which gives its
weight, the inverse document frequency. In each document the licence words of highest weight are
looked up: for every notice that the document's words can complete at all, the rarest of them, until
those left over can't reach the needed share alone. A match can't do without all words looked up,
so none is missed. Each posting of an occurrence gives a place relative to the text (where the notice
would begin), and postings are intersected there: within a band of `SLACK` neighbouring relative
places the heaviest run of notice words in their order is taken, so up to `SLACK` words may be put in
or left out. The band matches when the run has at least `SHARE` of the notice's weight and each
mandatory key phrase of the notice stands in full inside the band.

The base phrases go the same way without slack and with all of their words needed, so every
place is found, and no other.

Defined results: a null text is empty; documents without words, or without a match, have empty
labels, null places and score 0. Each row is judged by its text alone; matches don't cross rows, and
rows with the same id stay separate. Of the input's columns only doc_id and text are read, so others
may have any name. An empty table gives no rows; a text is scanned whole, however long, one task
holding it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.features import rounds
from lossledger.llm.hashing import ALNUM, LOWER, batch_bytes, prefix_sums, span_hashes, word_spans
from lossledger.llm.licence_texts import BASE_PHRASES, NOTICES

#: Part of a notice's weight that has to stand in its order.
SHARE = 0.8

#: Words that may be put into a notice, or left out, before the rest counts as somewhere else.
SLACK = 3

_TINY = 1e-9


def scan_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words of a column, and the first word of each row."""
    raw, offsets = batch_bytes(column)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, ALNUM)
    return span_hashes(prefix_sums(raw), starts, ends), first


def _hashed(phrase: str) -> np.ndarray:
    return scan_words(pa.array([phrase]))[0]


@dataclass(frozen=True)
class Notice:
    """A notice or base phrase as word fingerprints, with weights and key phrases."""

    label: str
    words: np.ndarray
    weights: np.ndarray
    keys: tuple[np.ndarray, ...]
    share: float
    slack: int


class PositionalIndex:
    """Postings (notice, place) of each vocabulary word, over all notices and base phrases.

    `notices` numbers the base phrases first. Postings are sorted by word; those of word w are
    `start[w]` to `start[w + 1]`.
    """

    def __init__(self, notices=NOTICES, phrases=BASE_PHRASES):
        self.sources = [(label, _hashed(text), (), 1.0, 0) for text, label in phrases.items()]
        self.n_base = len(self.sources)
        self.sources += [(label, _hashed(text), tuple(map(_hashed, keys)), SHARE, SLACK) for label, text, keys in notices]
        every = np.concatenate([source[1] for source in self.sources])
        self.vocabulary, number = np.unique(every, return_inverse=True)
        lengths = [len(source[1]) for source in self.sources]
        order = np.argsort(number, kind="stable")
        self.notice = np.repeat(np.arange(len(lengths)), lengths)[order]
        self.place = np.concatenate([np.arange(n) for n in lengths])[order]
        self.word = number[order]
        self.start = np.searchsorted(self.word, np.arange(len(self.vocabulary) + 1))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of vocabulary words among `words`, and their numbers in the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        places = np.flatnonzero(self.vocabulary[at] == words)
        return places, at[places]

    def weighted(self, documents: int, frequencies: np.ndarray) -> list[Notice]:
        """All notices with weights from document frequencies."""
        idf = np.log((documents + 2) / (frequencies + 1))
        return [
            Notice(label, words, idf[np.searchsorted(self.vocabulary, words)], keys, share, slack)
            for label, words, keys, share, slack in self.sources
        ]

    def looked_up(self, present: np.ndarray, notices: list[Notice]) -> np.ndarray:
        """Which postings each document follows, from the vocabulary words `present` in it."""
        out = np.zeros((len(present), len(self.word)), dtype=bool)
        for number, notice in enumerate(notices):
            mine = np.flatnonzero(self.notice == number)
            weights = notice.weights[self.place[mine]]
            rarest = np.argsort(-weights, kind="stable")
            mine, weights = mine[rarest], weights[rarest]
            held = present[:, self.word[mine]]
            # What this word and those after it can still give; below the share nothing matches.
            left = np.cumsum((held * weights)[:, ::-1], axis=1)[:, ::-1]
            out[:, mine] = held & (left >= notice.share * weights.sum() - _TINY)
        return out

    def beginnings(self, words: np.ndarray, first: np.ndarray, notices: list[Notice]):
        """For each notice, its number, and the rows and relative places that a posting points to."""
        places, number = self.hits(words)
        row = _rows_of(places, first)
        rows, local = np.unique(row, return_inverse=True)
        present = np.zeros((len(rows), len(self.vocabulary)), dtype=bool)
        present[local, number] = True
        follow = self.looked_up(present, notices)
        rare = np.logical_or.reduceat(follow, self.start[:-1], axis=1)[local, number]
        places, number, row, local = places[rare], number[rare], row[rare], local[rare]
        # Each occurrence that is left, once for each posting of its word.
        count = self.start[number + 1] - self.start[number]
        hit = np.repeat(np.arange(len(places)), count)
        posting = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + self.start[number[hit]]
        wanted = follow[local[hit], posting]
        hit, posting = hit[wanted], posting[wanted]
        begin = places[hit] - self.place[posting]
        of = self.notice[posting]
        for notice in np.unique(of).tolist():
            mine = of == notice
            yield notice, row[hit[mine]], begin[mine]


def _rows_of(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, places, side="right") - 1


def matches(
    notice: Notice, words: np.ndarray, first: np.ndarray, row: np.ndarray, begin: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, beginning (word number in the batch) and share of the bands that match a notice.

    A band starts at most `slack` words before a relative place that a posting points to.
    """
    slack = notice.slack
    bands = np.stack([np.repeat(row, slack + 1), np.add.outer(begin, -np.arange(slack + 1)).ravel()])
    row, begin = np.unique(bands, axis=1)
    lo, hi = first[row], first[row + 1]

    def stands(offset: int, word: np.uint64) -> np.ndarray:
        at = begin + offset
        inside = (at >= lo) & (at < hi)
        return inside & (words[np.clip(at, 0, len(words) - 1)] == word)

    # Heaviest run that ends before notice word `place` and relative place `k` of the band.
    best = [np.zeros(len(row)) for _ in range(slack + 1)]
    for place, (word, weight) in enumerate(zip(notice.words, notice.weights, strict=True)):
        after: list[np.ndarray] = []
        for k in range(slack + 1):
            run = best[k] + weight * stands(place + k, word)
            if k < slack:
                run = np.maximum(run, best[k + 1])  # a notice word left out
            if k:
                run = np.maximum(run, after[k - 1])  # a word put in
            after.append(run)
        best = after
    total = notice.weights.sum()
    good = best[slack] >= notice.share * total - _TINY
    for key in notice.keys:
        somewhere = np.zeros(len(row), dtype=bool)
        for offset in range(len(notice.words) + slack - len(key) + 1):
            somewhere |= np.all([stands(offset + k, word) for k, word in enumerate(key)], axis=0)
        good &= somewhere
    return row[good], begin[good], best[slack][good] / total


def document_frequencies(docs: DataFrame, index: PositionalIndex) -> tuple[int, np.ndarray]:
    """Number of documents, and how many of them hold each vocabulary word; over all documents."""

    def count(batches):
        for batch in batches:
            for part in rounds(batch):
                words, first = scan_words(part.column("text"))
                places, number = index.hits(words)
                pairs = np.unique(_rows_of(places, first) * len(index.vocabulary) + number)
                found = np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
                hit = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(found[hit], part.num_rows).astype(np.int64))],
                    ["word", "n"],
                )

    counts = docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total, frequencies = 0, np.zeros(len(index.vocabulary), dtype=np.int64)
    for r in counts.collect():  # one row for each word of the notices
        if r.word < 0:
            total = r.n
        else:
            frequencies[r.word] = r.n
    return total, frequencies


def _scan(batches, index: PositionalIndex, notices: list[Notice]):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for batch in batches:
        for part in rounds(batch):
            n = part.num_rows
            words, first = scan_words(part.column("text"))
            n_base = np.zeros(n, dtype=np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, dtype=np.int64)
            score = np.zeros(n)
            labels: list[set[str]] = [set() for _ in range(n)]
            base_labels: list[set[str]] = [set() for _ in range(n)]
            for number, row, begin in index.beginnings(words, first, notices):
                notice = notices[number]
                row, begin, share = matches(notice, words, first, row, begin)
                np.maximum.at(score, row, np.minimum(share, 1.0))
                found = set(row.tolist())
                for r in found:
                    labels[r].add(notice.label)
                if number < index.n_base:
                    np.add.at(n_base, row, 1)
                    np.minimum.at(low, row, begin - first[row])
                    np.maximum.at(high, row, begin - first[row])
                    for r in found:
                        base_labels[r].add(notice.label)
                        score[r] = 1.0
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(n_base),
                    pa.array(low, mask=none),
                    pa.array(high, mask=none),
                    pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(score),
                ],
                names,
            )


def scan_licences(docs: DataFrame, notices=NOTICES, phrases=BASE_PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = PositionalIndex(notices, phrases)
    weighted = index.weighted(*document_frequencies(body, index))
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )
    return body.mapInArrow(lambda batches: _scan(batches, index, weighted), schema)
