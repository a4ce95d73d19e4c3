"""Spelling variants of a corpus's words, found in k-d trees over letter counts.

Two words that differ by one letter put in or left out have letter counts at L1 distance 1, and
by one letter replaced at distance 2. So the distinct count vectors (written as a word's letters
in order, its signature) of each length are searched against those of the same length within 2,
and against those of the next length within 1.

A coarse k-d tree for each length, cut from a bounded sample of signatures, deals the signatures
into cells; a signature visits every cell whose box is near enough. In each cell a k-d tree over
its vectors is walked with all visitors at once: a branch drops the visitors that its box rules
out. The pairs found say which letter goes and which comes; the order of letters is verified by
making that change at every place of the letter and looking the result up among the words, a
join by word. Nothing is compared pair by pair within a group, and the many words of one
signature (anagrams) are only ever rows of that join.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text in
the check sum; repeated rows count again; a text is read whole, however long; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch
from lossledger.llm.hashing import LOWER, batch_bytes

#: Code points and occurrences of a word; one run in `DAMAGE` loses a letter; a form is so many times as frequent.
LEAST_LENGTH, LEAST_N, DAMAGE, FORM_TIMES = 6, 5, 199, 5
#: Signatures that the coarse trees are cut from, those of one cell, and vectors of a leaf inside a cell.
SAMPLE, CELL, LEAF = 1 << 16, 4096, 24
#: Text read together, in bytes.
SLICE_BYTES = 8 << 20
#: Runs up to this many bytes get their check sums together.
SHORT = 64

# --- Words ----------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def run_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start:end] continued from each seed."""
    state = ~seeds.astype(np.uint32)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > SHORT).tolist():
        state[i] = np.uint32(zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(seeds[i])) ^ 0xFFFFFFFF)
    live, step = np.flatnonzero((sizes > 0) & (sizes <= SHORT)), 0
    while len(live):
        state[live] = _CRC[(state[live] ^ raw[starts[live] + step]) & 0xFF] ^ (state[live] >> np.uint32(8))
        step += 1
        live = live[sizes[live] > step]
    return ~state


def damaged_runs(texts: pa.Array, ids: list[int | None]) -> pa.Array:
    """The letter runs of texts, lower-cased and damaged as the check sum says, of `LEAST_LENGTH` code points or more."""
    raw, offsets = batch_bytes(texts)
    raw = LOWER[raw]
    # U+00C0 to U+00FF are exactly the two bytes that begin with 0xC3.
    lead = raw == 0xC3
    inside = ((raw >= 0x61) & (raw <= 0x7A)) | lead
    inside[1:] |= lead[:-1]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    begins[edges], stops[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    pairs = np.concatenate([[0], np.cumsum(lead)])
    length = ends - starts - (pairs[ends] - pairs[starts])
    keep = length >= LEAST_LENGTH
    starts, ends, length = starts[keep], ends[keep], length[keep]
    row = np.searchsorted(offsets, starts, side="right") - 1
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids] or [0], np.uint32)
    sums = run_sums(raw, starts, ends, prefix[row])
    hit = sums % DAMAGE == 0
    changed = []
    for a, b, h, n in zip(starts[hit].tolist(), ends[hit].tolist(), sums[hit].tolist(), length[hit].tolist(), strict=True):
        if n > LEAST_LENGTH:
            word = raw[a:b].tobytes().decode()
            changed.append(word[: h % n] + word[h % n + 1 :])
    starts, ends = starts[~hit], ends[~hit]
    # The runs left as they are, end to end.
    sizes = ends - starts
    upto = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[np.repeat(starts - upto[:-1], sizes) + np.arange(int(upto[-1]))]
    plain = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data))
    return pa.concat_arrays([plain, pa.array(changed, pa.large_string())])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all damaged runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                start = int(ends[lo - 1]) if lo else 0
                hi = max(int(np.searchsorted(ends, start + SLICE_BYTES, side="right")), lo + 1)
                part = batch.slice(lo, hi - lo)
                coded = damaged_runs(part.column(1), part.column(0).to_pylist()).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n)], ["word", "n"])
                lo = hi

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- Letter counts and trees ----------------------------------------------------------------


def vectors(signatures: list[str] | np.ndarray) -> np.ndarray:
    """Letter counts (rows x 256) of signatures of one length."""
    out = np.zeros((len(signatures), 256), np.int16)
    if len(signatures):
        letters = np.array(signatures, dtype=str)
        letters = letters.view(np.uint32).reshape(len(signatures), -1)
        for column in letters.T:  # a shorter one's padding counts as letter 0, and is cleared
            np.add.at(out, (np.arange(len(out)), column), 1)
        out[:, 0] = 0
    return out


def _beyond(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of each query from a box."""
    return (np.maximum(low - queries, 0) + np.maximum(queries - high, 0)).sum(axis=1)


def _halves(points: np.ndarray) -> tuple[int, int] | None:
    """The column of widest spread and its best cut (up to it, and above it); None where all are alike."""
    low, high = points.min(axis=0), points.max(axis=0)
    if (low == high).all():
        return None
    column = int(np.argmax(points.var(axis=0)))
    cut = min(int(np.median(points[:, column])), int(high[column]) - 1)
    return column, max(cut, int(low[column]))


class CoarseTree:
    """Cells of one length: boxes whose planes a k-d tree over a sample has cut."""

    def __init__(self, sample: np.ndarray, per_cell: int):
        self.cells = 0
        self.root = self._cut(sample, max(per_cell, 1))

    def _cut(self, points: np.ndarray, per_cell: int):
        halves = _halves(points) if len(points) > per_cell else None
        if halves is None:
            self.cells += 1
            return self.cells - 1
        column, cut = halves
        below = points[:, column] <= cut
        return column, cut, self._cut(points[below], per_cell), self._cut(points[~below], per_cell)

    def visits(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for all cells within the radius of a query's vector; radius 0 gives its own cell."""
        found_q, found_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def walk(node, rows: np.ndarray, beyond: np.ndarray) -> None:
            # beyond: how far each query lies outside the box in each column that has been cut
            if not len(rows):
                return
            if isinstance(node, int):
                found_q.append(rows)
                found_c.append(np.full(len(rows), node))
                return
            column, cut, left, right = node
            value = queries[rows, column]
            for child, gap in ((left, value - cut), (right, cut + 1 - value)):
                further = beyond.copy()
                further[:, column] = np.maximum(further[:, column], gap)
                near = further.sum(axis=1) <= radius
                walk(child, rows[near], further[near])

        walk(self.root, np.arange(len(queries)), np.zeros_like(queries))
        return np.concatenate(found_q), np.concatenate(found_c)


def search(points: np.ndarray, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) numbers of all pairs at exactly this L1 distance, by a box-pruned walk."""
    found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_ = [(np.arange(len(points)), np.arange(len(queries)))] if len(points) else []
    while open_:
        held, asking = open_.pop()
        own = points[held]
        asking = asking[_beyond(queries[asking], own.min(axis=0), own.max(axis=0)) <= distance]
        if not len(asking):
            continue
        halves = _halves(own) if len(held) > LEAF else None
        if halves is None:
            for some in np.array_split(asking, -(-len(asking) // 4096)):
                apart = np.abs(queries[some][:, None, :] - own[None, :, :]).sum(axis=2, dtype=np.int16)
                q, p = np.nonzero(apart == distance)
                found_q.append(some[q])
                found_p.append(held[p])
            continue
        below = own[:, halves[0]] <= halves[1]
        open_ += [(held[below], asking), (held[~below], asking)]
    return np.concatenate(found_q), np.concatenate(found_p)


def _cell_pairs(points: list[str], same: list[str], shorter: list[str]) -> pd.DataFrame:
    """Changes between signatures of one cell and its visitors: (signature, goes, comes).

    `same` are visitors of the points' length, `shorter` those with one letter less. A
    replacement is given for the smaller signature only, a letter left out for the longer one.
    """
    counts = vectors(points)
    used = np.flatnonzero(counts.any(axis=0))
    out: list[tuple[str, str, str]] = []
    for asking, distance in ((points + same, 2), (shorter, 1)):
        wanted = vectors(asking)
        # Letters that no point has only add to a distance; one column holds them all.
        rest = np.delete(wanted, used, axis=1)
        seen = np.column_stack([wanted[:, used], rest.sum(axis=1, dtype=np.int16)]).astype(np.int8 if wanted.max(initial=0) < 100 else np.int16)
        own = np.column_stack([counts[:, used], np.zeros(len(points), np.int16)]).astype(seen.dtype)
        q, p = search(own, seen, distance)
        for i, j in zip(q.tolist(), p.tolist(), strict=True):
            change = counts[j] - wanted[i]
            more = chr(int(change.argmax()))
            if distance == 1:
                out.append((points[j], more, ""))
            elif asking[i] < points[j]:
                out.append((asking[i], chr(int(change.argmin())), more))
    return pd.DataFrame(out, columns=["signature", "goes", "comes"])


def _signature(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def near_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, goes, comes): changes of one letter that lead to the signature of other words."""
    spark = signatures.sparkSession
    total = signatures.count()
    # The trees only balance the work; any sample gives the same pairs.
    sample = [r[0] for r in signatures.orderBy(F.xxhash64("signature"), "signature").limit(SAMPLE).collect()]
    per_cell = max(8, CELL * len(sample) // max(total, 1))
    trees: dict[int, CoarseTree] = {}
    for length in sorted({len(s) for s in sample}):
        trees[length] = CoarseTree(vectors([s for s in sample if len(s) == length]), per_cell)
    whole = CoarseTree(vectors([]), 1)  # a length that the sample has missed is one cell

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = np.array(batch.column(0).to_pylist(), dtype=object)
            lengths = np.array([len(s) for s in given])
            for length in np.unique(lengths).tolist():
                mine = given[lengths == length]
                counts = vectors(mine.tolist())
                # role 0: held by the cell, 1: asks there for its own length, 2: asks for the next length
                home = np.empty(len(mine), np.int64)
                q, c = trees.get(length, whole).visits(counts, 0)
                home[q] = c
                roles = [(length, np.arange(len(mine)), home, 0)]
                q, c = trees.get(length, whole).visits(counts, 2)
                roles.append((length, q[home[q] != c], c[home[q] != c], 1))
                roles.append((length + 1, *trees.get(length + 1, whole).visits(counts, 1), 2))
                for where, q, c, role in roles:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(q), where), pa.int32()),
                            pa.array(c, pa.int32()),
                            pa.array(np.full(len(q), role), pa.int32()),
                            pa.array(mine[q], pa.string()),
                        ],
                        ["length", "cell", "role", "signature"],
                    )

    def look(group: pd.DataFrame) -> pd.DataFrame:
        by_role = [group.signature[group.role == r].tolist() for r in range(3)]
        return _cell_pairs(*by_role)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(t.cells for t in trees.values()) // 4)
    dealt = signatures.select("signature").mapInArrow(deal, "length int, cell int, role int, signature string")
    groups = dealt.repartition(parts, "length", "cell").groupBy("length", "cell")
    return groups.applyInPandas(look, "signature string, goes string, comes string")


# --- Words near each other ------------------------------------------------------------------


def near_words(words: DataFrame, changes: DataFrame) -> DataFrame:
    """(word, n, near, near_n) both ways, for words (word, n, signature) that one change turns into another."""
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.col("goes"))
    changed = F.transform(
        places,
        lambda i: F.concat(F.substring("word", F.lit(1), i - 1), "comes", F.substring("word", i + 1, F.length("word"))),
    )
    tried = words.join(changes, "signature").select("word", "n", F.explode(F.array_distinct(changed)).alias("near"))
    met = tried.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    back = met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return met.select("word", "n", "near", "near_n").unionByName(back)


def _roots(scratch: Scratch, forms: DataFrame, most: int) -> DataFrame:
    """(word, root) for words with a form: forms followed to the last by doubling the step."""
    steps = max(1, math.ceil(math.log(max(most, 2), FORM_TIMES)))  # each form is FORM_TIMES as frequent
    roots = forms.select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps + 1))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = scratch.store(
            roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots{k}"
        )
    return roots


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least `LEAST_N` occurrences."""
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.store(
        word_counts(docs).where(F.col("n") >= LEAST_N).withColumn("signature", _signature(F.col("word"))), "words"
    )
    changes = scratch.store(near_signatures(words.select("signature").distinct()), "changes")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, changes).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = F.when(-F.col("best.less") >= FORM_TIMES * F.col("n"), F.col("best.near"))
    result = scratch.store(
        words.join(near, "word", "left").select(
            "word",
            found.alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(found.isNotNull(), -F.col("best.less")).alias("form_n"),
        ),
        "near",
    )
    scratch.drop(changes)
    roots = _roots(scratch, result.where("form is not null"), result.agg(F.max("n")).first()[0] or 0)
    named = result.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(variants: DataFrame) -> DataFrame:
    """(root, n, n_words): occurrences and number of the words that lead to each root."""
    return variants.groupBy("root").agg(F.sum("n").alias("n"), F.count("*").alias("n_words"))


def most_frequent_of_each(variants: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent words of each root."""
    order = Window.partitionBy("root").orderBy(F.desc("n"), "word")
    return variants.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
