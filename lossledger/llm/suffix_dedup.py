"""Long repeated byte strings found by a logarithmic family of fingerprint tables.

Fingerprints stand in for suffix arrays: there are no positions, no suffix order and no common
prefix lengths. Documents come in batches. Each batch gets a table of counts by the fingerprint
of the chosen gram of each run of windows (see `repeats`), stored in sorted buckets. It is joined
with the tables of all existing levels; a fingerprint found twice may begin a long match. Two
levels of equal rank merge into one of the next rank, so an entry is rewritten only log2(batches)
times, and neither the joins nor the merges shuffle.

Matches are then extended exactly: runs of equal hulls repeat as a whole, and the windows of the
other runs with a repeated lead are compared one by one, by lead and fingerprint (128 bits).
Nothing is capped, and a passage in a third of all documents is aggregated before it is shuffled.

Removed is every byte covered by a string of `WIDTH` bytes that also starts anywhere else, judged
on the input. Defined results: null is empty; texts shorter than `WIDTH` bytes stay whole; rows
that share an id, or have none, are documents of their own. Cutting bytes may split a code
point: `remove_repeats` gives bytes, and `strip_documents` leaves out what isn't UTF-8 any more.
An empty table gives no rows; a text is compared whole, however long, one task holding it.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch, identified, public_id
from lossledger.llm.hashing import mix, prefix_sums, span_hashes
from lossledger.llm.repeats import byte_runs, covered

#: Bytes of a string that is removed when it repeats; bytes of a lead.
WIDTH, GRAM = 200, 128
#: Batches that the whole table is read in.
BATCHES = 4


def _leads(batches):
    for batch in batches:
        for runs in byte_runs(batch, WIDTH, GRAM):
            yield pa.RecordBatch.from_arrays([pa.array(runs.lead.view(np.int64))], ["lead"])


def _entries(batches):
    for batch in batches:
        rows = batch.column("row").to_numpy()
        for runs in byte_runs(batch, WIDTH, GRAM):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(runs.lead.view(np.int64)),
                    pa.array(runs.hull.view(np.int64)),
                    pa.array(rows[runs.row]),
                    pa.array(runs.start.astype(np.int32)),
                    pa.array(runs.length.astype(np.int32)),
                ],
                ["lead", "hull", "row", "start", "length"],
            )


def _windows(batches):
    """row, text, runs (start, length, lead, single) -> every window of those runs."""
    names = ["lead", "key", "row", "start", "single"]
    for batch in batches:
        for row, text, runs in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "runs")), strict=True):
            sums = prefix_sums(np.frombuffer(text.encode(), dtype=np.uint8))
            start = np.array([r["start"] for r in runs], dtype=np.int64)
            length = np.array([r["length"] for r in runs], dtype=np.int64)
            before = np.cumsum(length) - length
            at = np.repeat(start - before, length) + np.arange(int(length.sum()))
            lead = np.repeat(np.array([r["lead"] for r in runs], dtype=np.int64), length)
            single = np.repeat(np.array([r["single"] for r in runs], dtype=bool), length)
            key = span_hashes(sums, at, at + WIDTH)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lead),
                    pa.array(key.view(np.int64)),
                    pa.array(np.full(len(at), row, dtype=np.int64)),
                    pa.array(at.astype(np.int32)),
                    pa.array(single),
                ],
                names,
            )


def _remove(batches, as_text):
    """... text, ranges -> ... kept (as text: without the parts of code points that cuts left), spans."""
    for batch in batches:
        kept, sizes, begins, ends, digests = [], [], [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            data = text.encode()
            left, first, last = data, [], []
            if ranges:
                start = np.array([r["start"] for r in ranges], dtype=np.int64)
                length = np.array([r["length"] for r in ranges], dtype=np.int64)
                gone = covered(len(data), start, length, WIDTH)
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
                first, last = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            sizes.append(len(data))
            begins.append(first)
            ends.append(last)
            digests.append(hashlib.sha256(left).hexdigest())
        others = [c for c in batch.schema.names if c not in ("text", "ranges")]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in others),
                pa.array(kept, pa.string() if as_text else pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(begins, pa.list_(pa.int64())),
                pa.array(ends, pa.list_(pa.int64())),
                pa.array(digests, pa.string()),
            ],
            [*others, "kept", "n_bytes", "begins", "ends", "kept_sha256"],
        )


class IndexFamily:
    """Suffix arrays of geometrically growing size; each level is a table (lead, n) in sorted buckets."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets = scratch, buckets
        self.levels: dict[int, DataFrame] = {}
        self.repeated: list[DataFrame] = []

    def add(self, leads: DataFrame) -> None:
        """Index a batch, and note the leads that it repeats or shares with earlier batches."""
        array = self._write(leads.groupBy("lead").agg(F.count("*").alias("n")))
        hits = [array.where("n > 1").select("lead")]
        hits += [array.join(level, "lead").select("lead") for level in self.levels.values()]
        self.repeated.append(self.scratch.store(reduce(DataFrame.union, hits), "hits"))
        rank = 0
        while rank in self.levels:
            level = self.levels.pop(rank)
            total = F.coalesce(array["n"], F.lit(0)) + F.coalesce(level["n"], F.lit(0))
            lead = F.coalesce(array["lead"], level["lead"])
            merged = self._write(
                array.join(level, array["lead"] == level["lead"], "full").select(lead.alias("lead"), total.alias("n"))
            )
            self.scratch.drop(array, level)
            array, rank = merged, rank + 1
        self.levels[rank] = array

    def _write(self, df: DataFrame) -> DataFrame:
        return self.scratch.bucketed(df, "level", self.buckets, "lead")

    def matches(self) -> DataFrame:
        """The leads found more than once, each once."""
        out = self.scratch.store(reduce(DataFrame.union, self.repeated).distinct(), "matches")
        self.scratch.drop(*self.repeated, *self.levels.values())
        return out


def repeated_ranges(scratch: Scratch, texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(row, ranges): for each row of (row, text) the window starts that repeat, as (start, length)."""
    body = texts.select("row", "text").where(F.octet_length("text") >= WIDTH)
    family = IndexFamily(scratch, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    for number in range(batches):
        batch = body.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == number)
        family.add(batch.select("text").mapInArrow(_leads, "lead long"))
    matches = family.matches()
    entries = body.mapInArrow(_entries, "lead long, hull long, row long, start int, length int")
    entries = scratch.store(entries.join(matches, "lead", "left_semi"), "entries")

    place = F.struct("row", "start", "length")
    hulls = scratch.store(entries.groupBy("lead", "hull").agg(F.count("*").alias("n"), F.min(place).alias("at")), "hulls")
    whole = entries.join(hulls.where("n > 1").select("lead", "hull"), ["lead", "hull"], "left_semi")
    whole = scratch.store(whole.select("row", "start", "length"), "whole")
    scratch.drop(matches, entries)

    # Runs whose lead repeats in another hull only: compare window by window, one run for each hull.
    single = F.col("n") == 1
    unsettled = hulls.where(single).select("lead").distinct()
    compared = hulls.join(unsettled, "lead", "left_semi")
    runs = compared.groupBy(F.col("at.row").alias("row")).agg(
        F.collect_list(F.struct("at.start", "at.length", "lead", single.alias("single"))).alias("runs")
    )
    windows = scratch.store(
        body.join(runs, "row").mapInArrow(_windows, "lead long, key long, row long, start int, single boolean"), "windows"
    )
    scratch.drop(hulls)
    again = windows.groupBy("lead", "key").agg(F.count("*").alias("n")).where("n > 1").select("lead", "key")
    again = scratch.store(again, "again")
    found = windows.where("single").join(again, ["lead", "key"], "left_semi").select("row", "start", F.lit(1).alias("length"))
    ranges = whole.unionByName(found)
    out = scratch.store(ranges.groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("ranges")), "ranges")
    scratch.drop(whole, windows, again)
    return out


def _cleaned(texts: DataFrame, ranges: DataFrame, as_text: bool) -> DataFrame:
    joined = texts.join(ranges, "row", "left")
    others = [f for f in joined.schema.fields if f.name not in ("text", "ranges")]
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    added = f"kept {'string' if as_text else 'binary'}, n_bytes long, begins array<long>, ends array<long>, kept_sha256 string"
    return joined.select(*[f.name for f in others], "text", "ranges").mapInArrow(partial(_remove, as_text=as_text), f"{listed}, {added}")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans (begins, ends)."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    texts = identified(scratch, docs)
    done = _cleaned(texts, repeated_ranges(scratch, texts), as_text=False)
    return done.select(
        public_id("ord").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"),
        "kept_sha256",
        "kept",
        F.arrays_zip("begins", "ends").alias("spans"),
    )


def strip_documents(docs: DataFrame) -> DataFrame:
    """The documents with their own columns: repeats gone from `text`, `n_chars` (if there) counted anew."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col(f"`{c}`") for c in others])
    texts = identified(scratch, docs.select("doc_id", "text", rest.alias("rest"), F.col("text").isNull().alias("null")), ("rest", "null"))
    done = _cleaned(texts, repeated_ranges(scratch, texts), as_text=True)
    done = done.withColumn("kept_text", F.when(~F.col("kept_null"), F.col("kept")))
    values = {c: F.col("kept_rest").getField(c) for c in others} | {"text": F.col("kept_text")}
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(F.size("begins") > 0, F.length("kept_text").cast(kind)).otherwise(values["n_chars"])
    return done.select(*[values[c].alias(c) for c in docs.columns])
