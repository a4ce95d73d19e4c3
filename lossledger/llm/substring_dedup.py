"""Repeated stretches of words found by grouping their windows, split by prefix; no suffix tree is built.

A stretch of `WIDTH` words is removed from a document when the same words also start in a
document with a smaller id. Only suffixes that can be part of such a stretch become leaves:

1. Sampled windows (see `repeats`) give one lead for each run of windows; leads that occur in
   one document only are left behind after an aggregation.
2. A run whose whole text occurs in an earlier document is removed as a whole. One run for each
   other text goes on, and each of its windows is a suffix, cut at `WIDTH` words.
3. Suffixes are split into groups by a prefix of variable length: the shortest of `DEPTHS`
   words that has at most `GROUP_ROWS` suffixes, so a group fits in a task's memory. A prefix
   of full depth that is still more frequent is one deep node, and is aggregated instead.
4. In each group, equal windows of `WIDTH` words are found by their fingerprint, and the least
   document of each keeps its words. Suffixes are not ordered and there are no inner nodes, so no
   repeat is known to be longer than `WIDTH`; longer ones are covered window by window.

Defined results: null is no words, and gives the digest of an empty text; words are judged on
the input; rows with equal ids are separate documents that neither precedes; null ids come
after all others. Texts of fewer than `WIDTH` words stay whole.
An empty table gives no rows; a text is compared whole, however long, one task holding it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch, identified, public_id
from lossledger.llm.features import rounds
from lossledger.llm.hashing import batch_bytes, window_hashes
from lossledger.llm.repeats import covered, word_hashes, word_runs

#: Words of a stretch, and of a lead.
WIDTH, GRAM = 13, 4
#: Prefix lengths that groups are made of, and the suffixes of a group at most.
DEPTHS, GROUP_ROWS = (4, 7, 10, 13), 200_000


def _leads(batches):
    for batch in batches:
        ords = batch.column("ord").to_numpy()
        for runs in word_runs(batch, WIDTH, GRAM):
            yield pa.RecordBatch.from_arrays([pa.array(runs.lead.view(np.int64)), pa.array(ords[runs.row])], ["lead", "ord"])


def _entries(batches):
    names = ["lead", "hull", "row", "ord", "start", "length"]
    for batch in batches:
        rows, ords = batch.column("row").to_numpy(), batch.column("ord").to_numpy()
        for runs in word_runs(batch, WIDTH, GRAM):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(runs.lead.view(np.int64)),
                    pa.array(runs.hull.view(np.int64)),
                    pa.array(rows[runs.row]),
                    pa.array(ords[runs.row]),
                    pa.array(runs.start.astype(np.int32)),
                    pa.array(runs.length.astype(np.int32)),
                ],
                names,
            )


def _suffixes(batches):
    """text, ord, runs (lead, hull, start, length) -> the suffixes of those runs with their prefixes."""
    names = ["lead", "hull", "at", "ord", *(f"p{d}" for d in DEPTHS)]
    for batch in batches:
        for part in rounds(batch):
            words, first, *_ = word_hashes(part.column("text"))
            prefixes = [window_hashes(words, d) for d in DEPTHS]
            columns = [[] for _ in names]
            entries = zip(part.column("ord").to_pylist(), part.column("runs").to_pylist(), first[:-1], strict=True)
            for order, runs, base in entries:
                start = np.array([r["start"] for r in runs], dtype=np.int64)
                length = np.array([r["length"] for r in runs], dtype=np.int64)
                before = np.cumsum(length) - length
                at = np.arange(int(length.sum())) - np.repeat(before, length)
                place = base + np.repeat(start, length) + at
                values = [
                    np.repeat(np.array([r["lead"] for r in runs], dtype=np.int64), length),
                    np.repeat(np.array([r["hull"] for r in runs], dtype=np.int64), length),
                    at,
                    np.full(len(at), order, dtype=np.int64),
                    *(p[place].view(np.int64) for p in prefixes),
                ]
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)


def _remove(batches):
    """row, ord, text, ranges -> row, ord, n_words, n_removed, kept_sha256, kept."""
    names = ["row", "ord", "n_words", "n_removed", "kept_sha256", "kept"]
    for batch in batches:
        for part in rounds(batch):
            _, first, starts, ends, _ = word_hashes(part.column("text"))
            raw = batch_bytes(part.column("text"))[0].tobytes()
            removed, digests, texts = [], [], []
            for i, ranges in enumerate(part.column("ranges").to_pylist()):
                lo, hi = int(first[i]), int(first[i + 1])
                stay = np.arange(lo, hi)
                if ranges:
                    start = np.array([r["start"] for r in ranges], dtype=np.int64)
                    length = np.array([r["length"] for r in ranges], dtype=np.int64)
                    stay = stay[~covered(hi - lo, start, length, WIDTH)]
                kept = b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                removed.append(hi - lo - len(stay))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("ord"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names,
            )


def deep_nodes(suffixes: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """(lead, hull, at) of the suffixes whose node of full depth holds a smaller document.

    `suffixes` is a stored table, as `_suffixes` gives it.
    """
    full = f"p{DEPTHS[-1]}"
    named, group = suffixes, F.col(f"p{DEPTHS[0]}")
    still = suffixes  # suffixes whose prefixes so far are all too frequent
    for shorter, longer in zip(DEPTHS[:-1], DEPTHS[1:], strict=True):
        heavy = still.groupBy(f"p{shorter}").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(f"p{shorter}")
        if not heavy.take(1):
            break
        # A prefix that is too frequent has a shorter one that is, so the flag alone tells.
        named = named.join(heavy.withColumn(f"heavy{shorter}", F.lit(True)), f"p{shorter}", "left")
        still = still.join(heavy, f"p{shorter}", "left_semi")
        group = F.when(F.col(f"heavy{shorter}"), F.col(f"p{longer}")).otherwise(group)
    node = ["lead", full]
    sizes = suffixes.groupBy(*node).agg(F.min("ord").alias("least"), F.count("*").alias("n"))
    single = sizes.where(F.col("n") > limit).select(*node, "least")
    rest = named.withColumn("grp", group)
    out = []
    if single.take(1):
        heavy = suffixes.join(single, node).where(F.col("ord") > F.col("least")).select("lead", "hull", "at")
        out.append(heavy)
        rest = rest.join(single.select(*node), node, "left_anti")
    tree = rest.repartition("grp").withColumn("least", F.min("ord").over(Window.partitionBy("grp", *node)))
    out.append(tree.where(F.col("ord") > F.col("least")).select("lead", "hull", "at"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def repeated_ranges(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """(row, ranges): for each row of (row, ord, text) the windows to remove, as (start, length)."""
    body = texts.select("row", "ord", "text").where(F.octet_length("text") >= 2 * WIDTH - 1)
    leads = body.select("ord", "text").mapInArrow(_leads, "lead long, ord long")
    spread = leads.groupBy("lead").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    shared = scratch.store(spread.where("lo < hi").select("lead"), "shared")
    entries = body.mapInArrow(_entries, "lead long, hull long, row long, ord long, start int, length int")
    entries = scratch.store(entries.join(shared, "lead", "left_semi"), "entries")

    place = F.struct("ord", "row", "start", "length")
    hulls = scratch.store(entries.groupBy("lead", "hull").agg(F.min(place).alias("at")), "hulls")
    owners = hulls.select("lead", "hull", F.col("at.ord").alias("owner"))
    # A hull of the lead's least document needs no comparison if that document has no other.
    several = hulls.groupBy("lead").agg(F.min("at.ord").alias("lo"), F.max("at.ord").alias("hi")).where("lo < hi").select("lead")
    runs = hulls.join(several, "lead", "left_semi").groupBy(F.col("at.row").alias("row")).agg(
        F.collect_list(F.struct("lead", "hull", "at.start", "at.length")).alias("runs")
    )
    kinds = ", ".join(f"p{d} long" for d in DEPTHS)
    suffixes = body.join(runs, "row").mapInArrow(_suffixes, f"lead long, hull long, at long, ord long, {kinds}")
    suffixes = scratch.store(suffixes, "suffixes")
    repeats = scratch.store(deep_nodes(suffixes), "repeats")

    listed = repeats.groupBy("lead", "hull").agg(F.collect_list("at").alias("found"))  # at most the run's windows
    verdicts = scratch.store(owners.join(listed, ["lead", "hull"], "left"), "verdicts")
    # One join with one row for each hull: a hull in a third of all documents can be split.
    named = entries.join(verdicts, ["lead", "hull"])
    whole = named.where("ord > owner").select("row", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    parts = named.where("ord = owner").select("row", F.explode("found").alias("at"), "start").select(
        "row", (F.col("start") + F.col("at")).alias("start"), F.lit(1).cast("long").alias("length")
    )
    ranges = whole.unionByName(parts).groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("ranges"))
    out = scratch.store(ranges, "ranges")
    scratch.drop(shared, entries, hulls, suffixes, repeats, verdicts)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (words joined by a space) of every document."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    texts = identified(scratch, docs)
    joined = texts.join(repeated_ranges(scratch, texts), "row", "left").select("row", "ord", "text", "ranges")
    done = joined.mapInArrow(_remove, "row long, ord long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.select(public_id("ord").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
