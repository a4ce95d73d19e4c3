"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact checks.

A document's set holds its distinct shingles of five lower-cased words (with fewer words, the
whole sequence as one). Equal sets form a class, and one representative of each goes on.

Candidates share a band of their MinHash signature. A band bucket may hold a third of the
corpus, so its members are not paired with each other: they meet a hub of the bucket, links
merge them into components, and only buckets that still span several components go on. There a
member that shares too few shingles with all other components together leaves: it can have no
link to them. The others meet a second hub, the set that most of a family's shingles come from,
and what they may still link shares shingles outside that hub (`_Search.remainders` says why).
So the many copies of a text that are just not similar enough are settled by one comparison
each. No bucket is capped.

A candidate's signatures are compared a batch at a time. With c agreements among m values and a
flat prior the similarity is Beta(c+1, m-c+1) distributed; a pair is dropped as soon as the
probability of reaching the threshold falls below `MISS`. What survives is decided on the full
sets of both texts.

Defined results: null and empty texts (and texts without words) have an empty set, link with
nothing and stay; rows that share an id, or have none, are documents of their own, and their
component's id is the smallest id in it (null only where no member has an id).
An empty table gives no rows; a text is compared whole, however long, one task holding it.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch, identified, public_id
from lossledger.llm.features import ROUND_ROWS, rounds
from lossledger.llm.hashing import (
    LOWER,
    SPACED,
    batch_bytes,
    mix,
    prefix_sums,
    span_hashes,
    window_hashes,
    within_rows,
    word_spans,
)

SHINGLE = 5
#: Bands and rows of each: a pair of similarity 0.75 shares no band once in 50,000 times.
BANDS, BAND_ROWS = 40, 5
HASHES = BANDS * BAND_ROWS
#: Similarity in percent, signature values in a batch, and the probability of dropping a true pair.
PERCENT, BATCH, MISS = 75, 20, 1e-7
#: Pairs a row of a bucket may take before the bucket gets another hub.
PAIRS = 16

_SALTS = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))
_ODDS = mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_BAND_SALTS = mix(np.arange(9001, 9001 + BANDS, dtype=np.uint64))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the distinct shingles of every text, sorted by row, and the first index of each row."""
    raw, offsets = batch_bytes(column)
    raw = LOWER[raw]
    n = len(offsets) - 1
    starts, ends, first = word_spans(raw, offsets, SPACED)
    words = span_hashes(prefix_sums(raw), starts, ends)
    counts = np.diff(first)
    at = within_rows(first, SHINGLE)
    keys = [window_hashes(words, SHINGLE)[at]] if len(at) else []
    rows = [np.repeat(np.arange(n), np.maximum(counts - SHINGLE + 1, 0))]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(counts == k)
        if len(short):
            keys.append(mix(window_hashes(words, k)[first[short]] + np.uint64(k)))
            rows.append(short)
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    row = np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(n + 1))


def signatures(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, one row of `HASHES` for each set that isn't empty."""
    begins = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begins), HASHES), dtype=np.uint64)
    if len(begins):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((key ^ _SALTS[k]) * _ODDS[k], begins)
    return out


def _describe(batches):
    """row, ord, text -> row, ord, n, two digests of the set, band keys, signature (16 bits a value)."""
    names = ["row", "ord", "n", "d1", "d2", "bands", "sig"]
    for batch in batches:
        for part in rounds(batch, rows=ROUND_ROWS):
            key, first = shingle_sets(part.column("text"))
            n = np.diff(first)
            has = n > 0
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands = np.zeros((len(n), BANDS), np.uint64)
            sig = np.zeros((len(n), HASHES), np.uint16)
            if has.any():
                begins = first[:-1][has]
                d1[has] = np.add.reduceat(mix(key ^ np.uint64(0x5851F42D4C957F2D)), begins)
                d2[has] = np.add.reduceat(mix(key ^ np.uint64(0x14057B7EF767814F)), begins)
                mins = signatures(key, first)
                sig[has] = (mins >> np.uint64(48)).astype(np.uint16)
                groups = mix(mins).reshape(-1, BANDS, BAND_ROWS)
                band = np.zeros((len(groups), BANDS), np.uint64)
                for k in range(BAND_ROWS):
                    band = mix(band * np.uint64(0xD1342543DE82EF95) + groups[:, :, k])
                bands[has] = mix(band + _BAND_SALTS)
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("ord"),
                    pa.array(n.astype(np.int64)),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, BANDS * (len(n) + 1), BANDS, dtype=np.int32), flat),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                ],
                names,
            )


def least_agreements(percent: int = PERCENT, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """For each number of compared values, the agreements below which a pair is dropped.

    P(similarity >= t) under Beta(c+1, m-c+1) equals P(Binomial(m+1, t) <= c).
    """
    t, out = percent / 100, []
    for m in range(batch, HASHES + 1, batch):
        c, total = -1, 0.0
        while total < miss:
            c += 1
            total += comb(m + 1, c) * t**c * (1 - t) ** (m + 1 - c)
        out.append((m, c))
    return out


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), np.uint16) for x in column]).reshape(len(column), HASHES)


def _prune(batches):
    """node, hub, sig_a, sig_b -> the pairs (node, hub) that can still reach the threshold."""
    bounds = least_agreements()
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (_signature_matrix(batch.column(c)) for c in ("sig_a", "sig_b"))
        alive, agreed, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
        for m, least in bounds:
            agreed = agreed + (a[alive, done:m] == b[alive, done:m]).sum(axis=1)
            keep = agreed >= least
            alive, agreed, done = alive[keep], agreed[keep], m
        yield batch.select(["node", "hub"]).take(pa.array(alive))


def _confirm(batches):
    """node, hub, text_a, text_b -> the pairs whose full sets are similar enough."""
    for batch in batches:
        for part in rounds(batch, "text_a", rows=ROUND_ROWS):
            n = part.num_rows
            (ka, fa), (kb, fb) = shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b"))
            size_a, size_b = np.diff(fa), np.diff(fb)
            key = np.concatenate([ka, kb])
            row = np.concatenate([np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)])
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            both = row[1:][(key[1:] == key[:-1]) & (row[1:] == row[:-1])]
            common = np.bincount(both, minlength=n)
            linked = 100 * common >= PERCENT * (size_a + size_b - common)
            yield part.select(["node", "hub"]).filter(pa.array(linked))


def _shingles(batches):
    """node, comp, text -> a row for each shingle of each set."""
    for batch in batches:
        for part in rounds(batch, rows=ROUND_ROWS):
            key, first = shingle_sets(part.column("text"))
            size = np.diff(first)
            node, comp = (np.repeat(part.column(c).to_numpy(), size) for c in ("node", "comp"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(node), pa.array(comp)], ["shingle", "node", "comp"]
            )


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node reachable.

    Labels spread along edges and jump to their label's label; each step is a stored table.
    """
    both = scratch.store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = scratch.store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("best"))
        )
        spread = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "best").alias("mid"))
        jumps = labels.select(F.col("node").alias("mid"), F.col("comp").alias("next"))
        step = spread.join(jumps, "mid", "left").select("node", "was", F.coalesce("next", "mid").alias("comp"))
        moved = scratch.store(step, "labels")
        changed = moved.where("was <> comp").limit(1).count()
        scratch.drop(labels)
        labels = moved.drop("was")
        labels._stored_at = moved._stored_at
        if not changed:
            scratch.drop(both)
            return labels


class _Search:
    """The state of one run: buckets, what was compared, and the components so far."""

    def __init__(self, scratch: Scratch, members: DataFrame, details: DataFrame):
        self.scratch, self.members, self.details = scratch, members, details
        self.tried: list[DataFrame] = []
        self.comps: DataFrame | None = None
        self.foreign: DataFrame | None = None

    def with_comp(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.comps is None:
            return df.withColumn(name, F.col(column))
        known = self.comps.select(F.col("node").alias(column), F.col("comp").alias("found"))
        return df.join(known, column, "left").withColumn(name, F.coalesce("found", column)).drop("found")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The linked ones among stored pairs (node, hub)."""
        sigs = self.details.select("node", "sig")
        left = pairs.join(sigs.withColumnRenamed("sig", "sig_a"), "node")
        right = sigs.select(F.col("node").alias("hub"), F.col("sig").alias("sig_b"))
        alive = self.scratch.store(left.join(right, "hub").mapInArrow(_prune, "node long, hub long"), "alive")
        texts = self.details.select("node", "text")
        left = alive.join(texts.withColumnRenamed("text", "text_a"), "node")
        right = texts.select(F.col("node").alias("hub"), F.col("text").alias("text_b"))
        links = self.scratch.store(left.join(right, "hub").mapInArrow(_confirm, "node long, hub long"), "links")
        self.scratch.drop(alive)
        return links

    def advance(self, pairs: DataFrame) -> bool:
        """Compare pairs (node, hub) of different components; False if there were none."""
        pairs = self.with_comp(self.with_comp(pairs, "node", "ca"), "hub", "cb").where("ca <> cb").select("node", "hub")
        for known in self.tried:
            pairs = pairs.join(known, ["node", "hub"], "left_anti")
        pairs = self.scratch.store(pairs, "pairs")
        if not pairs.take(1):
            return False
        links = self.verify(pairs)
        self.tried.append(pairs)
        if not links.take(1):
            return True
        edges = self.with_comp(self.with_comp(links, "node", "a"), "hub", "b").select("a", "b")
        found = components(self.scratch, edges)
        if self.comps is None:
            self.comps = found
        else:
            new = found.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            moved = self.comps.join(new, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
            # Nodes that had no component of their own before.
            fresh = found.join(self.comps.select("node"), "node", "left_anti")
            self.comps = self.scratch.store(moved.unionByName(fresh), "comps")
        return True

    def open_members(self) -> DataFrame:
        """Members (key, node, n, comp, h) of buckets that span several components.

        `h` is the best set of the bucket to meet first: of the sets with the largest part that other
        components have too, the one whose shingles occur most often. Members that can't link to another component are left out, for
        good, as components only grow together: of a set of n shingles, 3 (n + m) / 7 must be
        shared with a set of m. `foreign` keeps those shingles by node.
        """
        named = self.with_comp(self.members, "node", "comp")
        span = self.scratch.store(self._spanning(named, F.min("n").alias("least")), "open")
        if not span.take(1):
            return span
        least = F.greatest(F.min("least"), F.ceil(F.col("n") * PERCENT / 100))
        nodes = span.groupBy("node", "n", "comp").agg(least.alias("m"))
        texts = self.details.select("node", "text").join(nodes.select("node", "comp"), "node")
        shingles = self.scratch.store(texts.mapInArrow(_shingles, "shingle long, node long, comp long"), "shingles")
        spread = shingles.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df"))
        shared = shingles.join(spread.where("lo <> hi").select("shingle", "df"), "shingle").groupBy("node")
        # A set fits into a task, as its text does.
        held = shared.agg(F.count("*").alias("o"), F.sum("df").alias("fame"), F.collect_list("shingle").alias("shingles"))
        able = nodes.join(held, "node").where(F.col("o") * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("m")))
        able = able.select("node", (F.col("o") / F.col("n")).alias("share"), "fame", "shingles")
        self.foreign = self.scratch.store(able, "foreign")
        rest = span.drop("least").join(self.foreign.select("node", "share", "fame"), "node")
        fewer = self._spanning(rest, F.max(F.struct("share", "fame", "n", "node")).alias("h"))
        fewer = self.scratch.store(fewer.drop("share", "fame"), "open")
        self.scratch.drop(shingles, span)
        self.members = fewer.select("key", "node", "n")
        return fewer

    def centred(self, span: DataFrame) -> DataFrame:
        """(hub, hub_n, node, n, comp): every bucket's members met a hub, which need not be one of them.

        The hub is a set most of which others have too: the text that copies were made from, where
        it is there. Buckets take the best hub that any member has in another bucket, so the
        buckets of one family of texts share a hub and become one group.
        """
        best = span.groupBy("node").agg(F.max("h").alias("h"))
        hubs = span.drop("h").join(best, "node").groupBy("key").agg(F.max("h").alias("h"))
        groups = span.drop("h").join(hubs, "key").select(F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), "node", "n").distinct()
        groups = self.scratch.store(groups, "groups")
        pairs = groups.where(_alike("n", "hub_n") & (F.col("node") != F.col("hub"))).select("node", "hub")
        self.advance(pairs)
        return self.with_comp(self.with_comp(groups, "node", "comp"), "hub", "hub_comp")

    def remainders(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What a group may still link: sets that share shingles outside the hub, and small sets.

        Let sets A and B of different components have met hub H. One of them, say B, has no link
        to H: 7 |B & H| < 3 (|B| + |H|). A link of A and B needs 7 |A & B| >= 3 (|A| + |B|). If
        all they share lies in H, |A & B| <= |B & H|, so A is smaller than H. All other links
        share shingles outside the hub, so sets that differ from it in ways of their own meet nobody.
        """
        mine = self.foreign.select("node", F.col("shingles").alias("mine"))
        theirs = self.foreign.select(F.col("node").alias("hub"), F.col("shingles").alias("theirs"))
        split = groups.where("node <> hub").join(mine, "node").join(theirs, "hub")
        outer = F.array_except("mine", "theirs")
        columns = ["hub", "node", "n", "comp", (F.col("comp") != F.col("hub_comp")).alias("apart"), "hub_n"]
        split = self.scratch.store(
            split.select(*columns, outer.alias("outer"), (F.size("mine") - F.size(outer)).alias("inner")), "split"
        )
        # The size of the largest partner if all that is shared lies in the hub.
        room = F.floor((100 + PERCENT) * F.col("inner") / PERCENT) - F.col("n")
        within = split.select("hub", "node", "n", "comp", "apart", "hub_n", "inner", room.alias("room"))
        bounds = within.groupBy("hub").agg(
            F.min("n").alias("least"), F.min(F.when(F.col("apart"), F.col("n"))).alias("least_apart")
        )
        small = (F.col("n") < F.col("hub_n")) & (F.col("room") >= F.col("least_apart"))
        lone = F.col("apart") & (F.col("room") >= F.col("least"))
        within = within.join(bounds, "hub").where(small | lone).withColumn("small", small).withColumn("lone", lone)

        placed = split.select("hub", F.explode("outer").alias("shingle"), "node", "n", "comp", "inner")
        placed = self.scratch.store(placed, "placed")
        spans = placed.groupBy("hub", "shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("m"))
        placed = placed.join(spans.where("lo <> hi").select("hub", "shingle", "m"), ["hub", "shingle"])
        most = placed.groupBy("hub", "node").agg(F.count("*").alias("o"), F.min("m").alias("m"))
        partner = F.greatest("m", F.ceil(F.col("n") * PERCENT / 100))
        can = (F.col("inner") + F.col("o")) * (100 + PERCENT) >= PERCENT * (F.col("n") + partner)
        placed = placed.drop("m").join(most, ["hub", "node"]).where(can).drop("o", "m")
        return self.scratch.store(placed, "placed"), self.scratch.store(within, "within")

    @staticmethod
    def _spanning(named: DataFrame, told: Column) -> DataFrame:
        """The rows of buckets with several components, and what `told` says of their bucket."""
        keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), told)
        return named.join(keys.where("lo <> hi").drop("lo", "hi"), "key")


def _alike(a: str, b: str) -> Column:
    """Set sizes that leave room for the threshold."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _settle(search: _Search, span: DataFrame) -> None:
    """All links between the components that a bucket still spans.

    Members of a group that share a shingle outside its hub form a smaller bucket, and so do the
    small sets; these are paired once that takes at most `PAIRS` for each row, or when another
    round of hubs would not halve them.
    """
    before = None
    while True:
        groups = search.centred(span)
        across = groups.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        placed, within = search.remainders(groups.join(across.select("hub"), "hub", "left_semi"))
        buckets = placed.groupBy("hub", "shingle").agg(F.count("*").alias("rows"), (F.count("*") * F.count("*")).alias("pairs"))
        ends = F.sum(F.col("small").cast("long")) * F.sum(F.col("lone").cast("long"))
        small = within.groupBy("hub").agg(F.count("*").alias("rows"), ends.alias("pairs"))
        buckets = buckets.select("rows", "pairs").union(small.select("rows", "pairs"))
        rows, pairs = buckets.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if pairs <= PAIRS * rows or (before is not None and 2 * pairs > before):
            search.advance(_facing(placed, within))
            return
        before = pairs
        narrower = placed.select(F.xxhash64("hub", "shingle").alias("key"), "node", "n")
        narrower = narrower.union(within.select(F.xxhash64("hub").alias("key"), "node", "n"))
        search.members = search.scratch.store(narrower, "members")
        span = search.open_members()
        if not span.take(1):
            return


def _facing(placed: DataFrame, within: DataFrame) -> DataFrame:
    """The pairs (node, hub) of `remainders` that share enough shingles to be compared."""
    across = _alike("n", "other_n") & (F.col("comp") != F.col("other_comp"))
    # No two sets share more than the smaller inner part and the shingles both have outside the hub.
    fits = (100 + PERCENT) * (F.least("inner", "other_inner") + F.col("met")) >= PERCENT * (F.col("n") + F.col("other_n"))

    def other(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.select(*keys, *(F.col(c).alias(f"other_{c}") for c in ("node", "n", "comp", "inner")))

    keys = ["hub", "shingle"]
    outside = placed.join(other(placed, keys), keys).where(across & (F.col("node") > F.col("other_node")))
    outside = outside.groupBy("hub", "node", "other_node", "n", "other_n", "inner", "other_inner").agg(F.count("*").alias("met"))
    inside = within.where("small").join(other(within.where("lone"), ["hub"]), "hub").where(across).withColumn("met", F.lit(0))
    ends = [F.greatest("node", "other_node").alias("node"), F.least("node", "other_node").alias("hub")]
    return outside.where(fits).select(*ends).union(inside.where(fits).select(*ends)).distinct()


def _decide(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """row, ord, n, root (least id of the group), comp (the group; null for empty sets)."""
    described = scratch.store(
        texts.select("row", "ord", "text").mapInArrow(
            _describe, "row long, ord long, n long, d1 long, d2 long, bands array<long>, sig binary"
        ),
        "sets",
    )
    classes = scratch.store(
        described.where("n > 0")
        .groupBy("d1", "d2", "n")
        .agg(F.min("row").alias("node"), F.min("ord").alias("least")),
        "classes",
    )
    reps = described.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    exploded = scratch.store(reps.select(F.explode("bands").alias("key"), F.col("row").alias("node"), "n"), "bands")
    shared = exploded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.store(exploded.join(shared.select("key"), "key", "left_semi"), "members")
    scratch.drop(exploded)
    wanted = members.select(F.col("node").alias("row")).distinct()
    candidates = described.select("row", "sig").join(wanted, "row").join(texts.select("row", "text"), "row")
    search = _Search(scratch, members, scratch.store(candidates.withColumnRenamed("row", "node"), "details"))

    hubs = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h"))
    met = (
        members.join(hubs, "key")
        .where(_alike("n", "h.n") & (F.col("node") != F.col("h.node")))
        .select("node", F.col("h.node").alias("hub"))
        .distinct()
    )
    search.advance(met)
    span = search.open_members()
    if span.take(1):
        _settle(search, span)

    named = search.with_comp(classes, "node", "comp")
    roots = named.groupBy("comp").agg(F.min("least").alias("root"))
    groups = scratch.store(named.join(roots, "comp").select("d1", "d2", "n", "comp", "root"), "groups")
    # A class of copies may be as hot as the corpus; the other side has one row for each class.
    found = described.select("row", "ord", "n", "d1", "d2").join(groups, ["d1", "d2", "n"], "left")
    return found.select("row", "ord", "n", F.coalesce("root", "ord").alias("root"), "comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    return _decide(scratch, identified(scratch, docs)).select(
        public_id("ord").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        public_id("root").alias("component_id"),
        (F.col("root") == F.col("ord")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns; empty sets all stay.

    It is a row with the group's smallest id, the first in the run's numbering where several have it.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    texts = identified(scratch, docs.select("doc_id", "text", whole.alias("doc")), keep=("doc",))
    decided = scratch.store(_decide(scratch, texts), "decided")
    winners = decided.where("comp is not null and root = ord").groupBy("comp").agg(F.min("row").alias("row")).select("row")
    stay = winners.union(decided.where("comp is null").select("row"))
    return texts.join(stay, "row", "left_semi").select("kept_doc.*")
