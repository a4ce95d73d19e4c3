"""Best-fit packing of documents into training sequences, with conflicts.

A sequence holds `CAPACITY` words (each document takes its words and one end mark). Longer
documents are cut into full pieces and a rest. A bin never holds two pieces of one source, nor
two of one duplicate cluster; pieces without a source (or cluster) don't conflict in it.

Pieces are spread over shards by a hash of their document, so a hot source or cluster is
spread evenly, and a shard has about `SHARD_ROWS` pieces whatever the size of the table. In a
shard, longest first, each piece goes to the compatible bin with the least room that still fits:
bins stand in the order of their residual, each with a bitmap of its sources and clusters, and
the search goes from the first residual that fits to the next until a bin is compatible. A tree
over the residuals keeps the sources common to all bins below each node, which skips stretches
of bins that a hot source has filled. Only (id, length, source, cluster) is shuffled.

Defined results: null and empty texts are pieces of length one (the end mark); rows that share
an id are separate documents, told apart by `row`; an empty table gives no bins.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch, identified, public_id

#: Words in a sequence, and pieces that one task packs (about).
CAPACITY, SHARD_ROWS = 2048, 20_000


class Bins:
    """Open bins of one shard by residual, with a search for the tightest compatible one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        #: For each residual: bins by the bitmap of their sources.
        self.slots: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        #: Sources that all bins below a node have; -1 (all bits) where there is no bin.
        self.common = [-1] * (2 * self.leaves)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.room: list[int] = []

    def _update(self, residual: int) -> None:
        common = -1
        for bits in self.slots[residual]:
            common &= bits
        node = self.leaves + residual
        self.common[node] = common
        node >>= 1
        while node:
            both = self.common[2 * node] & self.common[2 * node + 1]
            if self.common[node] == both:
                break
            self.common[node] = both
            node >>= 1

    def _next(self, residual: int, source: int) -> int:
        """The least residual from `residual` on at which some bin lacks the source; -1 if none."""
        node = self.leaves + residual
        while self.common[node] == -1 or self.common[node] & source:
            while node & 1:  # a right child: go up
                node >>= 1
                if node <= 1:
                    return -1
            node += 1
        while node < self.leaves:
            node *= 2
            if self.common[node] == -1 or self.common[node] & source:
                node += 1
        return node - self.leaves

    def find(self, length: int, source: int, cluster: int) -> int:
        """The compatible bin of least room for a piece, the oldest of equals; -1 if there is none."""
        residual = self._next(length, source) if length <= self.capacity else -1
        while residual >= 0:
            fits = [
                number
                for bits, numbers in self.slots[residual].items()
                if not bits & source
                for number in numbers
                if not self.clusters[number] & cluster
            ]
            if fits:
                return min(fits)
            residual = self._next(residual + 1, source) if residual < self.capacity else -1
        return -1

    def put(self, number: int, length: int, source: int, cluster: int) -> int:
        """Place a piece in a bin (a new one for -1); returns the bin's number."""
        if number < 0:
            number = len(self.room)
            self.sources.append(0)
            self.clusters.append(0)
            self.room.append(self.capacity)
        else:
            old, bits = self.room[number], self.sources[number]
            held = self.slots[old][bits]
            held.remove(number)
            if not held:
                del self.slots[old][bits]
                self._update(old)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self.room[number] -= length
        residual, bits = self.room[number], self.sources[number]
        new = bits not in self.slots[residual]
        self.slots[residual].setdefault(bits, []).append(number)
        if new:
            self._update(residual)
        return number


def _bits(values: list) -> list[int]:
    """A bit for each value that occurs more than once; others can't conflict."""
    seen: dict = defaultdict(int)
    for v in values:
        if v is not None:
            seen[v] += 1
    order = {v: 1 << i for i, v in enumerate(v for v, n in seen.items() if n > 1)}
    return [order.get(v, 0) for v in values]


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset in the bin, and room left at the end, for pieces in the order they are placed."""
    bins = Bins(capacity)
    placed, offsets = [], []
    for length, source, cluster in zip(lengths, _bits(sources), _bits(clusters), strict=True):
        number = bins.put(bins.find(length, source, cluster), length, source, cluster)
        placed.append(number)
        offsets.append(capacity - bins.room[number] - length)
    return placed, offsets, [bins.room[n] for n in placed]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, bin, offset, doc_id, piece, first_word, length, room, row for every piece.

    The end mark counts as the last word of a document's last piece.

    `docs` needs doc_id and text; a column `source` and a column `cluster` are used if there.
    Without `cluster`, texts that are equal but for case and white space form a cluster.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    cluster = F.col("cluster").cast("string") if "cluster" in docs.columns else F.when(plain != "", F.md5(plain))
    facts = docs.select("doc_id", "text", source.alias("source"), cluster.alias("cluster"))
    named = identified(scratch, facts, ("source", "cluster"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    lengths = scratch.store(named.select("row", "ord", words.alias("words"), "kept_source", "kept_cluster"), "lengths")
    cut = F.lit(capacity)
    pieces = lengths.select(
        "row", "ord", "kept_source", "kept_cluster", "words",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / cut).cast("int"))).alias("piece"),
    )
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select(
        "row", "ord", "piece", first.alias("first_word"), F.least(cut.cast("long"), F.col("words") - first).alias("length"),
        F.col("kept_source").alias("source"), F.col("kept_cluster").alias("cluster"),
    )
    count = lengths.agg(F.sum(F.ceil(F.col("words") / cut))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_rows))

    def run(pdf):
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        none = lambda column: [v if isinstance(v, str) else None for v in pdf[column]]
        placed, offsets, room = pack(pdf["length"].tolist(), none("source"), none("cluster"), capacity)
        return pdf[["shard", "row", "ord", "piece", "first_word", "length"]].assign(bin=placed, offset=offsets, room=room)

    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    packed = spread.groupBy("shard").applyInPandas(
        run, "shard int, row long, ord long, piece int, first_word long, length long, bin int, offset long, room long"
    )
    return packed.select(
        "shard", "bin", "offset", public_id("ord").alias("doc_id"), "piece", "first_word", "length", "room", "row"
    )
