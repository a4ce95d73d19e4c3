"""A prefix trie of conversations by collapsing whole sequences.

`rebuild` gives each conversation its turns as digests, one row a turn. `collapse` groups equal
conversations into one weighted sequence and marks the leaves: sequences that are no proper
prefix of another, found by an anti-join. `trie` aggregates the weighted prefixes of the distinct
sequences into nodes, so a hot opening or a hot whole conversation costs one row a sequence.

A node is known by a digest of its turns: the XOR of two 64-bit hashes of every (depth, role,
text). The running XOR along a conversation, like its turn numbers, is computed in pieces cut by a
range partitioning, each at most a partition long, and pieces are joined by their totals: one
conversation may hold a third of all turns.

A subtree's saved tokens take no pass over pairs of nodes: with T the words of a sequence and B
the words before the first node that it owns (a node is owned by the sequence of the smallest
conversation through it, so a sequence owns a tail of its nodes), both the sum over members and
the sum over distinct nodes are sums over the sequences that pass the node.

Defined results: rows without conv_id take no part; null role or text is empty; turns sort
by number, null first, and equal numbers by a hash of role and text; repeated rows are turns of their own;
conversation c builds on c - (c mod 20) with a mod of at least 0 for negative ids; other columns
are not read; a text counts whole, however long; an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch

#: Every conversation is rebuilt on the first of this many.
FAMILY = 20
#: Most turns taken over from it, less one.
TAKEN = 4
#: Turns of one range partition, on average.
PIECE_TURNS = 1 << 20
#: Conversation ids that are written together before they meet those of other tasks.
CHUNK = 8192

PIECE = ["conv_id", "part"]
NODE = ["depth", "d1", "d2"]


def _n_words(text: Column) -> Column:
    """Count of `[^\\x20\\x09-\\x0D]+` in a text: its non-spaces that follow a space or the start."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _running(window: Window, column: str) -> Column:
    return F.bit_xor(column).over(window)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, k, t1, t2, words): turns in order within pieces of conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), role, text).alias("t2"),
        _n_words(text).alias("words"),
    )
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), conversations.count() // PIECE_TURNS)
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    cut = slim.repartitionByRange(parts, F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy(*PIECE).orderBy(*order)).cast("long")
    return cut.select(*PIECE, number.alias("k"), "t1", "t2", "words")


def rebuild(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, d1, d2, p1, p2, words, upto) a rebuilt turn, and the same of each whole conversation.

    d1, d2 are the digest of the turns up to this one, p1, p2 of those before it; `upto` counts the
    words up to and with this turn. Whole conversations (conv_id, length, d1, d2, total) hold turnless ones too.
    """
    turns = scratch.store(_turns(conversations), "turns")
    sizes = turns.groupBy(*PIECE).agg(F.count("*").alias("n"))
    # A conversation has no more pieces than the range partitioning has partitions.
    along = Window.partitionBy("conv_id").orderBy("part")
    pieces = sizes.withColumns(
        {"before": F.sum("n").over(along) - F.col("n"), "n_own": F.sum("n").over(Window.partitionBy("conv_id"))}
    )
    # The first turns of each family's first conversation: at most three rows a conversation.
    firsts = (
        turns.where(F.expr(f"pmod(conv_id, {FAMILY}) = 0")).join(pieces, PIECE).withColumn("at", F.col("before") + F.col("k"))
    ).where(F.col("at") < TAKEN)
    heads = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "t1", "t2", "words"))).alias("head"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(TAKEN))
    info = (
        pieces.withColumns({"h": taken, "base": F.expr(f"conv_id - pmod(conv_id, {FAMILY})")})
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
        .drop("base", "n")
    )
    info = scratch.store(info, "pieces")
    own = turns.join(info.drop("n_own"), PIECE).withColumn("at", F.col("before") + F.col("k")).where("at > h")
    own = own.select(*PIECE, (F.col("at") - F.col("h") + F.size("head")).alias("depth"), "t1", "t2", "words")
    # Turns taken over are a piece before all others.
    ends = info.groupBy("conv_id").agg(F.max("n_own").alias("n_own"), F.max("h").alias("h"), F.any_value("head").alias("head"))
    head = ends.select("conv_id", F.lit(-1).alias("part"), F.posexplode("head")).select(
        *PIECE, (F.col("pos") + 1).cast("long").alias("depth"), "col.t1", "col.t2", "col.words"
    )
    placed = own.unionByName(head).select(
        *PIECE, "depth", "words", F.xxhash64("depth", "t1", "t2").alias("x1"), F.xxhash64("t2", "depth", "t1").alias("x2")
    )
    within = Window.partitionBy(*PIECE).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = scratch.store(
        placed.withColumns({"l1": _running(within, "x1"), "l2": _running(within, "x2"), "lw": F.sum("words").over(within)}),
        "local",
    )
    totals = local.groupBy(*PIECE).agg(
        F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.sum("words").alias("sw"), F.count("*").alias("sn")
    )
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *PIECE,
        *(F.coalesce(_running(earlier, f"s{i}"), F.lit(0)).alias(f"o{i}") for i in (1, 2)),
        F.coalesce(F.sum("sw").over(earlier), F.lit(0)).alias("ow"),
    )
    d1, d2 = F.col("l1").bitwiseXOR(F.col("o1")), F.col("l2").bitwiseXOR(F.col("o2"))
    rows = local.join(offsets, PIECE).select(
        "conv_id",
        "depth",
        d1.alias("d1"),
        d2.alias("d2"),
        d1.bitwiseXOR(F.col("x1")).alias("p1"),
        d2.bitwiseXOR(F.col("x2")).alias("p2"),
        "words",
        (F.col("lw") + F.col("ow")).alias("upto"),
    )
    ended = totals.groupBy("conv_id").agg(
        F.sum("sn").alias("length"), F.bit_xor("s1").alias("d1"), F.bit_xor("s2").alias("d2"), F.sum("sw").alias("total")
    )
    zero = F.lit(0).cast("long")
    whole = ends.select("conv_id").join(ended, "conv_id", "left")
    whole = whole.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("length", "d1", "d2", "total")))
    rows, whole = scratch.store(rows, "rows"), scratch.store(whole, "whole")
    scratch.drop(turns, info, local)
    return rows, whole


def end_lists(whole: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) of each distinct sequence: SHA-256 of its conversation ids, ascending.

    Ids are written in chunks within ranges of (sequence, id), and the chunks of one sequence
    stream through one hash in order: no list of ids is ever held.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        names = [*NODE, "first", "ids"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, (*key, ids[0], ",".join(map(str, ids))), strict=True))], schema)

        schema = pa.schema([*((c, pa.int64()) for c in (*NODE, "first")), ("ids", pa.string())])
        for batch in batches:
            for *at, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (at != key or len(ids) >= CHUNK):
                    yield out()
                    ids = []
                key = at
                ids.append(conv)
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, found = None, None, []
        schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
        for batch in batches:
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == key:
                    state.update(b",")
                else:
                    if key:
                        found.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256()
                state.update(ids.encode())
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in found], schema)
            found = []
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest()), strict=True))], schema)

    spark = whole.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "conv_id"]
    ranged = whole.select(F.col("length").alias("depth"), "d1", "d2", "conv_id").repartitionByRange(parts, *order)
    written = ranged.sortWithinPartitions(*order).mapInArrow(chunks, "depth long, d1 long, d2 long, first long, ids string")
    dealt = written.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(hashed, "depth long, d1 long, d2 long, ends_sha256 string")


def collapse(scratch: Scratch, rows: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (conv_id, weight, total, leaf) and their prefixes, one row a depth from the root on.

    A sequence is named by its smallest conversation.
    """
    sequences = scratch.store(
        whole.groupBy(F.col("length").alias("depth"), "d1", "d2").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total")
        ),
        "sequences",
    )
    named = sequences.select("conv_id", F.col("depth").alias("length"))
    inner = rows.join(named, "conv_id")
    proper = inner.where("depth < length").select(*NODE)
    zero = F.lit(0).cast("long")
    root = sequences.where("depth > 0").select(*(zero.alias(c) for c in NODE)).limit(1)
    leaves = sequences.join(proper.unionByName(root), NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    sequences = sequences.join(leaves, "conv_id", "left").select("conv_id", "weight", "total", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    roots = named.select("conv_id", *(zero.alias(c) for c in (*NODE, "p1", "p2", "words", "upto")))
    prefixes = inner.drop("length").unionByName(roots)
    return scratch.store(sequences, "weighted"), scratch.store(prefixes, "prefixes")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession, "trie")
    rows, whole = rebuild(scratch, conversations)
    sequences, prefixes = collapse(scratch, rows, whole)
    # Words before the first node that a sequence owns.
    owners = prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.any_value(F.col("upto") - F.col("words")).alias("before"))
    owned = owners.groupBy("conv_id").agg(F.min("before").alias("base"))
    # A sequence that ends inside one of a smaller conversation owns nothing.
    based = sequences.join(owned, "conv_id", "left").withColumn("base", F.coalesce("base", "total"))
    weighted = based.withColumns(
        {"all_words": F.col("weight") * F.col("total"), "tail": F.col("total") - F.col("base")}
    )
    nodes = (
        prefixes.join(weighted, "conv_id")
        .groupBy(*NODE)
        .agg(
            F.any_value("p1").alias("p1"),
            F.any_value("p2").alias("p2"),
            F.any_value(F.col("upto") - F.col("words")).alias("before"),
            F.min(F.struct("conv_id", "base")).alias("owner"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum("all_words").alias("all_words"),
            F.sum("tail").alias("tails"),
        )
    )
    members = F.col("all_words") - F.col("n_convs") * F.col("before")
    distinct = F.col("tails") + F.col("owner.base") - F.col("before")
    nodes = scratch.store(
        nodes.select(*NODE, "p1", "p2", "owner.conv_id", "n_convs", "n_leaves", (members - distinct).alias("saved_tokens")), "nodes"
    )
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(parents, ["depth", "p1", "p2"], "left")
        .join(children, NODE, "left")
        .join(end_lists(whole), NODE, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("n_leaves").cast("long").alias("n_leaves"),
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
