"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece crosses (a run of space marks with the letters, or with
the other characters, behind it). The distinct units of the corpus are exploded into their
substrings of bounded length, joined with the piece table, and the matching pieces (edges) are
grouped again. One fold over the edges, in rank order and over all units of a bucket at once, gives
each unit's segmentation:

- unigram models: the Viterbi path, the best score up to each position;
- BPE models: the best sum of scores is not what such a model means, so the same lattice is
  folded in merge order: each step takes the best-ranked edge (the leftmost of equals) that joins
  two neighbours of the segmentation so far.

The path is held as bits of borders, so units of more than `LONGEST` characters don't fit; they
are encoded with the sentencepiece library in the step that folds. Decoding looks each id's bytes
up in an array of the piece table and joins them.

The piece table has a fixed size and is broadcast. Each text is cut once: documents are stored in
groups of bounded size, as numbers of the group's distinct units, and stay where they are. A group's
units go to buckets by their hash, once for each group, so a unit's frequency doesn't matter; each
bucket answers every group with the ids of its units.

Defined results: null and empty texts have no ids and decode to an empty text; rows that share
an id are separate documents. Model files that normalise texts are refused.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch, identified, public_id, setting, tasks_for

MARK = "▁"
#: Characters of a unit in the lattice, at most; a border takes one bit of a long.
LONGEST = 60

#: Text of a group of documents, text that is cut at once, and input files for each bucket of units, in bytes.
GROUP_BYTES, SLICE_BYTES, BUCKET_BYTES = 16 << 20, 1 << 20, 4 << 20
#: Buckets of a table, at most, by Spark's own setting.
MOST_BUCKETS = 100_000
#: Units of a group whose ids are put together at once, distinct units that are folded at once, and rows of a batch of texts.
SLICE_UNITS, FOLD_UNITS, BATCH_ROWS = 1 << 18, 1 << 14, 1_000


@dataclass(frozen=True)
class PieceTable:
    """Pieces with id, score and rank; ids of the 256 byte pieces start at `byte0` (or there are none)."""

    kind: str  # "bpe" or "unigram"
    pieces: tuple[tuple[str, int, float], ...]
    hexes: tuple[str, ...]  # bytes of each id's text
    byte0: int | None
    unknown: int
    path: str | None = None

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @property
    def fine(self) -> bool:
        """True if no piece crosses from letters to others, or has inner space marks."""
        inner = [p.lstrip(MARK) for p, _, _ in self.pieces]
        return all(len({_kinds()[ord(c)] for c in p}) < 2 and MARK not in p for p in inner)

    @classmethod
    def load(cls, path: str) -> PieceTable:
        """The table of a SentencePiece model file."""
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only models without normalisation, with a leading space mark, are supported")
        pieces, hexes, byte0, unknown = [], [], None, 0
        for i, p in enumerate(proto.pieces):
            if p.type == p.NORMAL:
                pieces.append((p.piece, i, p.score))
                hexes.append(p.piece.replace(MARK, " ").encode().hex())
            elif p.type == p.BYTE:
                byte0 = i if byte0 is None else byte0
                hexes.append(p.piece[3:5])
            else:
                unknown = i if p.type == p.UNKNOWN else unknown
                hexes.append("")
        kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        return cls(kind, tuple(pieces), tuple(hexes), byte0, unknown, path)


# --- Cutting ------------------------------------------------------------------------------


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point: 0 the space mark, 1 a letter, 2 anything else."""
    kinds = np.fromiter((1 if chr(c).isalpha() else 2 for c in range(0x110000)), np.uint8, 0x110000)
    kinds[ord(MARK)] = 0
    return kinds


def cut(texts: pa.Array, fine: bool) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts end to end, and how many each text has.

    A unit begins with its space marks; if `fine`, it ends where letters meet others.
    """
    texts = texts.cast(pa.large_string())
    mark, nothing = pa.scalar(MARK, pa.large_string()), pa.scalar("", pa.large_string())
    marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, " ", MARK), nothing)
    marked = pc.if_else(pc.equal(texts, nothing), nothing, marked)
    at = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    body = marked.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.empty(0, np.uint8)
    at = at - at[0]
    kinds = _kinds()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
    places = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
    begins = np.zeros(len(kinds), bool)
    before, own = kinds[:-1], kinds[1:]
    begins[1:] = (own != before) & (before != 0) if fine else (own == 0) & (before != 0)
    begins[np.searchsorted(places, at[:-1][at[1:] > at[:-1]])] = True
    starts = places[begins]
    offsets = np.append(starts, len(raw)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw.tobytes()))
    return units, np.diff(np.searchsorted(starts, at))


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed, behind their count."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()
    return len(numbers).to_bytes(8, "little") + (pa.Codec("zstd").compress(planes, asbytes=True) if planes else b"")


def _spread(blob: bytes, kind: type) -> np.ndarray:
    """The numbers of `_squeeze`."""
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(blob[8:], n * width, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


GROUP_SCHEMA = "group long, docs array<binary>, units array<struct<bucket:int,sizes:binary,body:binary>>"


def _grouped(fine: bool, buckets: int):
    """row, ord, text -> one row for each group of documents: the documents in units, the units by bucket."""

    def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        units, counts = [], []
        for batch in held:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
            slices = _firsts((ends - 1).clip(0) // SLICE_BYTES).tolist()
            for lo, hi in zip(slices, [*slices[1:], batch.num_rows], strict=True):
                u, n = cut(batch.column("text").slice(lo, hi - lo), fine)
                units.append(u)
                counts.append(n)
        coded = pa.chunked_array(units, pa.string()).dictionary_encode().unify_dictionaries()
        numbers = np.concatenate([c.indices.to_numpy() for c in coded.chunks] or [np.empty(0)]).astype(np.uint32)
        names = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        homes = np.array([zlib.crc32(u) % buckets for u in names.cast(pa.binary()).to_pylist()], np.uint32)
        order = np.argsort(homes, kind="stable")
        names, lists = names.take(pa.array(order)), []
        sizes = pc.binary_length(names).to_numpy().astype(np.uint32)
        ends, body = np.append(0, np.cumsum(sizes, dtype=np.int64)), b"".join(names.cast(pa.binary()).to_pylist())
        first = _firsts(homes[order]).tolist()
        for lo, hi in zip(first, [*first[1:], len(order)], strict=True):
            lists.append({"bucket": int(homes[order[lo]]), "sizes": sizes[lo:hi].tobytes(), "body": body[ends[lo] : ends[hi]]})
        columns = [np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in ("row", "ord")]
        docs = [_squeeze(c) for c in [*columns, np.concatenate(counts).astype(np.uint32), numbers, homes]]
        kinds = pa.list_(pa.struct([("bucket", pa.int32()), ("sizes", pa.binary()), ("body", pa.binary())]))
        arrays = [pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.binary())), pa.array([lists], kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["group", "docs", "units"])

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        held, number, total = [], 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
            which = (total + np.cumsum(sizes) - sizes) // GROUP_BYTES
            total += int(sizes.sum())
            first = _firsts(which).tolist()
            for lo, hi in zip(first, [*first[1:], batch.num_rows], strict=True):
                if held and which[lo] != number:
                    yield packed(base + number, held)
                    held = []
                number = int(which[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed(base + number, held)

    return run


BUCKET_SCHEMA = "bucket int, number int, unit string, group long, numbers binary"


def _distinct(key: tuple, lists: pa.Table) -> pa.Table:
    """Unit lists of a bucket -> its distinct units, numbered, and each group's list as those numbers."""
    arrays = []
    for sizes, body in zip(lists.column("sizes").to_pylist(), lists.column("body").to_pylist(), strict=True):
        offsets = np.append(0, np.cumsum(np.frombuffer(sizes, np.uint32))).astype(np.int32)
        arrays.append(pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body)))
    coded = pa.chunked_array(arrays).dictionary_encode().unify_dictionaries()
    names = coded.chunk(0).dictionary
    numbers = [_squeeze(c.indices.to_numpy().astype(np.uint32)) for c in coded.chunks]
    n, m, bucket = len(names), len(arrays), key[0].as_py()
    return pa.table(
        {
            "bucket": pa.array(np.full(n + m, bucket, np.int32)),
            "number": pa.concat_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.nulls(m, pa.int32())]),
            "unit": pa.concat_arrays([names, pa.nulls(m, pa.string())]),
            "group": pa.concat_arrays([pa.nulls(n, pa.int64()), lists.column("group").combine_chunks()]),
            "numbers": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(numbers, pa.binary())]),
        }
    )


# --- Folds --------------------------------------------------------------------------------


def _bit(place: np.ndarray) -> np.ndarray:
    return np.left_shift(np.int64(1), place.astype(np.int64))


def merge_borders(of: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of the borders left in each unit when no merge applies; edges by unit, best first.

    An edge applies when its ends are borders with exactly one border between them. Each step takes
    the first such edge of every unit; borders only go, so edges that lost an end are let go too.
    """
    bits = _bit(n + 1) - 1
    ends, inner = _bit(s) | _bit(e), (_bit(e) - 1) & ~(_bit(s + 1) - 1)
    live = np.flatnonzero(e > s + 1)
    of, ends, inner = of[live], ends[live], inner[live]
    while len(of):
        own = bits[of]
        able = np.flatnonzero(((own & ends) == ends) & (np.bitwise_count(own & inner) == 1))
        first = able[_firsts(of[able])]
        bits[of[first]] &= ~inner[first]
        changed = np.zeros(len(bits), bool)
        changed[of[first]] = True
        own = bits[of]
        live = np.flatnonzero(changed[of] & ((own & ends) == ends) & ((own & inner) != 0))
        of, ends, inner = of[live], ends[live], inner[live]
    return bits


def viterbi_borders(of: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray, score: np.ndarray, unknown: float) -> np.ndarray:
    """Bits of the borders of each unit's path of best total score; single characters without a piece cost `unknown`.

    For each end in turn, the state grows by the best (score, borders) that reaches it; of equal
    scores the later last border wins, then the larger set of borders.
    """
    longest = int(n.max(initial=0))
    best, bits = np.zeros((len(n), longest + 1)), np.ones((len(n), longest + 1), np.int64)
    for end in range(1, longest + 1):
        here = np.flatnonzero(e == end)
        known = np.zeros(len(n), bool)
        known[of[here[s[here] == end - 1]]] = True
        alone = np.flatnonzero((n >= end) & ~known)
        unit = np.append(of[here], alone)
        last = np.append(s[here], np.full(len(alone), end - 1))
        total = best[unit, last] + np.append(score[here], np.full(len(alone), unknown))
        path = bits[unit, last] | np.int64(1 << end)
        order = np.lexsort((path, total, unit))
        unit, total, path = unit[order], total[order], path[order]
        top = np.append(_firsts(unit)[1:], len(unit)) - 1 if len(unit) else _firsts(unit)
        best[unit[top], end], bits[unit[top], end] = total[top], path[top]
    return bits[np.arange(len(n)), n]


# --- Segmentation -------------------------------------------------------------------------


@functools.cache
def _model(path: str):
    """The library's model, once for each Python worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _library_ids(path: str | None, unit: str) -> list[int]:
    """Ids of a unit by the library, for units that are too long for the lattice."""
    if path is None:
        raise ValueError(f"a unit of {len(unit)} characters needs a model file")
    text = unit.replace(MARK, " ")
    # The library puts a mark in front; a newline before a unit without one keeps the two apart.
    return _model(path).encode(text[1:]) if unit.startswith(MARK) else _model(path).encode("\n" + text)[2:]


def edges_of(units: DataFrame, table: PieceTable) -> DataFrame:
    """(at, of, edge): the pieces found in units of up to `LONGEST` characters; bucket, number of the unit.

    An edge is one number that sorts by rank, then place: rank, start, end, id.
    """
    ranks = {s: r for r, s in enumerate(sorted({s for _, _, s in table.pieces}, reverse=True))}
    rows = [(p, (ranks[s] << 32) + i) for p, i, s in table.pieces]
    pieces = F.broadcast(units.sparkSession.createDataFrame(rows, "piece string, ranked long"))  # a model's size
    n = F.char_length("unit")
    fit = units.where((n > 0) & (n <= LONGEST))
    starts = fit.select("bucket", "number", "unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(table.longest), n - F.col("s")))
    spans = starts.select("bucket", "number", "unit", "s", F.explode(lengths).alias("len"))
    found = spans.withColumn("piece", F.substring(F.col("unit"), F.col("s") + 1, F.col("len"))).join(pieces, "piece")
    place = (F.col("s") * 64 + F.col("s") + F.col("len")).cast("long") * (1 << 20)
    return found.select(F.col("bucket").alias("at"), F.col("number").alias("of"), (F.col("ranked") + place).alias("edge"))


def _folded(table: PieceTable):
    """Units and edges (unit, edge) of a bucket -> ids of all units end to end, and how many each has."""
    kind, byte0, unknown, path = table.kind, table.byte0, table.unknown, table.path
    scores = np.zeros(max((i for _, i, _ in table.pieces), default=0) + 1)
    for _, i, score in table.pieces:
        scores[i] = score
    lowest = min((s for _, _, s in table.pieces), default=0.0) - 10.0

    def fold(units: pa.Array, of: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((edge, of))
        of, edge = of[order].astype(np.int64), edge[order]
        firsts = np.arange(0, len(units), FOLD_UNITS)
        at = np.searchsorted(of, np.append(firsts, len(units))).tolist()
        slices = zip(firsts.tolist(), at[:-1], at[1:], strict=True)
        done = [folded(units.slice(first, FOLD_UNITS), of[lo:hi] - first, edge[lo:hi]) for first, lo, hi in slices]
        ids, sizes = zip((np.empty(0, np.uint32), np.empty(0, np.int64)), *done, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def folded(units: pa.Array, of: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e, piece = edge >> 26 & 63, edge >> 20 & 63, edge & (1 << 20) - 1
        n = pc.utf8_length(units).to_numpy().astype(np.int64)
        long = n > LONGEST
        n[long] = 1  # one step, for which there is no piece
        bits = merge_borders(of, s, e, n) if kind == "bpe" else viterbi_borders(of, s, e, n, scores[piece], lowest)
        borders = (bits[:, None] >> np.arange(int(n.max(initial=0)) + 1)) & 1
        unit, place = np.nonzero(borders)
        step = np.flatnonzero(unit[1:] == unit[:-1])
        unit, lo, hi = unit[step], place[step], place[step + 1]
        keys = of << 12 | s << 6 | e
        by_key = np.argsort(keys)
        keys, piece, wanted = keys[by_key], piece[by_key], unit << 12 | lo << 6 | hi
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        ids = np.zeros(len(wanted), np.int64)
        ids[known] = piece[at[known]]
        # Characters without a piece, and long units.
        rest, sizes = [], np.ones(len(wanted), np.int64)
        for k in np.flatnonzero(~known).tolist():
            text = units[int(unit[k])].as_py()
            if long[unit[k]]:
                found = _library_ids(path, text)
            elif byte0 is None:
                found = [unknown]
            else:
                found = [byte0 + b for b in text[lo[k] : hi[k]].encode()]
            rest += found
            sizes[k] = len(found)
        ids = np.repeat(ids, sizes)
        ids[np.repeat(~known, sizes)] = rest
        return ids.astype(np.uint32), np.bincount(unit, sizes, len(units)).astype(np.int64)

    return fold


def segment(units: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, ids) for distinct units of up to `LONGEST` characters."""
    fold = _folded(table)
    buckets = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = units.where((F.col("unit") != "") & (F.char_length("unit") <= LONGEST))
    named = fit.select(F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int").alias("bucket"), F.col("unit").alias("number"), "unit")

    def run(held: pa.Table, edges: pa.Table) -> pa.Table:
        names = held.column("unit").combine_chunks()
        of = pc.index_in(edges.column("of"), value_set=names).to_numpy()
        ids, sizes = fold(names, of, edges.column("edge").to_numpy())
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.table({"unit": names, "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))})

    found = edges_of(named, table)
    return named.groupBy("bucket").cogroup(found.groupBy("at")).applyInArrow(run, "unit string, ids array<int>")


# --- Documents ----------------------------------------------------------------------------


ANSWER_SCHEMA = "group long, bucket int, sizes binary, ids binary"


def _answered(table: PieceTable):
    """Units and groups' lists of a bucket, and its edges -> the ids of each list."""
    fold = _folded(table)

    def run(held: pa.Table, edges: pa.Table) -> pa.Table:
        named = held.filter(pc.is_valid(held.column("unit"))).sort_by("number")
        lists = held.filter(pc.is_valid(held.column("group")))
        units = pa.concat_arrays([pa.array([], pa.string()), *named.column("unit").chunks])
        ids, sizes = fold(units, edges.column("of").to_numpy(), edges.column("edge").to_numpy())
        starts = np.cumsum(sizes) - sizes
        out_sizes, out_ids = [], []
        for blob in lists.column("numbers").to_pylist():
            numbers = _spread(blob, np.uint32)
            out_sizes.append(_squeeze(sizes[numbers].astype(np.uint32)))
            out_ids.append(_squeeze(ids[_ranges(starts[numbers], sizes[numbers])]))
        return pa.table(
            {
                "group": lists.column("group"),
                "bucket": lists.column("bucket"),
                "sizes": pa.array(out_sizes, pa.binary()),
                "ids": pa.array(out_ids, pa.binary()),
            }
        )

    return run


def _join(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a group and the ids of its units by bucket -> ids of each document."""
    out = []
    answers = answers.sort_by("bucket")
    none = [np.empty(0, np.uint32)]
    sizes = np.concatenate(none + [_spread(x, np.uint32) for x in answers.column("sizes").to_pylist()]).astype(np.int64)
    data = np.concatenate(none + [_spread(x, np.uint32) for x in answers.column("ids").to_pylist()])
    for parts in docs.column("docs").to_pylist():
        row, ord_ = _spread(parts[0], np.int64), _spread(parts[1], np.int64)
        counts, numbers, homes = (_spread(x, np.uint32) for x in parts[2:])
        order = np.argsort(homes, kind="stable")
        if len(order) != len(sizes):
            raise ValueError("a group's units and their ids don't match")
        n, start = np.empty_like(sizes), np.empty_like(sizes)
        n[order], start[order] = sizes, np.cumsum(sizes) - sizes
        ends = np.cumsum(counts, dtype=np.int64)
        first = _firsts((ends - 1).clip(0) // SLICE_UNITS).tolist()
        for lo, hi in zip(first, [*first[1:], len(row)], strict=True):
            begin = int(ends[lo] - counts[lo])
            some = numbers[begin : int(ends[hi - 1])]
            ids = data[_ranges(start[some], n[some])]
            before = np.append(0, np.cumsum(n[some]))
            offsets = before[np.append(begin, ends[lo:hi]) - begin]
            view = memoryview(ids.astype("<u4")).cast("B")
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            out.append(
                pa.table(
                    {
                        "row": pa.array(row[lo:hi]),
                        "ord": pa.array(ord_[lo:hi]),
                        "ids": pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.astype(np.int32))),
                        "n_ids": pa.array(np.diff(offsets)),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )
            )
    kinds = [("row", pa.int64()), ("ord", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("ids_crc32", pa.int64())]
    return pa.concat_tables(out) if out else pa.schema(kinds).empty_table()


def encode(docs: DataFrame, table: PieceTable) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 (of the ids as little-endian uint32), row of every document."""
    scratch = Scratch(docs.sparkSession, "pieces")
    texts = identified(scratch, docs)
    buckets = tasks_for(docs, BUCKET_BYTES)
    if buckets > MOST_BUCKETS:  # Spark knows no size
        buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    groups = texts.select("row", "ord", "text").mapInArrow(_grouped(table.fine, buckets), GROUP_SCHEMA)
    with setting(scratch.spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        groups = scratch.bucketed(groups, "groups", buckets, "group")
    lists = groups.select("group", F.explode("units").alias("u")).select("group", "u.*")
    units = scratch.bucketed(lists.groupBy("bucket").applyInArrow(_distinct, BUCKET_SCHEMA), "units", buckets, "bucket")
    found = edges_of(units.where("unit is not null").select("bucket", "number", "unit"), table)
    answers = units.groupBy("bucket").cogroup(found.groupBy("at")).applyInArrow(_answered(table), ANSWER_SCHEMA)
    joined = groups.select("group", "docs").groupBy("group").cogroup(answers.groupBy("group"))
    out = joined.applyInArrow(_join, "row long, ord long, ids array<int>, n_ids long, ids_crc32 long")
    return out.select(public_id("ord").alias("doc_id"), "ids", "n_ids", "ids_crc32", "row")


def decode(ids: Column, table: PieceTable) -> Column:
    """The text of a column of ids, as the library decodes it: without the leading space."""
    hexes = F.split(F.lit(",".join(table.hexes)), ",")  # one literal; a model's size
    joined = F.array_join(F.transform(ids, lambda i: F.element_at(hexes, i + 1)), "")
    text = F.make_valid_utf8(F.unhex(joined).cast("string"))
    return F.when(text.startswith(" "), F.substring(text, F.lit(2), F.char_length(text))).otherwise(text)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256: the ids of every document and the text they give back."""
    table = PieceTable.load(path)
    done = encode(docs, table)
    return done.select("doc_id", "n_ids", "ids_crc32", F.sha2(decode(F.col("ids"), table), 256).alias("decoded_sha256"))


def table_of(spark: SparkSession, table: PieceTable) -> DataFrame:
    """The piece table as a DataFrame."""
    return spark.createDataFrame(list(table.pieces), "piece string, id int, score double")
