"""Token ids of whole documents in wavelet-matrix shards, and reads from those files.

Documents are ordered by id and dealt into ranges; each task encodes its range and closes a
shard at the first document end past `SHARD_TOKENS`. A shard is one row of a Parquet file:

    part, shard    place of the shard in id order
    base           tokens of the part before the shard
    n_tokens       tokens in the shard
    doc_ids, doc_tokens   its documents in order, and the tokens of each (with the end id)
    planes         one bit-plane for each bit of an id, highest first: the bits of the ids in the
                   order that stable partitions by the higher bits leave them in, packed
    zeros          zeros of each plane
    ranks          for each plane the ones before every block of `BLOCK` positions (uint32)

`WaveletMatrix` answers access, rank, count and select from those planes alone, without
decoding; `read_tokens` decodes whole shards plane by plane. Ids must be below 2**BITS.

Defined results: a null text is empty and holds the end id only; rows that share an id follow
each other by a hash of their text; null ids come first; an empty table writes no shard;
a shard holds its last document whole, however long.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch, tasks_for
from lossledger.llm.features import rounds

#: Bits of an id, positions of a rank block, and the tokens that close a shard.
BITS, BLOCK, SHARD_TOKENS = 16, 512, 1 << 21
#: The id that ends each document.
END_ID = 2

SHARD_SCHEMA = (
    "part int, shard int, base long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "planes array<binary>, zeros array<long>, ranks array<binary>"
)


# --- Encoding -----------------------------------------------------------------------------

#: A space that a visible character follows is where the byte-level pre-tokenizer always cuts. Listed
#: are characters that are visible to all involved; a cut that is left out only makes a longer piece.
_VISIBLE = r"!-~¡-¬®-ʯΑ-ωА-я一-龥"
#: Some letters.
_LETTER = "A-Za-zÀ-ÖØ-öø-ʯ"
#: Stands for a cut; a text that holds it is encoded whole.
_MARK = "\x01"
#: Pieces that each of two generations remembers, and the longest of them, in bytes of ids.
_KNOWN_MAX, _KNOWN_BYTES = 400_000, 24
#: Text encoded together, in bytes.
SLICE_BYTES = 4 << 20


class Encoder:
    """Token ids by the `tokenizers` library, each distinct piece of a batch encoded once.

    A text is cut before each space that a visible character follows and at two other places
    where the pre-tokenizer always cuts, so the pieces' ids joined are the ids of the whole text. Arrow cuts and numbers the pieces of a batch; distinct ones that
    are not remembered are encoded together and told apart by the bytes of their tokens. Texts
    that hold a special token's string go to the library whole.
    """

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # byte-level: one character for each byte
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = re.compile(f"[{_VISIBLE}]")
        self.whole = "|".join(re.escape(s) for s in [*added, _MARK])
        #: Ids (little-endian uint16) of pieces used lately and before.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One encoder for each file and Python worker."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u2").tobytes() for e in found]

    def _learn(self, pieces: list[str], gap: str) -> dict[str, bytes]:
        """Ids of pieces that begin with a space (no gap), or neither begin nor end with white space (a newline as gap)."""
        out: dict[str, bytes] = {}
        for first in range(0, len(pieces), 20_000):
            some = pieces[first : first + 20_000]
            text = gap.join(some) + gap
            ids = self.tokenizer.encode_batch_fast([text + "x" if gap else text], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype="<u2")
            ends = np.cumsum(self.sizes[ids])
            stops = np.cumsum([len(p.encode()) + len(gap) for p in some])
            cuts = np.searchsorted(ends, stops) + 1
            if not np.array_equal(ends[cuts - 1], stops) or (gap and (self.sizes[ids[cuts - 1]] != 1).any()):
                raise ValueError("a token crosses two pieces: not a byte-level tokenizer of this pattern")
            data, lo = ids.tobytes(), 0
            for piece, hi in zip(some, (2 * cuts).tolist(), strict=True):
                out[piece] = data[lo : hi - 2 * len(gap)]
                lo = hi
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.young.get, pieces))
        new: dict[str, bytes] = {}
        for p, v in zip(pieces, found, strict=True):
            if v is None and (v := self.old.get(p)) is not None:
                new[p] = v
        if "" in pieces:
            new[""] = b""
        missing = [p for p, v in zip(pieces, found, strict=True) if v is None and p not in new]
        new |= self._learn([p for p in missing if p[0] == " " and self.shown.match(p, 1)], "")
        new |= self._learn([p for p in missing if self.shown.match(p) and self.shown.match(p, len(p) - 1)], "\n")
        others = [p for p in missing if p not in new]
        new |= zip(others, self._library(others), strict=True)
        if len(self.young) > _KNOWN_MAX:
            self.old, self.young = self.young, {}
        self.young.update((p, v) for p, v in new.items() if len(v) <= _KNOWN_BYTES)
        return [new[p] if v is None else v for p, v in zip(pieces, found, strict=True)]

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end as uint16, and how many each text has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring_regex(texts, f" ([{_VISIBLE}])", _MARK + r" \1")
        # A mark behind a letter, and what follows a single newline, begin a pre-token too.
        cut = pc.replace_substring_regex(cut, f"([{_LETTER}])([.,;:!?])", r"\1" + _MARK + r"\2")
        cut = pc.replace_substring_regex(cut, f"([{_VISIBLE}])\n([{_VISIBLE}])", "\\1\n" + _MARK + r"\2")
        if odd.any():
            cut = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), cut)
        lists = pc.split_pattern(cut, _MARK)
        coded = lists.flatten().dictionary_encode()
        place, stops = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        held = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.array([len(v) for v in held], np.int64) // 2
        ids = np.frombuffer(b"".join(held), dtype="<u2")
        begins = np.cumsum(sizes) - sizes
        n = sizes[place]
        before = np.cumsum(n) - n
        out = ids[np.repeat(begins[place] - before, n) + np.arange(int(n.sum()), dtype=np.int64)]
        counts = np.diff(np.concatenate([[0], np.cumsum(n)])[stops])
        if odd.any():
            whole = dict(zip(np.flatnonzero(odd).tolist(), self._library(texts.filter(pa.array(odd)).to_pylist()), strict=True))
            parts = np.split(out, np.cumsum(counts)[:-1])
            parts = [np.frombuffer(whole[i], "<u2") if i in whole else p for i, p in enumerate(parts)]
            out, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return out, counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint16."""
        if not texts:
            return []
        ids, counts = self.encode_slice(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(counts)[:-1])


# --- The file format ----------------------------------------------------------------------


def build_planes(ids: np.ndarray) -> tuple[list[bytes], list[int], list[bytes]]:
    """Bit-planes, zeros and block ranks of a sequence of ids."""
    planes, zeros, ranks = [], [], []
    values = ids.astype(np.uint16)
    for bit in range(BITS - 1, -1, -1):
        ones = (values & np.uint16(1 << bit)).astype(bool)
        planes.append(np.packbits(ones).tobytes())
        padded = np.zeros(-(-len(ones) // BLOCK) * BLOCK, dtype=np.uint8)
        padded[: len(ones)] = ones
        blocks = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ranks.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
        low = np.compress(~ones, values)
        zeros.append(len(low))
        values = np.concatenate([low, np.compress(ones, values)])
    return planes, zeros, ranks


def decode_planes(n: int, planes: list[bytes]) -> np.ndarray:
    """All ids of a shard in order: the stable partitions undone from the last plane to the first."""
    values = np.zeros(n, dtype=np.uint16)
    for k in range(BITS - 1, -1, -1):
        ones = np.unpackbits(np.frombuffer(planes[k], np.uint8), count=n).view(bool)
        before = np.empty(n, dtype=np.uint16)
        low = n - int(np.count_nonzero(ones))
        before[np.flatnonzero(~ones)] = values[:low]
        before[np.flatnonzero(ones)] = values[low:] | np.uint16(1 << (BITS - 1 - k))
        values = before
    return values


class WaveletMatrix:
    """Queries on one shard's planes."""

    def __init__(self, n_tokens: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n = n_tokens
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.zeros = list(zeros)
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block = min(i // BLOCK, max(len(self.ranks[k]) - 1, 0))
        if i == 0:
            return 0
        first = block * BLOCK // 8
        whole, rest = divmod(i, 8)
        count = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][first:whole]).sum())
        return count + (int(self.planes[k][whole] >> (8 - rest)).bit_count() if rest else 0)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(BITS):
            bit = self._bit(k, i)
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = 2 * value + bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(BITS):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (BITS - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo to hi."""
        if not 0 <= token < 1 << BITS:
            return 0
        first, last = self._range(token, lo, self.n if hi is None else hi)
        return last - first

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) one or zero of plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of an id; -1 if there are fewer."""
        if j < 0 or j >= self.count(token):
            return -1
        i = self._range(token, 0, 0)[0] + j
        for k in range(BITS - 1, -1, -1):
            bit = token >> (BITS - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def _positions(self, k: int, bit: int) -> np.ndarray:
        """Positions of all ones or zeros of plane k."""
        return np.flatnonzero(np.unpackbits(self.planes[k], count=self.n) == bit)

    def occurrences(self, token: int) -> list[int]:
        """All positions of an id: its range in the last plane, mapped back plane by plane at once."""
        if not 0 <= token < 1 << BITS:
            return []
        lo, hi = self._range(token, 0, self.n)
        at = np.arange(lo, hi)
        for k in range(BITS - 1, -1, -1):
            if not len(at):
                break
            bit = token >> (BITS - 1 - k) & 1
            at = self._positions(k, bit)[at - self.zeros[k] if bit else at]
        return at.tolist()


# --- Spark --------------------------------------------------------------------------------


def _write_part(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """Documents of one range in order -> its shards."""
    encoder = Encoder.at(path)
    held: list[np.ndarray] = []
    ids: list[int | None] = []
    counts: list[int] = []
    state = {"shard": 0, "base": 0, "part": 0}

    def close() -> pa.RecordBatch:
        tokens = np.concatenate(held) if held else np.zeros(0, np.uint16)
        planes, zeros, ranks = build_planes(tokens)
        row = {
            "part": [state["part"]], "shard": [state["shard"]], "base": [state["base"]], "n_tokens": [len(tokens)],
            "doc_ids": [list(ids)], "doc_tokens": [list(counts)], "planes": [planes], "zeros": [zeros], "ranks": [ranks],
        }
        state["shard"] += 1
        state["base"] += len(tokens)
        held.clear(), ids.clear(), counts.clear()
        kinds = pa.schema(
            [
                ("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("n_tokens", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
                ("zeros", pa.list_(pa.int64())), ("ranks", pa.list_(pa.binary())),
            ]
        )
        return pa.RecordBatch.from_pydict(row, schema=kinds)

    total = 0
    for batch in batches:
        for part in rounds(batch, limit=SLICE_BYTES):
            state["part"] = part.column("part")[0].as_py()
            flat, sizes = encoder.encode_slice(part.column("text"))
            # Every document with its end id.
            stops = np.cumsum(sizes)
            flat, sizes = np.insert(flat, stops, end_id), sizes + 1
            numbers, lo = part.column("doc_id").to_pylist(), 0
            ends = stops + np.arange(1, len(sizes) + 1)
            while lo < len(sizes):
                start = int(ends[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(ends, start + shard_tokens - total)) + 1, len(sizes))
                held.append(flat[start : ends[hi - 1]])
                ids.extend(numbers[lo:hi])
                counts.extend(sizes[lo:hi].tolist())
                total += int(ends[hi - 1]) - start
                lo = hi
                if total >= shard_tokens:
                    yield close()
                    total = 0
    if ids:
        yield close()


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the token shards of `docs` below `out`, in ascending doc_id order; returns the shards read back.

    `tokenizer_path` is a byte-level tokenizer file of at most 65,536 ids that every executor has.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = body.withColumn("tie", F.xxhash64("text"))
    parts = order.repartitionByRange(tasks_for(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches):
        return _write_part(batches, tokenizer_path, end_id, shard_tokens)

    shards = parts.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, SHARD_SCHEMA)
    shards.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(SHARD_SCHEMA).parquet(out)


def _read(batches):
    names = ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for shard in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            ids = decode_planes(shard["n_tokens"], shard["planes"]).astype("<u4")
            counts = np.array(shard["doc_tokens"], dtype=np.int64)
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard["part"], np.int32)),
                    pa.array(np.full(n, shard["shard"], np.int32)),
                    pa.array(shard["doc_ids"], pa.int64()),
                    pa.array(shard["base"] + ends - counts),
                    pa.array(counts),
                    pa.array(crc, pa.int64()),
                ],
                names,
            )


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each range of ids, not for each document: the only step without a key.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    docs = shards.mapInArrow(_read, "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(starts), "part").select(  # one row for each task of the writer
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the shards into the shared folder and read every document back from them."""
    scratch = Scratch(docs.sparkSession, "token-shards")
    return read_tokens(write_shards(docs, tokenizer_path, scratch.path("shards")))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(part, shard, position) of every occurrence of an id, looked up in the planes."""

    def look(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                matrix = WaveletMatrix(shard["n_tokens"], shard["planes"], shard["zeros"], shard["ranks"])
                at = matrix.occurrences(token)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard["part"]] * n, pa.int32()), pa.array([shard["shard"]] * n, pa.int32()), pa.array(at, pa.int64())],
                    ["part", "shard", "position"],
                )

    return shards.mapInArrow(look, "part int, shard int, position long")


def shards_of(spark: SparkSession, path: str) -> DataFrame:
    """Shards written before."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path)
