"""Word-level BPE through a minimal acyclic transducer of frequent words.

The lexicon holds the words that make up at least one in `LEXICON_WORDS` of all words of a
corpus (so never more than that many). It is one file:

    keys      for each arc its state and byte (state << 8 | byte), ascending
    targets   the state an arc leads to
    numbers   what an arc adds to the word's number: words that sort before it at that state
    final     whether a state ends a word
    starts, ids   the token ids of each word, by its number

States with the same continuations are one state (shared suffixes), so the automaton is
minimal, and the sum of an accepted path's numbers is the word's rank: the output that selects
its ids. The file goes to each executor by Spark's own file distribution and is memory-mapped,
so the workers of a machine share its pages. Distinct words of a batch walk it together, one
byte a step; words it does not accept are merged exactly.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows
and ids are encoded each for itself; an empty table gives an empty lexicon and no rows; other
columns of the input are not read. A text is encoded whole, however long; only a batch's
texts share memory, at least one and about `SLICE_BYTES` of them.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch

#: A word with at least this share of all words (one in so many) is in the lexicon.
LEXICON_WORDS = 1 << 20
#: Longest word of the lexicon, in UTF-8 bytes; longer ones are always merged.
LONGEST = 64
#: Text encoded together.
SLICE_BYTES = 8 << 20

ENCODED_SCHEMA = "doc_id long, ids array<int>, decoded string"


# --- The tokenizer's words and merges -------------------------------------------------------


def _byte_names() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            names[b] = chr(b)
        else:
            names[b], spare = chr(spare), spare + 1
    return names


_NO_RANK = 1 << 60

#: Latin letters whose lower case is one letter and that don't change in composition.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"

#: Code points whose case, composition and class are alike in all Unicode versions in use here.
_SETTLED = "\u0000-՗ -⁯　-ヿ一-龥가-힣"


class WordBpe:
    """A `tokenizers` file of the kind NFC + lower case, words by pattern, BPE with word ends."""

    _held: dict[str, WordBpe] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end, vocabulary = model["end_of_word_suffix"] or "", model["vocab"]
        if model["type"] != "BPE" or model["byte_fallback"] or model["ignore_merges"] or spec["post_processor"]:
            raise ValueError("not a plain word-level BPE tokenizer")
        self.library = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or "(?!)")
        if any(re.search(r"\s", s) for s in self.specials):
            raise ValueError("a special token with white space")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.unsettled = re.compile(f"[^{_SETTLED}]")
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        names = [""] * size
        for token, i in [*vocabulary.items(), *self.specials.items()]:
            names[i] = token
        self.names = pa.array(names, pa.large_string())
        self.inner = [vocabulary[c] for c in _byte_names()]
        self.last = [vocabulary[c + self.end] for c in _byte_names()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a] << 32 | vocabulary[b]] = (rank, vocabulary[a + b])
        keys = np.array(list(self.merges), np.int64)
        self.made = np.array([new for _, new in self.merges.values()], np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]

    @classmethod
    def at(cls, path: str) -> WordBpe:
        """One for each file and Python worker."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        if self.unsettled.search(text):
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        # Lower case goes by single characters here, so a final sigma is not special.
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def words(self, text: str) -> list[str]:
        """The words of a text as the tokenizer cuts them; a special token is a word of its own."""
        if not self.special.search(text):
            return self._plain(text)
        out, since = [], 0
        for found in self.special.finditer(text):
            out += self._plain(text[since : found.start()])
            out.append(found.group())
            since = found.end()
        return out + self._plain(text[since:])

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of least rank is merged, the leftmost first, until none is left."""
        if word in self.specials:
            return [self.specials[word]]
        data = word.encode()
        return self._merge_one([self.inner[b] for b in data[:-1]] + [self.last[data[-1]]])

    def merge_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (large_string) end to end, and how many each has.

        Each round merges one pair in every word that still has one: its pair of least rank,
        the leftmost where several have it. Long words and special tokens go one by one.
        """
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        sizes, offsets = np.diff(offsets), offsets - offsets[0]
        ids = np.asarray(self.inner, np.int64)[raw]
        ends = offsets[1:][sizes > 0] - 1
        ids[ends] = np.asarray(self.last, np.int64)[raw[ends]]
        odd = sizes > LONGEST
        if self.specials:
            odd |= pc.is_in(words, pa.array(list(self.specials), pa.large_string())).to_numpy(zero_copy_only=False)
        apart = {i: self.merge(words[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        owner = np.repeat(np.arange(len(words)), sizes)
        ids, owner = ids[~odd[owner]], owner[~odd[owner]]
        rank = self._ranks(ids[:-1], ids[1:], owner[:-1] == owner[1:]) if len(ids) else ids
        rank = np.append(rank, _NO_RANK)[: len(ids)]
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(ids)))
            ready = least == _NO_RANK
            if ready.any():
                done_ids.append(ids[ready])
                done_owner.append(owner[ready])
                ids, owner, rank, least = ids[~ready], owner[~ready], rank[~ready], least[~ready]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.diff(owner[at], prepend=-1) > 0]
            ids[at] = self.made[rank[at]]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            at -= np.arange(len(at))
            for left in (at, at[at > 0] - 1):  # only pairs beside a merge have changed
                right = np.minimum(left + 1, len(ids) - 1)
                same = (owner[left] == owner[right]) & (left < right)
                rank[left] = self._ranks(ids[left], ids[right], same)
        for i, x in apart.items():
            done_ids.append(np.array(x, np.int64))
            done_owner.append(np.full(len(x), i))
        ids = np.concatenate(done_ids) if done_ids else ids
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _ranks(self, a: np.ndarray, b: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two ids, `_NO_RANK` where there is none or they are not `joined`."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(joined & (self.pair_keys[at] == key), self.pair_ranks[at], _NO_RANK)

    def _merge_one(self, ids: list[int]) -> list[int]:
        """`merge` with a queue of pairs and linked neighbours, for words of any length."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get(a << 32 | b))]  # noqa: B905
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged with another neighbour meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(new << 32 | ids[k]):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := get(ids[h] << 32 | new)):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library gives it for a tokenizer without a decoder: names joined by spaces."""
        return " ".join(self.names.take(pa.array(ids, pa.int64())).to_pylist())


# --- The transducer -------------------------------------------------------------------------


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon, from distinct words in ascending order of their bytes, with their ids."""
    known: dict[tuple, int] = {}
    words_below: list[int] = []
    path: list[list] = [[False, []]]  # open states from the root: final, and closed arcs

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            ends, arcs = path.pop()
            shape = (ends, tuple(arcs))
            state = known.setdefault(shape, len(known))
            if state == len(words_below):
                words_below.append(ends + sum(words_below[t] for _, t in arcs))
            path[-1][1].append((previous[len(path) - 1], state))

    previous, starts, ids = b"", [0], []
    for word, tokens in entries:
        if starts[-1:] != [0] and word <= previous or not word:
            raise ValueError("words must be distinct, not empty and ascending")
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        previous = word
        ids += tokens
        starts.append(len(ids))
    close(0)
    shapes = [*known, (False, tuple(path[0][1]))]  # the root comes last
    keys, targets, numbers = [], [], []
    for state, (ends, arcs) in enumerate(shapes):
        number = int(ends)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(number)
            number += words_below[target]
    parts = {
        "keys": np.array(keys, "<i8"),
        "targets": np.array(targets, "<i4"),
        "numbers": np.array(numbers, "<i4"),
        "final": np.array([s[0] for s in shapes], "u1"),
        "starts": np.array(starts, "<i8"),
        "ids": np.array(ids, "<i4"),
    }
    head, at = {}, 0
    for name, part in parts.items():
        head[name] = (part.dtype.str, at, len(part))
        at += -(-part.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    body = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts.values())
    return len(text).to_bytes(8, "little") + text + body


class Lexicon:
    """A compiled lexicon, read in place."""

    _held: dict[str, Lexicon] = {}

    def __init__(self, data: bytes | mmap.mmap):
        n = int.from_bytes(data[:8], "little")
        for name, (kind, at, length) in json.loads(data[8 : 8 + n]).items():
            setattr(self, name, np.frombuffer(data, kind, length, 8 + n + at))

    @classmethod
    def sent(cls, name: str) -> Lexicon:
        """The lexicon file that Spark has put on this machine, mapped once for each worker."""
        if name not in cls._held:
            with open(SparkFiles.get(name), "rb") as file:
                cls._held[name] = cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        return cls._held[name]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word (a large_string array), -1 for those the automaton does not accept."""
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        found = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(np.diff(offsets) <= LONGEST)
        at, left = offsets[live], np.diff(offsets)[live]
        state, number = np.full(len(live), len(self.final) - 1, np.int64), np.zeros(len(live), np.int64)
        while len(live):
            over = left == 0
            ends = over & self.final[state].astype(bool)
            found[live[ends]] = number[ends]
            go = np.flatnonzero(~over)
            if not len(go) or not len(self.keys):
                break
            live, at, left, state, number = live[go], at[go], left[go], state[go], number[go]
            key = state << 8 | raw[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = np.flatnonzero(self.keys[arc] == key)
            live, at, left, arc = live[met], at[met] + 1, left[met] - 1, arc[met]
            state, number = self.targets[arc].astype(np.int64), number[met] + self.numbers[arc]
        return found


#: Between token names.
_GAP = pa.scalar(" ", pa.large_string())


class Cut:
    """Texts as chunks between spaces, each distinct chunk cut into words once.

    No word holds white space, and none of the steps before the cut looks across it.
    """

    def __init__(self, bpe: WordBpe, texts: pa.Array):
        if len(texts) == 0:
            texts = pa.array([""])
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # A single mark behind a letter is a word of its own, so a space before it changes nothing.
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), f"([{_LATIN}])([.,;:!?])( |$)", r"\1 \2\3")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        #: Chunk number of each chunk in order, and where each text's chunks end (0 first).
        self.place, self.stops = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        # A chunk of Latin letters is one word; others are cut one by one.
        chunks = coded.dictionary
        plain = pc.match_substring_regex(chunks, f"^[{_LATIN}]+$").to_numpy(zero_copy_only=False)
        rest = [bpe.words(c) for c in _strings(chunks.filter(pa.array(~plain)))]
        sizes = np.ones(len(chunks), np.int64)
        sizes[~plain] = [len(r) for r in rest]
        lower = pc.utf8_lower(chunks.filter(pa.array(plain)))
        words = pa.concat_arrays([lower, pa.array([w for r in rest for w in r], pa.large_string())]).dictionary_encode()
        #: Where the words of each distinct chunk end (0 first), and the word numbers of all of them end to end.
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.words, numbers = words.dictionary, words.indices.to_numpy()
        self.numbers = np.empty(len(numbers), np.int64)
        self.numbers[self.ends[:-1][plain]] = numbers[: len(lower)]
        self.numbers[_spread(self.ends[:-1][~plain], sizes[~plain])] = numbers[len(lower) :]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids and decoded texts of slices of texts: the lexicon's words by lookup, others merged."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has."""
        number = self.lexicon.find(words)
        known, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        own, own_sizes = self.bpe.merge_all(words.take(pa.array(unseen)))
        sizes = np.zeros(len(words), np.int64)
        sizes[known] = np.diff(self.lexicon.starts)[number[known]]
        sizes[unseen] = own_sizes
        first = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        ids[_spread(first[known], sizes[known])] = self.lexicon.ids[_spread(self.lexicon.starts[number[known]], sizes[known])]
        ids[_spread(first[unseen], sizes[unseen])] = own
        return ids, sizes

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """A list of ids and the decoded text for each text."""
        cut = Cut(self.bpe, texts)
        word_ids, word_sizes = self._word_ids(cut.words)
        # By distinct chunk: its words' ids, and the names of those tokens.
        sizes = word_sizes[cut.numbers]
        ids = word_ids[_spread((np.cumsum(word_sizes) - word_sizes)[cut.numbers], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[cut.ends]
        shown = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto), self.bpe.names.take(pa.array(ids))), _GAP)
        # By text; chunks without a token leave no gap.
        sizes = np.diff(upto)[cut.place]
        kept = np.concatenate([[0], np.cumsum(sizes > 0)])[cut.stops]
        ends = np.concatenate([[0], np.cumsum(sizes)])[cut.stops]
        place = cut.place[sizes > 0]
        all_ids = pa.array(ids[_spread(upto[place], sizes[sizes > 0])])
        decoded = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept), shown.take(pa.array(place))), _GAP)
        return pa.LargeListArray.from_arrays(pa.array(ends), all_ids)[: len(texts)], decoded[: len(texts)]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()), dtype=np.int64)


# --- Spark ----------------------------------------------------------------------------------


def _slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text; one text is never cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        start = int(ends[lo - 1]) if lo else 0
        hi = max(int(np.searchsorted(ends, start + most, side="right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) over all texts, for words of at most `LONGEST` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.at(path)
        for batch in batches:
            for part in _slices(batch, "text", 2 * SLICE_BYTES):
                cut = Cut(bpe, part.column("text"))
                chunks = np.bincount(cut.place, minlength=len(cut.ends) - 1)
                n = np.zeros(len(cut.words), np.int64)
                np.add.at(n, cut.numbers, np.repeat(chunks, np.diff(cut.ends)))
                out = pa.RecordBatch.from_arrays([cut.words.cast(pa.string()), pa.array(n)], ["word", "n"])
                yield out.filter(pc.less_equal(pc.binary_length(out.column(0)), LONGEST))

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """The lexicon of a corpus: every word with at least one in `words` of all its occurrences."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.at(path)
        for batch in batches:
            ids = pa.array([bpe.merge(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["word", "ids"])

    scratch = Scratch(docs.sparkSession, "lexicon")
    counts = scratch.store(word_counts(docs, path), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most `words` rows of at most LONGEST bytes come to the driver, by the choice of the share.
    frequent = counts.where(F.col("n") * F.lit(words) >= F.lit(total)).select("word")
    table = frequent.mapInArrow(merged, "word string, ids array<int>").toArrow()
    scratch.drop(counts)
    entries = zip((w.encode() for w in table.column(0).to_pylist()), table.column(1).to_pylist(), strict=True)
    return compile_lexicon(sorted(entries))


def send_lexicon(spark: SparkSession, data: bytes) -> str:
    """Store a lexicon in the shared folder and have Spark bring it to each executor; gives its name."""
    scratch, name = Scratch(spark, "lexicon"), f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for first in range(0, len(data), 1 << 24):
        stream.write(bytearray(data[first : first + (1 << 24)]))
    stream.close()
    spark.sparkContext.addFile(str(path))
    return name


def encode_documents(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text, through a lexicon of its own frequent words."""
    lexicon = send_lexicon(docs.sparkSession, build_lexicon(docs, path, words))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(WordBpe.at(path), Lexicon.sent(lexicon))
        for batch in batches:
            for part in _slices(batch, "text"):
                ids, decoded = encoder.encode(part.column("text"))
                ids, decoded = ids.cast(pa.list_(pa.int32())), decoded.cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ENCODED_SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """Token count, and digests of the decimal ids and of the decoded text."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
