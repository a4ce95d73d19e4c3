"""Lexicon, spelling variants and conversation trie against plain versions in Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lossledger.llm import conversation_trie, spelling_variants, word_lexicon

SCHEMA = "doc_id long, text string, word string, n long, ids array<int>, signature string"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def bpe():
    return word_lexicon.WordBpe(PATH)


# --- 11 lexicon -----------------------------------------------------------------------------


def test_words_of_all_settled_letters_and_odd_texts(bpe, library):
    rnd = random.Random(3)
    pieces = ["a", "B", "é", "é", "'s", "'LL", " ", "  ", "\n", "\x1c", "\x85", "　", "Σ", "ΑΣ", "İ", "ǅ", "日本", "1", "½"]
    pieces += ["...", "‍", "👍🏽", "\x00", "ﬁ", "ẞ", "\U00010940", "<|endoftext|>", "<|startoftext|>", "<|", "q" * 70, ",", "Ə:", "ŉ!"]
    texts = ["", "  ", "a" * 3000, "x" * 70 + "é", "é" * 40]
    texts += [f"{chr(c)} {chr(c)}. b{chr(c)}, {chr(c)}x" for c in [*range(0x558), *range(0x2000, 0x2070), *range(0x3000, 0x3100)]]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(1500)]
    encoder = word_lexicon.Encoder(bpe, word_lexicon.Lexicon(word_lexicon.compile_lexicon([])))
    ids, decoded = encoder.encode(pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert ids.to_pylist() == [w.ids for w in want]
    assert decoded.to_pylist() == [library.decode(w.ids, skip_special_tokens=False) for w in want]
    assert [bpe.decode(w.ids) for w in want] == decoded.to_pylist()


def test_transducer_is_minimal_and_gives_ids():
    rnd = random.Random(5)
    words = sorted({("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))) + rnd.choice(["", "ing", "ings"])).encode() for _ in range(800)})
    ids = [[rnd.randrange(1000) for _ in range(rnd.randint(1, 4))] for _ in words]
    lexicon = word_lexicon.Lexicon(word_lexicon.compile_lexicon(zip(words, ids, strict=True)))
    asked = [w.decode() for w in words] + ["", "zz", "a" * 9, "abingx", "é" * 100]
    found = lexicon.find(pa.array(asked, pa.large_string()))
    assert found.tolist() == [*range(len(words)), *(-1 for _ in asked[len(words) :])]
    assert [lexicon.ids[lexicon.starts[i] : lexicon.starts[i + 1]].tolist() for i in range(len(words))] == ids
    # The least number of states is the number of distinct sets of continuations.
    rests = collections.defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            rests[w[:i]].add(w[i:])
    assert len(lexicon.final) == len({frozenset(r) for r in rests.values()})
    with pytest.raises(ValueError):
        word_lexicon.compile_lexicon([(b"b", [1]), (b"a", [2])])


def test_long_words_take_the_same_merges(bpe, library):
    rnd = random.Random(8)
    for n in (1, 2, 64, 65, 66, 400, 20_000):
        word = "".join(rnd.choice("aeinrst") for _ in range(n))
        assert bpe.merge(word) == library.encode(word, add_special_tokens=False).ids
    some = ["aaaaaaaa", "", "the", "thththth", "a" * 64, "b" * 65]
    ids, sizes = bpe.merge_all(pa.array(some, pa.large_string()))
    assert np.split(ids, np.cumsum(sizes)[:-1])[2].tolist() == bpe.merge("the")
    assert [len(bpe.merge(w)) if w else 0 for w in some] == sizes.tolist()


def test_encoded_documents(spark, library):
    rnd = random.Random(9)
    words = ["The", "of", "tion", "éa", "Ring", "über", "x1", "it's", "日本", "<|endoftext|>"]
    texts = [None, "", " ", "one", *(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40))]
    texts += [texts[7], texts[7], "ab" * 30_000 + " end", " ".join(rnd.choice(words) + "." for _ in range(30_000))]
    rows = [(i if i % 9 else None, t, "word", 5, [1], "sig") for i, t in enumerate(texts)]
    for lexicon_words in (4, 1 << 20):
        got = word_lexicon.encode_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, lexicon_words)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect()) == sorted(
            (str(row[0]), ids, library.decode(ids, skip_special_tokens=False)) for row, ids in zip(rows, want, strict=True)
        )
    digest = {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_lexicon.digests(got).collect()}
    assert digest == {
        (
            len(ids),
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        )
        for ids in want
    }
    assert word_lexicon.encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_lexicon_holds_the_frequent_words(spark, bpe):
    docs = spark.createDataFrame([(i, "aa aa bb.") for i in range(10)] + [(11, "rare")], "doc_id long, text string")
    # 41 words: "aa" is 20 of them, "bb" and "." ten each, "rare" one
    for share, size in ((2, 0), (4, 1), (5, 3), (41, 4)):
        lexicon = word_lexicon.Lexicon(word_lexicon.build_lexicon(docs, PATH, share))
        assert len(lexicon) == size


# --- 12 spelling variants -------------------------------------------------------------------


def plain_variants(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(beside[w]), n[form[w]] if w in form else None))
    return out


def variant_rows():
    rnd = random.Random(12)
    base = ["".join(rnd.choice("aeirstnÀé×") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    base += ["".join(rnd.sample("abcdef", 6)) for _ in range(80)]  # anagrams: one signature
    words = []
    for w in base:
        words += [w] * rnd.choice([5, 6, 30, 160])
        i = rnd.randrange(len(w))
        changed = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("xyz") + w[i:], w[:i] + "q" + w[i + 1 :]])
        words += [changed] * rnd.choice([5, 26, 28])
    words += ["chainword"] * 170 + ["chainworda"] * 32 + ["chainwordab"] * 6
    rnd.shuffle(words)
    rows = [(i, " ".join(words[k : k + 50])) for i, k in enumerate(range(0, len(words), 50))]
    return rows + [(None, "Absent absent ABSENT, absent absenT"), (4, None), (5, ""), (7, "ab"), (8, "é" * 400 + " " + "word" * 20_000), rows[0], rows[0]]


def test_variants(spark, monkeypatch):
    rows = variant_rows()
    docs = spark.createDataFrame([(*r, "absent", 9, None, "s") for r in rows], SCHEMA).repartition(3)
    want = plain_variants(rows)
    assert {tuple(r) for r in spelling_variants.spelling_variants(docs).collect()} == want
    assert sum(w[1] is not None for w in want) > 10 and any(w[2] not in (w[0], w[1]) for w in want)
    # Many small cells, from a sample that misses most signatures.
    monkeypatch.setattr(spelling_variants, "CELL", 8)
    monkeypatch.setattr(spelling_variants, "SAMPLE", 64)
    monkeypatch.setattr(spelling_variants, "LEAF", 3)
    found = spelling_variants.spelling_variants(docs)
    assert {tuple(r) for r in found.collect()} == want
    groups = {r.root: (r.n, r.n_words) for r in spelling_variants.variant_groups(found).collect()}
    assert sum(k for _, k in groups.values()) == len(want)
    top = spelling_variants.most_frequent_of_each(found, 1).collect()
    assert len(top) == len(groups)


def test_no_variants(spark):
    assert spelling_variants.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, "letter letter letter letter"), (2, None)], "doc_id long, text string")
    assert spelling_variants.spelling_variants(few).count() == 0


def test_search_finds_all_at_a_distance():
    rnd = np.random.default_rng(4)
    points, queries = rnd.integers(0, 3, (300, 6)).astype(np.int16), rnd.integers(0, 3, (200, 6)).astype(np.int16)
    apart = np.abs(queries[:, None] - points[None]).sum(axis=2)
    for distance in (1, 2):
        q, p = spelling_variants.search(points, queries, distance)
        assert set(zip(q.tolist(), p.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(apart == distance)), strict=True))
    tree = spelling_variants.CoarseTree(points, 20)
    home = dict(zip(*map(np.ndarray.tolist, tree.visits(points, 0)), strict=True))
    visited = set(zip(*map(np.ndarray.tolist, tree.visits(queries, 2)), strict=True))
    assert tree.cells > 8 and all((i, home[j]) in visited for i, j in zip(*np.nonzero(apart <= 2), strict=True))


# --- 13 conversations -----------------------------------------------------------------------


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, set()
    for node in sorted(members, key=len, reverse=True):
        kids, convs = children[node], members[node]
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = sum(saved[k] for k in kids) + (len(convs) - 1) * words
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(convs), len(node), parent, len(convs), len(kids), leaves[node], saved[node], digest))
    return out


def conversation_rows():
    rnd = random.Random(13)
    says = ["hi", "hi there", "", "how are\tyou", "well\n\nthen", None]
    rows = []
    for c in [*range(0, 130), -40, -39, -25, -3, 10_007, 10_012]:
        if c % 20 == 0 and c > 60:
            continue  # a family without its first conversation
        for t in range(rnd.choice([1, 1, 2, 3, 5])):
            rows.append((c, t if t else None, rnd.choice(["user", None]), rnd.choice(says)))
    rows += [(141, t, "user", f"turn {t % 3}") for t in range(300)]  # one long conversation
    rows += [(c, t, "user", "the same " * 3) for c in range(200, 420) for t in range(4)]  # many equal ones
    rows += [(5, 0, "user", "twice"), (5, 0, "user", "twice"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


TURNS = "conv_id long, turn long, role string, text string, depth long, d1 long, part int, words long"


def test_trie(spark):
    rows = [r for r in conversation_rows() if r[0] != 5 or r[1] or r[3] == "twice"]  # no two different turns of one number
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS).repartition(5)
    got = [tuple(r) for r in conversation_trie.trie(wide).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_a_conversation_over_all_partitions(spark, monkeypatch):
    rows = [(41, t, "user", f"{t} {t % 7}") for t in range(900)] + [(40, t, "user", "x y") for t in range(2)] + [(42, 0, "user", "x y")]
    monkeypatch.setattr(conversation_trie, "CHUNK", 1)
    got = [tuple(r) for r in conversation_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert set(got) == plain_trie(rows)


def test_turns_of_one_number_have_an_order(spark):
    rows = [(1, 0, "user", f"say {i}") for i in range(6)] * 2 + [(2, None, "a", "b"), (2, None, "b", "a")]
    frames = [spark.createDataFrame(r, "conv_id long, turn long, role string, text string") for r in (rows, rows[::-1])]
    first, second = ({tuple(r) for r in conversation_trie.trie(f).collect()} for f in frames)
    assert first == second and max(r[1] for r in first) >= 9


def test_no_conversations(spark):
    assert conversation_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", 1, 1, 1, 1)], TURNS)
    assert conversation_trie.trie(nobody).count() == 0
