"""Each operator against a plain version in Python, on odd and on real documents."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from lossledger.llm import (
    learned_partitions,
    licence_scan,
    near_dedup,
    packing,
    piece_lattice,
    quality_classifier,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    token_shards,
)
from lossledger.llm.licence_texts import BASE_PHRASES, NOTICES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, row long, key int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sentences(rnd: random.Random, n: int) -> str:
    words = ["the", "of", "tion", "éa", "Ring", "ser", "über", "x1", "Nda", "ho", "ka", "li", "mo", "nu", "日本"]
    return " ".join("".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rnd = random.Random(11)
    passage, base = sentences(rnd, 60), sentences(rnd, 150)
    texts: list[str | None] = [None, "", " ", "a", "one two", "a" * 500, "ab " * 300, "\n\n", "CC BY Cc by"]
    texts += [sentences(rnd, rnd.randint(5, 80)) for _ in range(20)]
    texts += [sentences(rnd, 30) + " " + passage + "\n" + sentences(rnd, 10) for _ in range(6)]
    for _ in range(12):
        words = base.split(" ")
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = sentences(rnd, 1)
        texts.append(" ".join(words))
    texts += [base, base, texts[12], "All rights reserved. " + passage, sentences(rnd, 30_000)]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, "w", 7, 1) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """Repeated rows, one id for several texts, and rows without an id."""
    rows = odd_rows[:40] + odd_rows[35:40] + [(3, "another text for an id", "en", "src1", 4, "w", 7, 1)]
    rows += [(None, odd_rows[30][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- 1 token shards -----------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_is_the_library():
    rnd, plain = random.Random(1), tokenizer()
    pieces = ["a", "B", " ", "  ", "\n", "\t", "'", "s", "1", ".", ",", "é", "\xa0", "　", "\x1c", "\x85", "日", "<|endoftext|>", "\x01"]
    texts = ["", " ", "x <|endoftext|> y", "x  <|endoftext|>  y", " a", "a   b", "a \n b", "it's 's", "x, y."] + [
        "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(800)
    ]
    encoder = token_shards.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for first in range(0, len(texts), 50):
        some = texts[first : first + 50]
        want = [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(some)] == want


def test_wavelet_matrix_queries():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 7, 512, 513, 3000):
        ids = rnd.integers(0, 40, n).astype(np.uint16) * 1201
        planes, zeros, ranks = token_shards.build_planes(ids)
        assert np.array_equal(token_shards.decode_planes(n, planes), ids)
        matrix = token_shards.WaveletMatrix(n, planes, zeros, ranks)
        assert [matrix.access(i) for i in range(n)] == ids.tolist()
        for token in {*ids[:3].tolist(), 5}:
            at = np.flatnonzero(ids == token).tolist()
            assert matrix.count(token) == len(at) and matrix.occurrences(token) == at
            assert matrix.count(token, n // 3, n // 2) == sum(n // 3 <= i < n // 2 for i in at)
            assert matrix.select(token, len(at)) == -1


def shards_match(df, rows):
    plain, start, want = tokenizer(), 0, {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()} == want


def test_token_shards(odd, odd_rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards_match(token_shards.encode_documents(odd, path), odd_rows)
    assert token_shards.encode_documents(empty, path).count() == 0


def test_small_shards_and_occurrences(spark, odd, odd_rows, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = token_shards.write_shards(odd, path, str(tmp_path / "s"), shard_tokens=500)
    assert shards.count() > 5
    shards_match(token_shards.read_tokens(shards), odd_rows)
    token = tokenizer().encode(" the").ids[0]
    total = sum(tokenizer().encode(r[1] or "").ids.count(token) for r in odd_rows)
    assert token_shards.occurrences(shards, token).count() == total


def test_token_shards_repeated_ids(clashing):
    out = token_shards.encode_documents(clashing, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert len(rows) == clashing.count() and [r.doc_id for r in rows][:2] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


# --- 2 packing ----------------------------------------------------------------------------


def plain_pack(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [
            (b["room"], i)
            for i, b in enumerate(bins)
            if b["room"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])
        ]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[i]["room"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_tightest_compatible_bin(seed):
    rnd = random.Random(seed)
    n, capacity = 400, rnd.choice([7, 64, 100])
    lengths = sorted((rnd.randint(1, capacity) for _ in range(n)), reverse=True)
    sources = [rnd.choice(["hot", "hot", "a", "b", None, "c"]) for _ in range(n)]
    clusters = [rnd.choice([None, "x", "y", *map(str, range(50))]) for _ in range(n)]
    placed, offsets, room = packing.pack(lengths, sources, clusters, capacity)
    assert placed == plain_pack(lengths, sources, clusters, capacity)
    assert all(o + n <= capacity and r >= 0 for o, n, r in zip(offsets, lengths, room))


def packed_whole(df, rows, capacity):
    got = df.collect()
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
        pieces.setdefault(r.row, []).append(r)
    for members in bins.values():
        spans = sorted((r.offset, r.offset + r.length) for r in members)
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    totals = sorted(sum(p.length for p in ps) for ps in pieces.values())
    assert totals == sorted(len(SPACED.findall(r[1] or "")) + 1 for r in rows)
    return bins


def test_packing_documents(odd, odd_rows, empty):
    bins = packed_whole(packing.pack_documents(odd, 100, 60), odd_rows, 100)
    source = {r[0]: r[3] for r in odd_rows}
    for members in bins.values():
        named = [source[m.doc_id] for m in members if source[m.doc_id]]
        assert len(named) == len(set(named))
    assert packing.pack_documents(empty).count() == 0


def test_packing_repeated_ids(clashing):
    rows = [tuple(r) for r in clashing.collect()]
    packed_whole(packing.pack_documents(clashing, 64), rows, 64)


# --- 3 piece lattice ----------------------------------------------------------------------


def test_lattice_is_the_library(spark, odd_rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, model = piece_lattice.PieceTable.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    parts = list("abcdeABC  \n\t.,!?'-_*#%12½²éè日😀▁") + ["the", "tion", "    ", "====", "　", "x" * 70]
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 5000]
    rows += [(1000 + i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))) for i in range(400)]
    done = piece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), table)
    got = by_id(done.withColumn("back", piece_lattice.decode(done.ids, table)))
    for i, text in rows:
        want = model.encode(text or "")
        assert got[i].ids == want and got[i].back == model.decode(want)
    assert piece_lattice.encode(empty, table).count() == 0


def test_viterbi_takes_the_best_path(spark):
    rnd = random.Random(5)
    vocabulary = {c: -rnd.uniform(4, 8) for c in "abc▁"} | {
        "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4))): -rnd.uniform(1, 9) for _ in range(25)
    }
    pieces = tuple((p, i + 1, s) for i, (p, s) in enumerate(vocabulary.items()))
    table = piece_lattice.PieceTable("unigram", pieces, ("", *(p.encode().hex() for p in vocabulary)), None, 0)
    units = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    ids = {p: i for p, i, _ in pieces}
    lowest = min(vocabulary.values()) - 10

    def best(unit):
        state = [(0.0, [])]
        for e in range(1, len(unit) + 1):
            options = [(state[s][0] + vocabulary[unit[s:e]], state[s][1] + [ids[unit[s:e]]]) for s in range(e) if unit[s:e] in vocabulary]
            if unit[e - 1] not in vocabulary:
                options.append((state[e - 1][0] + lowest, state[e - 1][1] + [0]))
            state.append(max(options))
        return state[-1][0]

    scores = {i: s for _, i, s in pieces} | {0: lowest}
    frame = spark.createDataFrame([(u,) for u in dict.fromkeys(units)], "unit string")
    for r in piece_lattice.segment(frame, table).collect():
        assert math.isclose(sum(scores[i] for i in r.ids), best(r.unit), abs_tol=1e-9)


def test_lattice_cuts_each_text_once(spark, odd_rows, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, model = piece_lattice.PieceTable.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 5000]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents"))
    done = piece_lattice.encode(spark.read.parquet(str(tmp_path / "documents")), table)
    # What is left to do reads the stored units and numbers; the documents are neither read nor cut again.
    assert done.inputFiles() and not any("documents" in f for f in done.inputFiles())
    assert {r.doc_id: r.ids for r in done.collect()} == {i: model.encode(text or "") for i, text in rows}


def test_lattice_units_are_those_of_a_pattern():
    import pyarrow as pa

    mark, letters = piece_lattice.MARK, r"[^\W\d_]"
    fine = re.compile(rf"{mark}*{letters}+|{mark}*(?:(?!{mark}|{letters}).)+|{mark}+", re.DOTALL)
    coarse = re.compile(rf"{mark}+[^{mark}]*|[^{mark}]+")
    rnd = random.Random(7)
    texts = ["", " ", "a", "  a b", "日本 1é", *("".join(rnd.choice("ab  \n1.é日😀▁") for _ in range(rnd.randint(0, 60))) for _ in range(200)), ""]
    for pattern, is_fine in ((fine, True), (coarse, False)):
        wanted = [pattern.findall(mark + t.replace(" ", mark)) if t else [] for t in texts]
        units, counts = piece_lattice.cut(pa.array(["unread", *texts]).slice(1), is_fine)
        assert counts.tolist() == [len(w) for w in wanted]
        assert units.to_pylist() == [u for w in wanted for u in w]
    assert piece_lattice.cut(pa.array([], pa.string()), True)[0].to_pylist() == []


def test_lattice_numbers_come_back():
    for kind in (np.int64, np.uint32):
        for n in (0, 1, 1000):
            numbers = np.random.default_rng(n).integers(0, 1 << 31, n).astype(kind)
            assert np.array_equal(piece_lattice._spread(piece_lattice._squeeze(numbers), kind), numbers)


# --- 4 suffix dedup -----------------------------------------------------------------------


def plain_bytes(rows, width=200):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen: dict[bytes, int] = {}
    for _, b in data:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k] += 1
                gone[min(k + width, len(b))] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], mask.astype(int)))) == 1))
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def first_columns(df, n):
    return sorted((tuple(r)[:n] for r in df.collect()), key=str)


def test_suffix_dedup(odd, odd_rows, empty):
    assert first_columns(suffix_dedup.remove_repeats(odd), 5) == sorted(plain_bytes(odd_rows), key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_repeated_ids(clashing):
    rows = [tuple(r) for r in clashing.collect()]
    assert first_columns(suffix_dedup.remove_repeats(clashing), 5) == sorted(plain_bytes(rows), key=str)


def test_stripped_documents_keep_their_columns(clashing):
    out = suffix_dedup.strip_documents(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert out.where("text is null").count() == clashing.where("text is null").count()


# --- 5 licence scan -----------------------------------------------------------------------


def test_base_phrases_everywhere(odd, odd_rows, clashing, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = by_id(licence_scan.scan_licences(odd))
    for r in odd_rows:
        found, labels = [], set()
        w = words.findall((r[1] or "").translate(LOWER))
        for phrase, label in BASE_PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            found += at
            labels |= {label} if at else set()
        g = got[r[0]]
        assert (g.n_words, g.n_base) == (len(w), len(found))
        assert (g.first_word, g.last_word) == ((min(found), max(found)) if found else (None, None))
        assert g.base_labels == ",".join(sorted(labels)) and labels <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert licence_scan.scan_licences(clashing).count() == clashing.count()
    assert licence_scan.scan_licences(empty).count() == 0


def test_notices_need_their_key_phrases(spark):
    texts = [
        "Intro. Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software",
        "Permission was hereby granted, free of charge, to any person obtaining a copy of this software",
        "released under the mit licence",
        "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any natural person obtaining a copy of this software",
        "Permission is hereby and now granted, free of charge, to any person obtaining a copy of this software",
        "Licensed under the terms of the Apache License, Version 2.0",
        "Licensed under the Apache License that we have kept for ourselves, Version 2.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ]
    got = by_id(licence_scan.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].labels for i in range(9)] == ["mit", "", "", "cc-by,cc-by-nc", "mit", "mit", "apache-2.0", "", ""]


def plain_notices(texts):
    """Labels and score of each text: every band of every notice, aligned word by word."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    docs = [find((t or "").translate(LOWER)) for t in texts]
    groups = [(label, text, (), 1.0, 0) for text, label in BASE_PHRASES.items()]
    groups += [(label, text, keys, licence_scan.SHARE, licence_scan.SLACK) for label, text, keys in NOTICES]
    out = []
    for doc in docs:
        labels, score = set(), 0.0
        for label, text, keys, share, slack in groups:
            notice = find(text.translate(LOWER))
            weights = [math.log((len(docs) + 2) / (sum(w in set(d) for d in docs) + 1)) for w in notice]
            for begin in range(-len(notice) - slack, len(doc)):
                pairs = [
                    (p, x)
                    for p, w in enumerate(notice)
                    for x in range(max(begin + p, 0), min(begin + p + slack + 1, len(doc)))
                    if doc[x] == w
                ]
                heaviest = {}
                for p, x in pairs:
                    before = [v for (q, y), v in heaviest.items() if q < p and y < x]
                    heaviest[p, x] = weights[p] + max(before, default=0.0)
                value = max(heaviest.values(), default=0.0) / sum(weights)
                inside = doc[max(begin, 0) : max(begin + len(notice) + slack, 0)]
                stand = all(f" {k} " in f" {' '.join(inside)} " for k in keys)
                if value >= share - 1e-9 and stand:
                    labels.add(label)
                    score = max(score, min(value, 1.0))
        out.append((",".join(sorted(labels)), score))
    return out


def test_notices_equal_a_plain_alignment(spark):
    rnd = random.Random(5)
    texts: list[str | None] = [None, "", "of the " * 300, "licensed " * 50 + "under the mit license " * 40]
    for _ in range(4):
        for _, notice, _ in NOTICES:
            words = notice.split(" ")
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["the"], ["any", "work"], ["licensed"], ["x1"], [words[at]] * 2])
                words = words or ["x1"]
            other = rnd.choice(NOTICES)[1] if rnd.random() < 0.3 else sentences(rnd, 4)
            texts.append(" ".join([sentences(rnd, rnd.randint(0, 9)), *words, other]).strip())
    rows = [(i, t) for i, t in enumerate(texts)]
    got = by_id(licence_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = plain_notices(texts)
    assert [got[i].labels for i, _ in rows] == [labels for labels, _ in want]
    assert [got[i].score for i, _ in rows] == pytest.approx([score for _, score in want])
    assert 20 < sum(bool(labels) for labels, _ in want) < len(rows) - 10


def test_postings_name_every_place():
    index = licence_scan.PositionalIndex()
    for number, (_, words, *_) in enumerate(index.sources):
        mine = index.notice == number
        assert sorted(index.place[mine].tolist()) == list(range(len(words)))
        assert (index.vocabulary[index.word[mine]] == words[index.place[mine]]).all()


# --- 6 near dedup -------------------------------------------------------------------------


def plain_components(rows):
    sets = []
    for r in rows:
        w = SPACED.findall((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    parent[root(a)] = root(b)
    big = 1 << 62
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), big), big if r[0] is None else r[0])
    named = lambda v: None if v == big else v
    return [(r[0], len(sets[i]), named(least[root(i)])) for i, r in enumerate(rows)]


def test_near_duplicates(odd, odd_rows, clashing, empty):
    assert first_columns(near_dedup.near_duplicates(odd), 3) == sorted(plain_components(odd_rows), key=str)
    rows = [tuple(r) for r in clashing.collect()]
    assert first_columns(near_dedup.near_duplicates(clashing), 3) == sorted(plain_components(rows), key=str)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_chains_of_copies_are_one_component(spark):
    rnd = random.Random(9)
    words, rows = sentences(rnd, 200).split(" "), []
    for i in range(40):  # neighbours are alike, the ends aren't
        words = list(words)
        for _ in range(2):
            words[rnd.randrange(200)] = f"new{i}{rnd.random()}"
        rows.append((40 - i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert first_columns(near_dedup.near_duplicates(frame), 3) == sorted(plain_components(rows), key=str)


def borderline_copies(rnd, n):
    """Copies of two texts that lie on both sides of the threshold, from each other and from the text."""
    rows = []
    for family in range(2):
        base = [f"w{family}x{i}" for i in range(120)]
        shared = [[f"s{family}x{j}x{i}" for i in range(120)] for j in range(3)]
        for _ in range(n // 2):
            words = list(base[: rnd.choice([120, 120, 117, 110])])
            for _ in range(rnd.choice([1, 2, 3, 4, 4, 5])):
                at = rnd.randrange(len(words))
                words[at] = rnd.choice([*(s[at] for s in shared), f"own{rnd.random()}"])
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("pairs_a_row", [0, near_dedup.PAIRS])
def test_copies_around_the_threshold(spark, monkeypatch, pairs_a_row):
    monkeypatch.setattr(near_dedup, "PAIRS", pairs_a_row)
    rows = borderline_copies(random.Random(4), 300)
    rows += [(1000 + i, "a b c d e f g h " + "k " * i) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert first_columns(near_dedup.near_duplicates(frame), 3) == sorted(plain_components(rows), key=str)


def test_compared_pairs_grow_with_the_copies(spark, monkeypatch):
    compared = []
    advance = near_dedup._Search.advance

    def counted(self, pairs):
        known = len(self.tried)
        out = advance(self, pairs)
        compared.extend(t.count() for t in self.tried[known:])
        return out

    monkeypatch.setattr(near_dedup._Search, "advance", counted)
    rnd = random.Random(8)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(2000):  # four or five words of the text replaced: nearly all just too different
        words = list(base)
        for at in rnd.sample(range(120), rnd.choice([3, 4, 4, 5])):
            words[at] = f"own{i}x{at}"
        rows.append((i + 1, " ".join(words)))
    rows.append((0, " ".join(base)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = plain_components(rows)
    assert first_columns(out, 3) == sorted(plain, key=str)
    assert len({c for _, _, c in plain}) > 500
    assert sum(compared) < 40 * len(rows)  # 2,000 * 1,999 / 2 is 1,000 for each row


def test_one_of_each_stays(clashing):
    kept = near_dedup.keep_one_of_each(clashing)
    rows = [tuple(r) for r in clashing.collect()]
    plain = plain_components(rows)
    groups = {p[2] if p[2] is not None else ("none", i) for i, p in enumerate(plain) if p[1]}
    empties = sum(p[1] == 0 for p in plain)
    assert kept.columns == clashing.columns and kept.count() >= len(groups) + empties - 1


def test_pruning_bounds():
    for m, least in near_dedup.least_agreements():
        t = 0.75
        below = sum(math.comb(m + 1, c) * t**c * (1 - t) ** (m + 1 - c) for c in range(least))
        assert below < near_dedup.MISS


# --- 7 nearest neighbours -----------------------------------------------------------------


def test_neighbours_and_recall(spark):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((1500, 16)).astype(np.float32)
    x[300:420] = x[300]  # a very common vector
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(len(x))]
    rows += [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0], 1), (None, rows[0][1], 1)]
    rows += [(5080, [None, *rows[0][1][1:]], 1), rows[7]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in learned_partitions.search(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    full, hits = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        s = full @ full[q]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(math.isclose(v, s[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, v in found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        hits += len({i for _, i, _ in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9
    assert learned_partitions.search(frame.limit(0)).count() == 0


def test_balanced_parts():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((500, 8))
    part = learned_partitions.balanced_parts(learned_partitions.neighbours(x, x, 8, np.arange(500)), 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3


# --- 8 substring dedup --------------------------------------------------------------------


def plain_words(rows, width=13):
    last = 1 << 62
    words = [SPACED.findall(r[1] or "") for r in rows]
    least: dict[tuple, int] = {}
    for r, w in zip(rows, words):
        for k in range(len(w) - width + 1):
            t = tuple(w[k : k + width])
            least[t] = min(least.get(t, last), last if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (last if r[0] is None else r[0]):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(odd, odd_rows, clashing, empty):
    assert first_columns(substring_dedup.remove_repeats(odd), 4) == sorted(plain_words(odd_rows), key=str)
    rows = [tuple(r) for r in clashing.collect()]
    assert first_columns(substring_dedup.remove_repeats(clashing), 4) == sorted(plain_words(rows), key=str)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_small_groups_give_the_same_nodes(spark, odd, odd_rows, monkeypatch):
    for limit in (1, 3, 50):
        monkeypatch.setattr(substring_dedup.deep_nodes, "__defaults__", (limit,))
        assert first_columns(substring_dedup.remove_repeats(odd), 4) == sorted(plain_words(odd_rows), key=str)


# --- 9 and 10 quality ---------------------------------------------------------------------

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def is_held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_classifier_on_held_out_rows(real):
    docs, labels = real
    got = by_id(quality_classifier.classify(docs, labels))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() and all(g.held_out == is_held(i) and 0 <= g.score <= 1 for i, g in got.items())
    held = [i for i in truth if is_held(i)]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) >= 0.97
    assert sum(got[i].predicted == 0 for i in held if truth[i]) / len(held) <= 0.01


def test_classifier_on_odd_rows(real, clashing, empty):
    _, labels = real
    rows = quality_classifier.classify(clashing, labels).collect()
    assert len(rows) == clashing.count() and all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality_classifier.classify(empty, labels).count() == 0
    none = quality_classifier.classify(clashing, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.keep_good(clashing, labels).columns == clashing.columns


def plain_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    at: dict[tuple, list[int]] = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_rule_counts(real, odd, odd_rows, clashing, empty):
    docs, labels = real
    for frame, rows in ((odd, odd_rows), (docs, [tuple(r) for r in docs.collect()])):
        got = by_id(quality_rules.quality_rules(frame, labels))
        for r in rows:
            want, g = plain_counts(r[1]), got[r[0]]
            assert tuple(g)[1:6] == want
            assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert g.kept == (not g.base_failed and g.probability >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(clashing, labels).count() == clashing.count()
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(odd, labels.limit(0)).collect())


def test_verdict_on_held_out_rows(real):
    docs, labels = real
    got = by_id(quality_rules.quality_rules(docs, labels))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [i for i in truth if is_held(i) and not got[i].base_failed]
    assert sum(got[i].kept == bool(truth[i]) for i in judged) / len(judged) >= 0.98
