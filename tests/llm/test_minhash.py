import random
import re
import string

import numpy as np
import pytest

from refweave.llm import linking, minhash, wordset
from refweave.llm.shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {k: brute_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string, kept int")
    return {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(df, **kw).collect()}


def near_group(seed, n, words, edits):
    rng = random.Random(seed)
    base = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = "".join(rng.choices(string.ascii_letters, k=5))
        out.append(" ".join(own))
    return out


def test_edges(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "one two", "ONE  two", "two one", "a b c d e", "A B C D E", "a b c d e f", "é É x y z", "É É x y z", "x y a b c d", "w " * 5000, "w " * 90]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_groups_and_hot_buckets(spark):
    texts = near_group(1, 60, 80, 1) + near_group(2, 40, 200, 4) + near_group(3, 30, 40, 2) + ["same text in many rows of the table"] * 50
    random.Random(5).shuffle(texts)
    rows = [(i * 3, t, None, None) for i, t in enumerate(texts)]
    want = brute([r[:2] for r in rows])
    assert run(spark, rows) == want
    assert run(spark, rows, block=8) == want  # many tiles


def test_null_and_repeated_ids(spark):
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)]
    assert [tuple(r) for r in got if r[0] is None] == [(None, 2, None, True)]


TEXT_A, TEXT_B = "words of a first text that is like no other text here at all", " ".join(f"b{i}" for i in range(60))
NEAR_B = TEXT_B.replace("b59", "other")


def test_repeated_ids_with_other_texts(spark):
    rows = [(4, TEXT_A), (4, TEXT_B), (2, NEAR_B), (9, TEXT_B), (4, TEXT_A)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    a = len(brute_set(TEXT_A))
    assert got == sorted([(4, a, 4, True), (4, 56, 2, False), (2, 56, 2, True), (9, 56, 2, False), (4, a, 4, True)])


def test_deduplicate_keeps_one_row_of_each_group(spark):
    names = "doc_id long, text string, key0 string, _maybe int, _id string"
    rows = [(4, TEXT_A, "x", 1, None), (4, TEXT_A, "w", 2, None), (4, TEXT_A, "x", 1, None), (4, TEXT_B, "y", 1, "i"), (2, NEAR_B, None, None, None), (9, TEXT_B, "z", 1, "i"), (2, NEAR_B + " tail", "q", 0, None)]
    rows += [(None, TEXT_B, "n", 1, None), (None, TEXT_B, "n", 1, None), (11, None, "e", 1, None), (11, "", "e", 1, None), (11, " ", "e", 1, None), (12, TEXT_A[::-1], "e", 1, None)]
    df = spark.createDataFrame(rows, names)
    out = minhash.deduplicate(df)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns
    heads = [r for r in rows if r[0] == 2]
    assert sum(r in got for r in heads) == 1
    want = [(4, TEXT_A, "w", 2, None), *(r for r in got if r in heads), *rows[7:]]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert minhash.deduplicate(df.limit(0)).count() == 0


def test_template_bucket_is_refined(spark, monkeypatch):
    # Unlike documents that all hold a template meet in its bands; prefixes by rare shingles set them apart.
    rng = random.Random(9)
    template = " ".join(f"t{i}" for i in range(60))
    texts = [template + " " + " ".join(f"u{k}x{rng.randrange(10**9)}" for _ in range(30)) for k in range(150)]
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[:40]]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    monkeypatch.setattr(linking, "CROWD", 2)
    calls = []
    finer = minhash._finer
    monkeypatch.setattr(minhash, "_finer", lambda percent: lambda f: calls.append(1) or finer(percent)(f))
    assert run(spark, rows, block=8) == brute([r[:2] for r in rows])
    assert calls
    held = spark.createDataFrame([(1, i, sorted(hash(x) for x in brute_set(t))) for i, t in enumerate(texts)], "bucket long, id long, payload array<long>")
    met = {}
    for r in finer(85)(held).collect():
        met.setdefault(r.bucket, set()).add(r.id)
    pairs = {(a, b) for ids in met.values() for a in ids for b in ids if a < b}
    assert {(i, 150 + i) for i in range(40)} <= pairs and len(pairs) < 400  # of 17955


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("piece", [7, 64])
def test_word_hashes_in_pieces(monkeypatch, piece):
    texts = ["", "alpha beta  gamma", "x" * 200, "one\ttwo\nTHREE", "", "end"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    whole = wordset.word_hashes(data, offsets)
    monkeypatch.setattr(wordset, "PIECE", piece)
    monkeypatch.setattr(wordset, "_UP", wordset._powers(wordset._BASE, piece + 1))
    monkeypatch.setattr(wordset, "_DOWN", wordset._powers(wordset._INVERSE, piece + 1))
    cut = wordset.word_hashes(data, offsets)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert np.diff(whole[1]).tolist() == [len(WORD.findall(t)) for t in texts]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, {a}), root.setdefault(b, {b})
            if root[a] is not root[b]:
                root[a] |= root[b]
                for x in root[b]:
                    root[x] = root[a]
    got = {r.id: r.component for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: min(v) for k, v in root.items()}


def test_buckets_of_one_group_are_tested_as_one(spark, monkeypatch):
    """A group that fills a bucket of every band is dealt to tiles once where that copies less, and its links are those of brute force."""
    copies, dealt = [], linking._dealt

    def counted(rows):
        out = dealt(rows)
        copies.append((out.count(), out.select("id").distinct().count()))
        return out

    monkeypatch.setattr(linking, "_dealt", counted)
    rows = list(enumerate(near_group(3, 60, 200, 3)))
    got = run(spark, [(k, t, None, None) for k, t in rows], block=16)
    assert got == brute(rows)
    made, ids = copies[0]
    assert ids > 16 and made <= 20 * ids
