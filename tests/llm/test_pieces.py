import hashlib
import random
import tracemalloc

import pytest

from refweave.llm import pieces, registry

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def odd_texts():
    rng = random.Random(4)
    out = ["", " ", "  ", "\n", "a\n b", "<s> <0x41> <unk>", "  Hello  world\n\nx\t y é\0 z😀", "日本語テスト 執拗に", "x" * 3000, " " * 77, "ab" * 700 + " " + "é" * 600]
    out += ["".join(rng.choice("abcdefgh eéтест日本 \n") for _ in range(3000)), "".join(chr(rng.randrange(1, 0x2000)) for _ in range(2000))]
    out += ["def f(foo_bar): return   12345\n" * 40, "aaaaabbbbb" * 300]
    return out


def test_same_ids_as_the_library(model):
    matcher, speller = pieces.Matcher(pieces.Pieces.load()), pieces.Speller(pieces.Pieces.load())
    texts = odd_texts()
    for _ in range(2):  # from the cache the second time
        flat, start = matcher.encode(texts)
        for t, a, b in zip(texts, start[:-1], start[1:]):
            assert flat[a:b].tolist() == model.encode(t), t[:50]
            assert speller.decode(flat[a:b].tolist()) == model.decode(model.encode(t)) == t


def test_forgetting(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 10)
    monkeypatch.setattr(pieces, "BATCH", 64)
    matcher = pieces.Matcher(pieces.Pieces.load())
    for t in ["one two three four five six seven", "eight nine ten eleven twelve", "one two thirteen" * 9]:
        flat, _ = matcher.encode([t])
        assert flat.tolist() == model.encode(t)


def test_frames(spark, model):
    rows = [(i, t, "x", [1]) for i, t in enumerate([None, *odd_texts(), "literal ▁ mark"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_sha256 string, ids array<int>")
    got = {r.doc_id: r for r in pieces.encode(df, verify=True).collect()}
    for i, t, *_ in rows:
        assert got[i].ids == (None if t is None else model.encode(t))
        assert got[i].decoded_sha256 == (None if t is None else hashlib.sha256(t.replace("▁", " ").encode()).hexdigest())
        assert got[i].round_trip == (None if t is None else True)
    spelled = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert spelled == {i: None if t is None else t.replace("▁", " ") for i, t, *_ in rows}
    assert pieces.encode(df.limit(0)).count() == 0


def test_bytes_that_are_no_text(model):
    speller = pieces.Speller(pieces.Pieces.load())
    for ids in ([3 + 0xE3], [3 + 0x41, 3 + 0xC3, 3 + 0xA9], [], [1, 2]):
        assert speller.decode(ids) == model.decode(ids)


def test_whole_table(spark, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = registry.op9_suffix_pieces(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert all(r.round_trip and r.ids == model.encode(docs[r.doc_id]) and r.n_ids == len(r.ids) for r in got)


def test_memory_of_new_words():
    """A worker that meets many words at once indexes few of them at a time, and the ids do not depend on how many."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=rng.randrange(3, 12))) for _ in range(3000)) for _ in range(40)]
    model = pieces.Pieces.load()
    matcher = pieces.Matcher(model)
    tracemalloc.start()
    flat, start = matcher.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6
    one = pieces.Matcher(model)
    assert [flat[a:b].tolist() for a, b in zip(start[:3], start[1:4])] == [one.encode([t])[0].tolist() for t in texts[:3]]
