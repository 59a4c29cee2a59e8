import re
from collections import Counter

from refweave.llm import mixing, registry
from refweave.llm.shared import table


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")


def check(rows, got, slack=1):
    words = {}
    for i, s, t in rows:
        words.setdefault(s, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    sizes = {s: sum(x) for s, x in words.items()}
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    source = {i: s for i, s, _ in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] += r.taken
    for s in sizes:
        # A source of few documents can't come nearer than half a document.
        near = slack if len(words[s]) > 10 else max(words[s]) / 2 + 1
        assert abs(taken[s] - want[s]) <= near, (s, taken[s], want[s])


def test_small(spark):
    rows = [(i, ["b", "a", None, "z", "é", ""][i % 6], " ".join(["w"] * (i % 17))) for i in range(200)]
    rows += [(200, "long", "w\t\n" * 3000), (201, "none", None), (202, "none", " "), (203, "tiny", "one"), (204, "nbsp", "a b c")]
    first = mixing.mix(frame(spark, rows)).collect()
    check(rows, first)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(first, key=repr) == sorted(again, key=repr)


def test_levels_and_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i, "hot" if i % 2 else f"s{i % 7}", " ".join(["w"] * (1 + i * i % 23))) for i in range(700)]
    got = mixing.mix(frame(spark, rows)).collect()
    check(rows, got)


def test_rounding_is_unbiased(spark):
    rows = [(i, "a" if i < 60 else "b", " ".join(["w"] * (1 + i % 5))) for i in range(90)]
    total, n = 0, 12
    for seed in range(n):
        total += sum(r.copies for r in mixing.mix(frame(spark, rows), seed=seed).collect() if r.size == 1)
    want = sum((brute_targets({"a": 180, "b": 90}))["a" if i < 60 else "b"] / (180 if i < 60 else 90) for i in range(90) if i % 5 == 0)
    assert abs(total / n - want) < 2.5


def test_empty_and_repeated(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, "a", None), (2, None, "")])).filter("taken > 0 or target > 0").count() == 0
    assert mixing.mix(frame(spark, [(1, "a", "x y")] * 5 + [(None, "b", "x")])).count() == 6


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_take_gives_what_mix_says(spark):
    rows = [(i % 40, f"s{i % 3}", " ".join(["w"] * (1 + i % 9)), i, "x", "y") for i in range(120)]
    rows += [(7, "s1", "one two three four five six seven eight nine ten", 5, "x", "y")] * 50  # one key for a third of all rows
    rows += [(None, "s2", "a b", 5, None, "y"), (None, "s2", "a b", 6, None, "y"), (1, None, None, 1, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, mark string, _mark string")
    mixed = mixing.mix(docs)
    assert len(mixed.columns) == 7 and mixed.count() == len(rows)
    assert max(r.copies for r in mixed.collect()) <= 3
    got = mixing.take(docs, mixed)
    assert got.columns == docs.columns
    taken = Counter(map(tuple, got.collect()))
    assert set(taken) <= set(rows) and all(n <= 3 * Counter(rows)[r] for r, n in taken.items())
    assert sum(words_of(r[2]) * n for r, n in taken.items()) == sum(r.taken for r in mixed.collect())
    again = mixing.take(docs.repartition(5), mixing.mix(docs.repartition(3)))
    assert Counter(map(tuple, again.collect())) == taken
    few = spark.createDataFrame([(1, "a", "w " * 10)] * 5 + [(2, "b", "w " * 10)], "doc_id long, source string, text string")
    assert mixing.take(few, mixing.mix(few)).count() == sum(r.copies for r in mixing.mix(few).collect()) == 6
    assert mixing.take(docs.limit(0), mixing.mix(docs.limit(0))).count() == 0


def test_amends():
    assert mixing.amends(0, [(3, 1)], [(2, 2)]) == []
    assert sorted(mixing.amends(7, [(5, 1), (4, 2), (2, 3), (1, 4)], [])) == [(1, 1), (3, 1)]
    assert mixing.amends(-5, [], [(9, 1), (5, 2)]) == [(2, -1)]
    assert sorted(mixing.amends(1, [(10, 1)], [(9, 2), (4, 3)])) == [(1, 1), (2, -1)]


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source", "text").collect()]
    check(rows, registry.op7_pivotal_mix(spark, "/root/testdata/sf0.01").collect(), slack=10)  # of 10,000 words and more
