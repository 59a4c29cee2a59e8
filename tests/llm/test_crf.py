import itertools
import math
import re
import zlib

import numpy as np

from refweave.llm import crf, registry
from refweave.llm.shared import table


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = [1, 4, 2, 5]
    first = np.concatenate(([0], np.cumsum(sizes)))
    e, t = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    good, pairs, logz = crf.marginals(e, first, t, pairs=True)
    want_good, want_pairs, want_z = [], np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        mass, sums, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[a + i] * v for i, v in enumerate(y)) + sum(t[u, v] for u, v in zip(y, y[1:])))
            mass += w
            sums += w * np.array(y)
            for u, v in zip(y, y[1:]):
                two[u, v] += w
        want_good += list(sums / mass)
        want_pairs += two / mass
    assert np.allclose(good, want_good) and np.allclose(pairs, want_pairs)


def test_line_features_do_not_depend_on_neighbours():
    texts = ["", "One two two.\nLINE!! 12\n", "\n", "é x | y", "same\nsame"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole, length, first = crf.line_features(data, offsets)
    assert np.diff(first).tolist() == [t.count("\n") + 1 for t in texts]
    assert length.tolist() == [len(x.encode()) for t in texts for x in t.split("\n")]
    for i, t in enumerate(texts):
        one, _, _ = crf.line_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert np.allclose(one, whole[:, first[i] : first[i + 1]])
    assert whole[crf.FEATURES.index("again")].tolist()[-2:] == [0, 1]


def slow_features(text):
    """The features of each line by definition, a line at a time."""
    lines, out, before = text.split("\n"), [], []
    for line in lines:
        raw = line.encode()
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        share = lambda good: sum(map(good, raw)) / max(len(raw), 1)
        f = [math.log2(len(raw) + 1), len(raw) / len(words) if words else 0]
        f += [share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in b"#$%&*+/<=>@\\^_`{}~()[]-"), share(lambda b: b in b"!?"), share(lambda b: b == 124), share(lambda b: b in b".,;:'\""), share(lambda b: b >= 128)]
        f += [sum(a == b for a, b in zip(words, words[1:])) / max(len(words) - 1, 1), len(set(words)) / len(words) if words else 1]
        f += [float(bool(words) and words in before), float(raw[-1:] in (b".", b"!", b"?") and bool(raw)), float(bool(raw) and (65 <= raw[0] <= 90 or raw[0] >= 195))]
        before.append(words)
        out.append(f)
    return lines, out


def slow_score(model, text):
    """A document's score by sums over neighbours and over all paths through a table, in plain floats."""
    lines, feats = slow_features(text)
    bins = [[sum(x >= e for e in edges) for x, edges in zip(np.float32(f), model.edges)] for f in feats]
    emission = []
    for i in range(len(lines)):
        e = model.bias
        for side, j in enumerate((i, i - 1, i + 1)):
            for f in range(len(crf.FEATURES)):
                e += model.weights[side, f][bins[j][f] if 0 <= j < len(lines) else crf.BINS]
        emission.append(e)
    ahead, behind = [[0.0, emission[0]]], [[0.0, 0.0]]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for e in emission[1:]:
        ahead.append([add(ahead[-1][0] + model.transition[0, y], ahead[-1][1] + model.transition[1, y]) + (e if y else 0.0) for y in (0, 1)])
    for e in emission[:0:-1]:
        behind.append([add(model.transition[y, 0] + behind[-1][0], model.transition[y, 1] + e + behind[-1][1]) for y in (0, 1)])
    total = weight = 0.0
    for line, a, b in zip(lines, ahead, behind[::-1]):
        n = len(line.encode()) + 1
        total += n / (1 + math.exp(a[0] + b[0] - a[1] - b[1]))
        weight += n
    return total / weight


def test_scores_equal_a_plain_scorer(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = crf.fit(docs, table(spark, sf, "labels"))
    texts = [r.text for r in docs.orderBy("doc_id").limit(150).collect()]
    texts += ["", "\n\n", "One two.\nOne  two.\nTHREE!! 3\n| a | b |", "é É ß\n" * 30, "x" * 5000 + "\nend."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in crf.score(df, model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - slow_score(model, t or "")) < 1e-6, (i, t)


def test_fit_is_bounded_and_ids_may_repeat(spark):
    docs, labels = toy(spark)
    model = crf.fit(docs, labels)
    repeated = docs.union(docs.filter("doc_id < 20")).union(docs.filter("doc_id = 2"))
    assert np.allclose(crf.fit(repeated, labels).weights, model.weights)  # one labelled row, however often it is there
    texts = docs.union(spark.createDataFrame([(3, f"Another text of the third id, number {i}.", "d", 0.0) for i in range(50)], docs.schema))
    some = crf.fit(texts, labels, sample=40, lines=60)
    assert np.allclose(some.weights, crf.fit(texts.repartition(7), labels, sample=40, lines=60).weights)
    assert crf.fit(docs, labels, lines=0).weights.any() == False  # noqa: E712
    got = crf.score(repeated, model, ["doc_id"]).filter("doc_id = 2").collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1


def test_cut_keeps_whole_documents_together():
    first, label = crf.cut(np.array([0, 3, 10, 11]), np.array([1, 0, 1]), 4)
    assert first.tolist() == [0, 3, 7, 10, 11] and label.tolist() == [1, 0, 0, 1]


def toy(spark):
    good = "The quick brown fox jumps over the lazy dog and goes home.\nThen it rests for a while."
    bad = "BUY!! NOW!! ### $$$ 111\nwin win win win win"
    rows = [(i, (good if i % 2 else bad) + f" {i}", "d", 0.5) for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None, "d", 0.1), (1001, "", "d", 0.2), (None, good, "d", 0.3), (1002, bad * 5000, "d", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (7, 3, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toy(spark):
    docs, labels = toy(spark)
    model = crf.fit(docs, labels)
    got = [(r.doc_id, r.score) for r in crf.score(docs, model, ["doc_id"]).collect()]
    assert len(got) == 304 and all(0 <= s <= 1 for _, s in got)
    assert all((s >= 0.3) == (i % 2 == 1) for i, s in got if i is not None and i < 300)
    assert dict(got)[1002] < 0.3 and dict(got)[None] > 0.3 and dict(got)[1000] == dict(got)[1001]
    again = crf.fit(docs.repartition(5), labels.repartition(3))
    assert np.allclose(again.weights, model.weights)
    assert crf.score(docs, model).columns == ["doc_id", "text", "lang", "score"]
    assert crf.score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs, labels = toy(spark)
    model = crf.fit(docs, labels.limit(0))
    assert {r.score for r in crf.score(docs, model).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op10_line_crf(spark, sf).toPandas()
    docs = table(spark, sf, "documents").count()
    assert len(got) == docs
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    both = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    test = both[both["held_out"]]
    assert ((test["score"] >= 0.3) == (test["predicted"] == 1)).all()
    accuracy = (test["predicted"] == test["quality"]).mean()
    assert accuracy > 0.93, accuracy
    clean = test[test["quality"] == 1]
    assert (clean["predicted"] == 1).mean() > 0.97
