import itertools

import numpy as np

from refweave.llm import lattice, registry
from refweave.llm.shared import table


def brute(rows, cosine=0.9):
    ok = {}
    for k, v in rows:
        if k is None or v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        ok[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links, root = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(ok), 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (links[k], find(k), find(k) == k) for k, _ in rows}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    return {r[0]: tuple(r[1:]) for r in lattice.near_duplicates(df, **kw).collect()}


def near(rng, base, cosine):
    z = rng.normal(size=base.shape)
    z -= z @ base * base / (base @ base)
    return cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def floats(x):
    return [float(c) for c in np.asarray(x, np.float32)]


def test_decoding_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)) * 2
    got = lattice.decode_e8(x)
    twice = np.rint(2 * got).astype(int)
    assert (twice == 2 * got).all() and ((twice % 2).min(1) == (twice % 2).max(1)).all() and (got.sum(1) % 2 == 0).all()
    d = ((x - got) ** 2).sum(1)
    around = ((x[:, None] - got[:, None] - lattice.ROOTS[None]) ** 2).sum(2).min(1)
    assert (d <= around + 1e-9).all() and d.max() <= 1 + 1e-9  # the covering radius is 1
    assert len(lattice.ROOTS) == 240


def test_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    hot = rng.normal(size=64)
    for i in range(150):
        rows.append((i * 7, floats(near(rng, hot, 0.985))))
    for i in range(40):
        base = rng.normal(size=64)
        rows += [(2000 + 3 * i, floats(base)), (2001 + 3 * i, floats(near(rng, base, 0.97) * 50)), (2002 + 3 * i, floats(near(rng, base, 0.8)))]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] + [1.0] * 63), (9005, [float("inf")] + [1.0] * 63), (9006, [1.0, 0.0]), (9007, [1.0, 0.1]), (9008, [3.0e38] * 64), (9009, [1.0] * 64), (9010, [1.0] * 9), (9011, [2.0] * 9)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=16) == want


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(repr, map(tuple, lattice.near_duplicates(df).collect()))) == sorted(map(repr, [(None, 0, None, True), (5, 1, 3, False), (5, 1, 3, False), (3, 1, 3, True)]))
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        base = rng.normal(size=64)
        rows += [(2 * i, floats(base)), (2 * i + 1, floats(near(rng, base, 0.9005)))]
    got = run(spark, rows)
    assert sum(v[0] for v in got.values()) >= 0.98 * len(rows)


def test_repeated_ids_with_other_vectors(spark):
    rng = np.random.default_rng(21)
    a, b, c = (rng.normal(size=64) for _ in range(3))
    rows = [(5, floats(a)), (5, floats(near(rng, a, 0.95))), (5, floats(b)), (7, floats(near(rng, a, 0.97))), (9, floats(c)), (9, floats(c * 2)), (2, floats(near(rng, b, 0.96))), (9, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = [np.array(v) / np.linalg.norm(v) if v else None for _, v in rows]
    near_ = [[i != j and x is not None and y is not None and x @ y >= 0.9 for j, y in enumerate(unit)] for i, x in enumerate(unit)]
    near_[4][5] = near_[5][4] = False  # one vector: id and direction repeat
    want = []
    for i, (k, v) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            x = todo.pop()
            todo += [j for j, y in enumerate(near_[x]) if y and j not in reach]
            reach |= {j for j, y in enumerate(near_[x]) if y}
        least = min(rows[j][0] for j in reach)
        want.append((k, sum(near_[i]), least, least == k))
    assert sorted(map(tuple, lattice.near_duplicates(df).collect())) == sorted(want)


def test_copies_are_classes_and_ties_agree(spark):
    rng = np.random.default_rng(2)
    # Cosine 0.9 but for rounding: SQL and tiles must say the same, also across blocks.
    x = np.zeros(64)
    x[0] = 1.0
    rows = [(i, floats(x)) for i in range(300)]  # one hot vector
    for i in range(60):
        y = np.zeros(64)
        y[0], y[1 + i] = 0.9, np.sqrt(1 - 0.81)
        rows.append((1000 + i, floats(y)))
    rows += [(3000 + i, floats(near(rng, x, 0.93))) for i in range(20)]
    whole, tiles = run(spark, rows), run(spark, rows, block=8)
    assert whole == tiles
    links = {k: v[0] for k, v in whole.items()}
    assert all(links[k] == links[0] for k in range(300)) and links[0] >= 299
    assert sum(links.values()) % 2 == 0
    assert all((v[0] > 0) == (v[1] != k or any(w[1] == k and j != k for j, w in whole.items())) for k, v in whole.items())


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got = {r[0]: tuple(r[1:]) for r in registry.op6_e8_lattice(spark, "/root/testdata/sf0.1").collect()}
    assert got == brute(rows)
