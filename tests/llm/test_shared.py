import pytest

from refweave.llm import shared


def test_stash_and_sweep(spark):
    df = shared.stash(spark.createDataFrame([(1, None), (2, "x")], "a long, b string"), "t")
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, "x")]
    assert shared.stash(df.limit(0), "empty").count() == 0
    path = df.inputFiles()[0]
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert system.exists(place)
    shared.sweep(spark)
    assert not system.exists(place)


def exists(spark, path):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def test_scratch_leaves_what_is_kept(spark):
    with shared.scratch(spark) as outer:
        with shared.scratch(spark) as made:
            gone = shared.stash(spark.range(3), "gone").inputFiles()[0]
            kept = shared.stash(spark.range(4), "kept")
            made.pop()
        assert not exists(spark, gone) and kept.count() == 4 and len(outer) == 1
        path = kept.inputFiles()[0]
    assert not exists(spark, path)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isEmpty": staticmethod(lambda: True)}))}))

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_sieve_and_without(spark):
    ids = spark.range(0, 5000, 7).union(spark.createDataFrame([(-3,), (2**62 + 1,)], "id long"))
    bits = shared.sieve(ids)
    rows = spark.range(-10, 5000).union(spark.createDataFrame([(2**62 + 1,), (int(bits[-1]) + 7,), (None,)], "id long"))
    got = {r.id: r.m for r in rows.select("id", shared.maybe_among(bits, rows["id"]).alias("m")).collect()}
    assert got[7] and got[-3] and got[2**62 + 1] and got[int(bits[-1]) + 7] and not got[8] and got[None] is False
    left = {r.id for r in shared.without(rows, ids, rows["id"]).collect()}
    assert left == {r.id for r in rows.collect()} - {r.id for r in ids.collect()}
    assert shared.without(rows, ids.limit(0), rows["id"]).count() == rows.count()


def test_without_leaves_names_alone(spark):
    rows = spark.createDataFrame([(1, "a", 5, True), (2, "b", 6, None), (1, "b", 7, False)], "key0 long, KEY1 string, _key0 int, maybe boolean")
    gone = spark.createDataFrame([(1, "a"), (2, "z")], "x long, y string")
    out = shared.without(rows, gone, rows["key0"], rows["KEY1"])
    assert out.columns == rows.columns and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(2, "b", 6, None), (1, "b", 7, False)]))


def test_join_salted(spark):
    rows = spark.createDataFrame([(1, i) for i in range(400)] + [(2, i) for i in range(3)] + [(9, 0)], "k long, i long")
    facts = spark.createDataFrame([(1, 400, "hot"), (2, 3, "cold"), (3, 0, "none")], "k long, n long, fact string")
    got = shared.join_salted(rows, facts, ["k"], "n", ["i"], 404, part=10)
    assert got.count() == 403 and {(r.k, r.fact) for r in got.collect()} == {(1, "hot"), (2, "cold")}
    assert shared.join_salted(rows, facts, ["k"], "n", ["i"], 404, how="left", part=10).filter("fact is null").count() == 1
