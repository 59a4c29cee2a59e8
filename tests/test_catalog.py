"""Every registered query against its SQL, and the driver's contract."""

import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from refweave import catalog
from refweave.operators import resolve
from refweave.operators.resolve import similar_keys

SF = "/root/testdata/sf0.01"


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    assert rows
    if name not in catalog.oracle_sql():
        return
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    assert rows == sorted(repr(plain(r)) for r in cursor.fetchall())
    assert sorted(d[0] for d in duck.execute(f"SELECT * FROM ({catalog.oracle_sql()[name]}) LIMIT 0").description) == columns


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "critical" in df.columns


def test_names_agree():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_title_search_against_all_pairs(spark):
    """Every pair of titles that share enough words is found, and the best of all pairs wins."""
    words = [f"w{i}" for i in range(14)]
    rng = random.Random(4)
    keys = lambda n: sorted({" ".join(rng.sample(words, rng.randrange(1, 8))) for _ in range(n)})
    asked, there = keys(120), keys(150)
    share = lambda a, b: 2 * len(set(a.split()) & set(b.split())) / (len(set(a.split())) + len(set(b.split())))
    for least in (0.3, 0.4, 0.65, 1.0):
        got = similar_keys(spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(b,) for b in there], "t string"), least)
        assert {(r.q, r.t) for r in got.collect()} == {(a, b) for a in asked for b in there if share(a, b) >= least}


def test_title_search_of_frequent_words_and_long_titles(spark):
    """However the search lets keys meet, it finds the pairs of brute force."""
    words = [f"w{i}" for i in range(14)]
    rng = random.Random(9)
    keys = lambda n: sorted({" ".join(rng.sample(words, rng.randrange(1, 8))) for _ in range(n)})
    asked, there = keys(90), keys(110)
    share = lambda a, b: 2 * len(set(a.split()) & set(b.split())) / (len(set(a.split())) + len(set(b.split())))
    left, right = spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(b,) for b in there], "t string")
    for least, few, long in ((0.4, 0, 48), (0.4, 30, 3), (0.65, 0, 5), (0.3, 25, 2), (1.0, 0, 48)):
        got = [(r.q, r.t) for r in similar_keys(left, right, least, few, long).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in asked for b in there if share(a, b) >= least}


def test_title_search_compares_few_of_those_that_share_a_frequent_word(spark, monkeypatch):
    """Titles of four words that each are in hundreds of others: only those that share two words are compared."""
    seen, dice = spark.sparkContext.accumulator(0), resolve.dice

    @F.pandas_udf("double")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    monkeypatch.setattr(resolve, "dice", lambda a, b: counted(dice(a, b)))
    titles = [f"a{k % 13} b{k % 11} c{k % 7} d{k % 17}" for k in range(3000)]
    asked, there = spark.createDataFrame([(t,) for t in titles[::3]], "q string"), spark.createDataFrame([(t,) for t in titles], "t string")
    found = similar_keys(asked, there).count()
    words = [set(t.split()) for t in titles]
    assert found == sum(len(a & b) >= 2 for a in words[::3] for b in words)
    # A filter may be evaluated ahead of the column that it reads, so each pair can count twice.
    assert seen.value <= 2 * found < sum(len(a & b) >= 1 for a in words[::3] for b in words)
