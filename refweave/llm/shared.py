"""Tables that must outlive an executor, in the folder that the cluster names, and joins that no hot key holds up."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where nothing is set, a local session gets a folder of its own; a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="refweave-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/refweave/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has stashed. Frames that came from operators can't be read any more."""
    delete(spark, own_dir(spark))


_made: list[list[str]] = []  # of each open ``scratch``: where tables were written


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The rows are computed once, and later plans see the written table's true
    size. An empty frame comes back empty with the same schema.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _made:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A place for passing tables: what is stashed inside goes at the end, but for those that the list given is emptied of.

    Nothing that is still to be read may be left in it: ``kept = made.pop()``
    after the stash of a result keeps the result.
    """
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
    for path in made:
        delete(spark, path)
        for paths in _made:
            if path in paths:
                paths.remove(path)


def spare(frame: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as set them apart from the columns of ``frame``, whose case does not count."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(frame: DataFrame) -> DataFrame:
    """``frame``, about to be handed to Python with its texts: the session's Arrow batches become 8 MB, and stay so, where they have the default size.

    A batch lies outside the executor's heap, once in the JVM and once in Python.
    The engine reads the setting when the frame is run, so it can't be put back here.
    """
    conf = frame.sparkSession.conf
    if conf.get(BATCH) in ("67108864b", "64MB", "64m"):
        conf.set(BATCH, "8m")
    return frame


PER_ID, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 28  # a sieve has 8 bits an id and takes 32 MB at the most


def sieve(ids: DataFrame, column: str = "id") -> np.ndarray:
    """A bit per residue of the ids: rows it rejects are surely not among ``ids``, rows it lets through may not be.

    Eight bits an id let one row in eight pass by chance. Its size stops at
    32 MB, about 33 million ids, so that it may travel with a task; more ids
    let more rows pass, which costs a shuffle of those and no result.
    ``ids`` is read twice.
    """
    slots = min(max(ids.count() * PER_ID, LEAST_BITS), MOST_BITS) - 63 | 1
    slot = F.pmod(F.col(column), F.lit(slots))
    words = ids.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(slots // 64 + 2, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    out[-1] = slots
    return out


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = np.mod(ids, bits[-1])
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def maybe_among(bits: np.ndarray, key: Column) -> Column:
    """Whether a long key passes the sieve; false for nulls."""

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(bits, keys.fillna(0).to_numpy(np.int64)))

    return maybe(key) & key.isNotNull()


def without(rows: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """``rows`` whose ``keys`` are not a row of ``gone`` (as many columns, no nulls); only rows that a sieve lets through are shuffled.

    Null keys are among nothing. Names of ``rows`` may be any.
    """
    names = spare(rows, *(f"key{i}" for i in range(len(keys))), "maybe")
    gone = gone.toDF(*names[:-1])
    bits = sieve(gone.select(F.xxhash64(*names[:-1]).alias("id")))
    marked = rows.select("*", *[k.alias(n) for k, n in zip(keys, names)]).withColumn(names[-1], maybe_among(bits, F.xxhash64(*names[:-1])))
    rest = marked.filter(F.col(names[-1])).join(gone, names[:-1], "left_anti")
    return marked.filter(~F.col(names[-1])).select(*rows.columns).union(rest.select(*rows.columns))


def join_salted(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread: list[str], total: int, how: str = "inner", part: int = 256) -> DataFrame:
    """``rows`` joined with ``facts``, one row per key that knows in ``weight`` how many of ``rows`` have the key.

    ``total``: the number of ``rows``. A key with more than ``part`` rows and
    more than a 1024th of all is dealt over as many parts by its ``spread``
    columns, and its facts are repeated for each. There are fewer than 1024 such
    keys, and only they and their number of parts are broadcast.
    """
    limit = max(part, total // 1024)
    parts, own = spare(rows.join(facts.limit(0), keys), "parts", "part")
    hot = F.broadcast(facts.filter(F.col(weight) > limit).select(*keys, F.ceil(F.col(weight) / limit).cast("int").alias(parts)))
    dealt = rows.join(hot, keys, "left").withColumn(own, F.coalesce(F.pmod(F.xxhash64(*spread), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    last = F.when(F.col(weight) > limit, F.ceil(F.col(weight) / limit).cast("int") - 1).otherwise(0)
    return dealt.join(facts.withColumn(own, F.explode(F.sequence(F.lit(0), last))), [*keys, own], how).drop(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
