"""Mixing sources to target weights by pivotal dependent rounding.

A document is wanted target / size-of-its-source times. The whole part is taken
outright; the fraction is rounded by pivotal steps: two documents with open
fractions exchange words at random until one of them is taken or left, and the
other goes on with what remains. Steps run within hashed buckets of a source;
one open document a bucket moves up, and the buckets meet in a tree, so no task
sees more than a bucket. A source is left with one open document at most, which
goes to its nearer side. The words that this is too many or too few are made
good by documents of the source that change sides: a few of every magnitude are
candidates. Rows that repeat doc_id, text
and source are rounded as one document of several copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from refweave.llm.shared import maybe_among, sieve, spare, stash

CAP = 3
WEIGHTS = (1, 2, 3)
BUCKET = 1_000  # rows that a bucket of the lowest level has on average
FAN = 16  # buckets that meet in one of the next level
SEED = 20240517
CHOICE = 16  # documents of each magnitude, and of each side, that may make good a residual


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code point order, null last: ranges are sorted apart and their sizes added up."""
    spark = sources.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stash(
        sources.withColumn("_null", F.col("source").isNull().cast("int")).repartitionByRange(n, "_null", "source").withColumn("_part", F.spark_partition_id()), "sources"
    )
    sizes = placed.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source")) - 1
    return placed.withColumn("_local", local).join(F.broadcast(before), "_part").select("source", "source_size", (F.col("_local") + F.col("_before")).alias("rank"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): shares by weight of all words, each at most ``cap`` times its source's size.

    What capped sources leave is shared again among the others by weight until
    no source is above its cap; each round is one aggregate over the sources.
    """
    names = ranked(sizes).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    names = stash(names.withColumn("cap", F.col("source_size") * float(cap)), "weights")
    total = names.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level >= F.col("cap")
        row = names.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)), F.count_if(above)
        ).first()
        if row[2] == capped or not row[1]:
            break
        capped, level = row[2], (total - row[0]) / row[1]
    return names.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _draw(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that only depends on its arguments."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * m) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 33)) / 2.0**64


def pivot(p: np.ndarray, words: np.ndarray, marks: np.ndarray, seed: int) -> int:
    """Round the fractions ``p`` in place, keeping sum(p * words); returns the place of the open one, or -1."""
    eps = 1e-9
    held = -1
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * words[a], p[b] * words[b])  # words that may go from b to a
        down = min(p[a] * words[a], (1 - p[b]) * words[b])
        move = up if _draw(seed, int(marks[a]), int(marks[b])) * (up + down) < down else -down
        p[a] += move / words[a]
        p[b] -= move / words[b]
        held = -1
        for k in (a, b):
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = round(p[k])
            else:
                held = k
    return held


def _round_level(seed: int):
    def run(batches):
        """Rows come sorted by source and bucket; one open row is carried from batch to batch."""
        held: pd.DataFrame | None = None

        def closed(frame: pd.DataFrame, is_open: bool) -> pd.DataFrame:
            return frame.assign(open=is_open)

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            p, words, marks = rows["p"].to_numpy(float).copy(), rows["size"].to_numpy(float), rows["mark"].to_numpy()
            src, buckets = rows["skey"].to_numpy(), rows["bucket"].to_numpy()
            cuts = np.flatnonzero((src[1:] != src[:-1]) | (buckets[1:] != buckets[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(rows)]
            state = np.zeros(len(rows), bool)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                k = pivot(part := p[lo:hi], words[lo:hi], marks[lo:hi], seed)
                p[lo:hi] = part
                if k >= 0:
                    state[lo + k] = True
            rows = rows.assign(p=p, open=state)
            last = rows[(np.arange(len(rows)) >= bounds[-2]) & state]
            held = last if len(last) else None
            yield rows.drop(index=last.index)
        if held is not None:
            yield held

    return run


def mark_of(seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.col("source"))


def take(documents: DataFrame, mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``documents``, each as often as ``mixed``, the outcome of ``mix`` with this seed, has copies of it.

    Rows that repeat doc_id, text and source share their copies in the order of
    their other columns. Any other columns pass through, whatever their names;
    an empty table gives an empty frame.
    """
    names = documents.columns
    mark, copies, rows, n, before = spare(documents, "mark", "copies", "rows", "n", "before")
    shares = mixed.groupBy(F.col("mark").alias(mark)).agg(F.sum("copies").cast("long").alias(copies), F.count(F.lit(1)).alias(rows)).filter(F.col(copies) > 0)
    shares = stash(shares, "copies")
    marked = documents.withColumn(mark, mark_of(seed))
    plain = marked.join(shares.filter(F.col(rows) == 1).hint("shuffle_hash"), mark).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*names)
    many = shares.filter(F.col(rows) > 1)
    if many.isEmpty():
        return plain
    # Equal rows become one with their number, so no task meets all copies of one.
    bits = sieve(many.select(F.col(mark).alias("id")))
    equal = marked.filter(maybe_among(bits, F.col(mark))).groupBy(mark, *names).agg(F.count(F.lit(1)).alias(n)).join(many, mark)
    order = Window.partitionBy(mark).orderBy(*names)
    equal = equal.withColumn(before, F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.coalesce(F.col(before), F.lit(0))
    extra = F.least(F.greatest(F.col(copies) % F.col(rows) - first, F.lit(0)), F.col(n))
    whole = F.floor(F.col(copies) / F.col(rows)) * F.col(n) + extra
    return plain.union(equal.withColumn(n, whole.cast("long")).filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*names))


def amends(short: int, up: list[tuple[int, int]], down: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(mark, 1 or -1) of documents that change sides, so that ``short`` missing words (negative: too many) come near 0.

    ``up`` and ``down`` are (size, mark) of documents that may be taken once
    more or once less. The largest that fit go first; then pairs of one up and
    one down, the best first, as long as they bring the rest nearer to 0.
    """
    step, pool = (1, up) if short > 0 else (-1, down)
    left, out = abs(short), []
    for size, mark in sorted(pool, reverse=True):
        if size <= left:
            left -= size
            out.append((mark, step))
    left, used = left * step, {m for m, _ in out}
    a, b = (sorted(x for x in pool if x[1] not in used) for pool in (up, down))
    while left and a and b:
        rest = np.abs(left - np.array([x[0] for x in a])[:, None] + np.array([x[0] for x in b])[None, :])
        i, j = np.unravel_index(int(rest.argmin()), rest.shape)
        if rest[i, j] >= abs(left):
            break
        left += b[j][0] - a[i][0]
        out += [(a.pop(i)[1], 1), (b.pop(j)[1], -1)]
    return out


def _made_good(rows: DataFrame, seed: int) -> DataFrame:
    """(skey, mark, step): changes of sides by which each source's words come nearest to its target.

    ``rows`` has skey, mark, unit, taken, target and open ends: ``up`` where a row may be taken once more, ``down`` once less.
    """
    due = rows.groupBy("skey").agg(F.round(F.first("target") - F.sum("taken")).cast("long").alias("short")).filter("short <> 0")
    kind = F.when(F.col("up"), 1).when(F.col("down"), -1)
    cell = F.pmod(F.xxhash64("mark"), F.lit(CHOICE))
    # One row of each cell: a few of every magnitude, found by map-side minima.
    some = (
        rows.withColumn("kind", kind).filter("kind is not null and unit > 0")
        .groupBy("skey", "kind", F.floor(F.log2("unit")).alias("magnitude"), cell.alias("cell"))
        .agg(F.min(F.struct(F.xxhash64(F.lit(seed), "mark").alias("draw"), "mark", "unit")).alias("one"))
    )
    asked = some.join(due, "skey").groupBy("skey", "short").agg(F.sort_array(F.collect_list(F.struct("kind", "one.unit", "one.mark"))).alias("pool"))

    def run(batches):
        for batch in batches:
            out = []
            for skey, short, pool in zip(batch["skey"], batch["short"], batch["pool"]):
                sides = {k: [(p["unit"], p["mark"]) for p in pool if p["kind"] == k] for k in (1, -1)}
                out += [(skey, mark, step) for mark, step in amends(short, sides[1], sides[-1])]
            yield pd.DataFrame(out, columns=["skey", "mark", "step"])

    return asked.mapInPandas(run, "skey long, mark long, step int")


def mix(documents: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (doc_id by default) with mark, size, source_size, target, copies and taken, a row per document.

    ``taken`` is copies times size, the very words that ``take`` gives. Null
    texts and texts without words have size 0 and are taken 0 times; a null
    source is a source of its own; null and repeated doc_ids are rounded like
    others, with hashes of all of a row's values to tell them apart. Rows that
    are equal in doc_id, text, source and ``carry`` differ by one copy at most.
    Draws depend on the seed and the rows, not on how the rows are dealt out.
    Other columns are ignored; an empty table gives an empty frame.
    """
    carry = carry or ["doc_id"]
    base = documents.select(*carry, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), mark_of(seed).alias("mark"))
    base = stash(base.groupBy(*carry, "source", "size", "mark").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    shares = stash(targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, cap), "targets")
    n = base.count()
    levels = max(0, math.ceil(math.log(max(1.0, n / BUCKET), FAN)))
    joined = base.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    ratio = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size") * F.col("rows")).otherwise(0.0)
    joined = joined.withColumn("p", ratio).withColumn("whole", F.floor(F.col("p") + 1e-12).cast("long")).withColumn("p", F.greatest(F.col("p") - F.col("whole"), F.lit(0.0)))
    joined = joined.withColumn("broken", (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9))
    joined = joined.withColumn("skey", F.xxhash64(F.lit("s"), "source")).withColumn("bucket", F.pmod("mark", F.lit(FAN**levels)).cast("long")).withColumn("open", F.lit(False))
    open_now = joined
    schema = StructType([*open_now.schema.fields])
    settled = []
    for level in range(levels + 1):
        order = ["skey", "bucket", "mark", *carry]
        rows = open_now.repartition("skey", "bucket").sortWithinPartitions(*order).mapInPandas(_round_level(seed + level), schema)
        rows = stash(rows, "rounded")
        settled.append(rows.filter("not open"))
        open_now = rows.filter("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    out = open_now
    for more in settled:
        out = out.union(more)
    # Settled fractions are 0 or 1; the last open one of a source goes to its nearer side.
    out = out.withColumn("extra", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    out = stash(out.withColumn("total", F.col("whole") + F.col("extra")), "settled")
    able = F.col("broken")
    ends = out.select("skey", "mark", "target", F.col("size").alias("unit"), (F.col("total") * F.col("size")).alias("taken"), (able & (F.col("extra") == 0)).alias("up"), (able & (F.col("extra") == 1)).alias("down"))
    steps = stash(_made_good(ends, seed), "steps")
    out = out.join(steps, ["skey", "mark"], "left").withColumn("total", F.col("total") + F.coalesce("step", F.lit(0)))
    each = out.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    copies = (F.floor(F.col("total") / F.col("rows")) + (F.col("k") < F.col("total") % F.col("rows")).cast("int")).cast("int")
    return each.select(*carry, "mark", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
