"""Links inside candidate buckets, and the components that links form.

Candidate generators (bands of a signature, cells of a lattice) name a bucket
for each row. A bucket can hold a third of all rows, so no bucket is ever
gathered whole and no list of its pairs is made:

1. star: every member is tested against the smallest id of its bucket;
2. components of the links so far, by alternating large and small stars;
3. only buckets whose members lie in several components go on. The caller may
   deal the crowded ones of these to finer buckets that lose no link, and the
   first two steps are run on them again;
4. of what is left, the largest component of a bucket is cut into blocks and
   the rest into blocks; tiles of two blocks, of which one at least is of the
   rest, are tested by matrix arithmetic. A tile returns at most as many edges
   as it has rows.

Every pair that shares a bucket is thus tested, or is known to lie in one
component already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.llm.shared import join_salted, scratch, stash


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that links reach.

    Large-star and small-star rounds on the edge list until it no longer
    changes; each round is written to the shared folder. A centre of very many
    edges is dealt over many tasks. An empty edge list gives an empty frame.
    """
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    with scratch(spark) as made:
        current = stash(
            edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
        )
        seen = mark(current)
        while seen[0]:
            both = current.union(current.select("b", "a"))
            least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
            large = join_salted(both, least, ["a"], "degree", ["b"], 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # A node has few smaller neighbours here, one for each star that it was in.
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a")
            small = (
                small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(small.select("a", F.col("m").alias("b")))
                .distinct()
            )
            current = stash(small, "edges")
            now = mark(current)
            if now == seen:
                break
            seen = now
        made.pop()
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys from the sorted rows of a partition, by column; at most one group is held over."""
    rest: list[dict[str, np.ndarray]] = []

    def whole():
        return rest[0] if len(rest) == 1 else {c: np.concatenate([r[c] for r in rest]) for c in rest[0]}

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        if rest and any(rest[-1][k][-1] != columns[k][0] for k in keys):
            yield whole()
            rest = []
        change = np.zeros(n - 1, bool)
        for k in keys:
            change |= columns[k][1:] != columns[k][:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for lo, hi in zip(bounds, bounds[1:]):
            rest.append({c: v[lo:hi] for c, v in columns.items()})
            if hi < n:
                yield whole()
                rest = []
    if rest:
        yield whole()


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A few edges with the components of a bipartite table of links between ids."""
    edges, todo = [], np.ones(len(left), bool)
    todo &= linked.any(axis=1)
    while todo.any():
        first = int(np.flatnonzero(todo)[0])
        rows = np.zeros(len(left), bool)
        rows[first] = True
        cols = np.zeros(len(right), bool)
        while True:
            reach = linked[rows].any(axis=0)
            back = linked[:, reach].any(axis=1) | rows
            if (reach == cols).all() and (back == rows).all():
                break
            cols, rows = reach, back
        todo &= ~rows
        edges += [(int(left[first]), int(x)) for x in right[cols]]
        edges += [(int(left[first]), int(x)) for x in left[rows] if x != left[first]]
    return edges


def blocks_of(n: Column, block: int) -> Column:
    return F.ceil(n / F.lit(float(block))).cast("int")


STAR = 512  # members of a bucket that meet one copy of its lead
CROWD = 16  # blocks beside the largest component from which on a bucket is dealt to finer ones: tiles copy each payload once per block


def _live(members: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, id, lead, n) of the buckets that hold two members or more, and the number of these rows."""
    heads = stash(members.groupBy("bucket").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "heads")
    total = heads.agg(F.sum("n")).first()[0] or 0
    return stash(join_salted(members, heads, ["bucket"], "n", ["id"], total).select("bucket", "id", "lead", "n"), "live"), total


def _star(live: DataFrame, total: int, payload: DataFrame, star_test: Callable, known: DataFrame | None, block: int) -> tuple[DataFrame, DataFrame]:
    """Components after every member met its bucket's lead, and the rows of buckets that lie in several of them.

    These have (bucket, id, c, main, bm, br): own component, the bucket's
    largest, and the number of blocks of that and of the rest. ``known``
    (id, component): links found before; their pairs are not tested again.
    """
    pairs = live.filter("id <> lead").groupBy("id", "lead").agg(F.max("n").alias("n"))
    if known is not None:
        lead = known.select(F.col("id").alias("lead"), F.col("component").alias("cl"))
        pairs = pairs.join(known, "id", "left").join(lead, "lead", "left").filter(F.coalesce("component", "id") != F.coalesce("cl", "lead")).select("id", "lead", "n")
    # The payload of a lead is copied for every STAR members, so that no task meets all of a hot bucket.
    copies = F.ceil(F.col("n") / float(STAR)).cast("int")
    star = pairs.withColumn("part", F.pmod(F.xxhash64("id"), copies).cast("int"))
    leads = live.groupBy("lead").agg(F.max("n").alias("n")).join(payload.select(F.col("id").alias("lead"), F.col("payload").alias("two")), "lead")
    leads = leads.select("lead", "two", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    tested = (
        star.join(payload.withColumnRenamed("payload", "one"), "id")
        .join(leads, ["lead", "part"])
        .filter(star_test(F.col("one"), F.col("two")))
        .select(F.col("lead").alias("a"), F.col("id").alias("b"))
    )
    if known is not None:
        tested = tested.union(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    first = stash(connected_components(tested), "components")

    placed = stash(live.filter("n > 2").join(first, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")), "placed")
    parts = placed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"))
    split = (
        parts.groupBy("bucket")
        .agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("bucket", "n", F.col("top.c").alias("main"), blocks_of(F.col("top.k"), block).alias("bm"), blocks_of(F.col("n") - F.col("top.k"), block).alias("br"))
    )
    split = stash(split, "split")
    rows = join_salted(placed, split, ["bucket"], "n", ["id"], total).select("bucket", "id", "c", "main", "bm", "br")
    return first, stash(rows, "open")


def _merged(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` in which open buckets of one largest component are a single bucket, where that makes fewer copies.

    A large group of near copies fills a bucket of every band with much the same
    rows, and each of its pairs would be tested once for each. The whole bucket
    holds all rows of those it replaces, so no pair is lost.
    """
    inside = F.col("c") == F.col("main")
    each = rows.groupBy("main", "id", "c").agg(F.sum(F.when(inside, F.col("br")).otherwise(F.col("br") + F.col("bm"))).alias("apart"), F.count(F.lit(1)).alias("n"))
    whole = each.groupBy("main").agg(F.sum("apart").alias("apart"), F.sum("n").alias("n"), F.count_if(inside).alias("ki"), F.count_if(~inside).alias("kr"))
    whole = whole.select("main", "apart", "n", "ki", "kr", blocks_of(F.col("ki"), block).alias("wm"), blocks_of(F.col("kr"), block).alias("wr"))
    whole = stash(whole.filter((F.col("wr") <= CROWD) & (F.col("ki") * F.col("wr") + F.col("kr") * (F.col("wr") + F.col("wm")) < F.col("apart"))).select("main", "n", "wm", "wr"), "whole")
    if whole.isEmpty():
        return rows
    marked = join_salted(rows, whole, ["main"], "n", ["id"], rows.count(), "left")
    one = marked.filter("wm is not null").select(F.xxhash64(F.lit("whole"), "main").alias("bucket"), "id", "c", "main", F.col("wm").alias("bm"), F.col("wr").alias("br")).distinct()
    return stash(marked.filter("wm is null").select("bucket", "id", "c", "main", "bm", "br").union(one), "merged")


def _dealt(rows: DataFrame) -> DataFrame:
    """(bucket, id, c, x, y, side): the rows of buckets in several components, once for each tile of two blocks that they belong to."""
    inside = F.col("c") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(inside, F.col("bm")).otherwise(F.col("br"))).cast("int")
    rows = rows.withColumn("inside", inside).withColumn("own", own)
    rest = F.sequence(F.lit(0), F.col("br") - 1)
    tiles = F.when(
        F.col("inside"), F.transform(rest, lambda s: F.struct(s.alias("x"), (-F.col("own") - 1).alias("y"), F.lit(1).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(rest, lambda s: F.struct(F.least(s, F.col("own")).alias("x"), F.greatest(s, F.col("own")).alias("y"), F.when(F.col("own") <= s, 0).otherwise(1).alias("side"))),
            F.transform(F.sequence(F.lit(0), F.col("bm") - 1), lambda m: F.struct(F.col("own").alias("x"), (-m - 1).alias("y"), F.lit(0).alias("side"))),
        )
    )
    return rows.select("bucket", "id", "c", F.explode(tiles).alias("t")).select("bucket", "id", "c", "t.*")


def link_buckets(
    members: DataFrame,
    items: Callable[[DataFrame], DataFrame],
    star_test: Callable[[Column, Column], Column],
    tile_test: Callable[[list, list], np.ndarray],
    block: int = 256,
    refine: Callable[[DataFrame], DataFrame] | None = None,
    merge: bool = False,
) -> DataFrame:
    """Components (id, component) of the linked ids; ids without links are absent.

    ``members`` (bucket long, id long) holds a row at most once. ``items`` gives
    (id, payload) for the ids of a frame. ``star_test`` judges a pair in SQL and
    ``tile_test`` two lists of payloads at once, with the same outcome.
    ``refine`` deals the rows (bucket, id, payload) of buckets with more than
    ``CROWD`` blocks outside their largest component to finer ones (bucket, id)
    in which every pair that links still meets, so links do not depend on it.
    Where ``merge``, open buckets of one component are tested as one if that
    copies less; a pair that only shares the component may then be linked too.
    """
    live, total = _live(members)
    payload = stash(items(stash(live.select("id").distinct(), "ids")), "items")
    found, rows = _star(live, total, payload, star_test, None, block)
    if refine is not None:
        crowded = rows.filter(F.col("br") > CROWD).select("bucket", "id")
        if not crowded.isEmpty():
            finer, many = _live(refine(crowded.join(payload, "id").select("bucket", "id", "payload")))
            found, more = _star(finer, many, payload, star_test, found, block)
            rows = rows.filter(F.col("br") <= CROWD).union(more)

    def verify(batches):
        edges: list[tuple[int, int]] = []
        for g in groups(batches, ["bucket", "x", "y"]):
            a = g["side"] == 0
            b = a if g["x"][0] == g["y"][0] else ~a
            differ = g["c"][a][:, None] != g["c"][b][None, :]
            if not differ.any():
                continue
            linked = tile_test(g["payload"][a].tolist(), g["payload"][b].tolist()) & differ
            if linked.any():
                edges += forest(linked, g["id"][a], g["id"][b])
            if len(edges) > 10_000:
                yield pd.DataFrame(edges, columns=["a", "b"])
                edges = []
        if edges:
            yield pd.DataFrame(edges, columns=["a", "b"])

    dealt = _dealt(_merged(rows, block) if merge else rows).join(payload, "id")
    more = stash(
        dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInPandas(verify, "a long, b long"),
        "more",
    )
    if more.isEmpty():
        return found
    return connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
