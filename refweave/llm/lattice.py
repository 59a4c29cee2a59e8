"""Embedding near-dedup by E8 lattice hashing.

Each table projects unit vectors at random to blocks of eight dimensions and
decodes every block to the nearest point of the E8 lattice. A vector enters the
cell of its own points and the few neighbouring cells that lie nearest to it.
Vectors that meet in a cell are candidates; ``linking`` verifies them by cosine
without listing the pairs of a crowded cell. Inside each component found that
way all cosines are then taken exactly, tile by tile, to count links. Equal
vectors are one class with a weight throughout.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.llm import linking
from refweave.llm.shared import join_salted, scratch, stash

COSINE = 0.9
SEED = 24061

# (blocks, tables, probes, scale): at cosine 0.9 a pair meets with probability 0.99. One plan at every
# size, so that links do not depend on the row count; three blocks keep cells small in large tables.
PLAN = (3, 12, 6, 0.45)


def _roots() -> np.ndarray:
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()  # the 240 shortest vectors of E8


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(nearer[:, None], b, a)


def projection(table: int, dim: int, blocks: int, scale: float) -> np.ndarray:
    g = np.random.default_rng([SEED, table, dim]).normal(size=(dim, 8 * blocks))
    base = np.linalg.qr(g)[0] if dim >= 8 * blocks else g / np.sqrt(dim)
    return base * (scale * np.sqrt(dim))


def cells(unit: np.ndarray, blocks: int, tables: int, probes: int, scale: float) -> np.ndarray:
    """Cell hashes (rows, tables * (1 + probes)): the own cell, then the neighbours by distance."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        y = unit @ projection(t, dim, blocks, scale)
        own, gain, moves = [], [], []
        for b in range(blocks):
            part = y[:, 8 * b : 8 * b + 8]
            point = decode_e8(part)
            closer = (part - point) @ ROOTS.T
            top = np.argpartition(-closer, probes, axis=1)[:, :probes]
            own.append(point)
            gain.append(np.take_along_axis(closer, top, 1))
            moves.append(top)
        point = np.rint(2 * np.concatenate(own, 1)).astype(np.int64)
        gain, moves = np.concatenate(gain, 1), np.concatenate(moves, 1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        salt = np.random.default_rng([SEED, t, dim, 1]).integers(1, 2**62, 8 * blocks, dtype=np.int64) | 1
        out[:, t, 0] = (point * salt).sum(axis=1).view(np.uint64)
        rows = np.arange(n)
        for p in range(probes):
            k = best[:, p]
            block, root = k // probes, moves[rows, k]
            step = np.rint(2 * ROOTS[root]).astype(np.int64)
            salts = salt.reshape(blocks, 8)[block]
            out[:, t, 1 + p] = out[:, t, 0] + (step * salts).sum(axis=1).view(np.uint64)
        out[:, t] ^= np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return out.reshape(n, -1)


def unit_vectors(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, payload) of every row: double unit vectors, null where a row can't link."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("id"), batch.column("v")
            rows = pc.if_else(ids.is_valid(), rows, pa.scalar(None, rows.type))
            sizes = pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(rows.flatten(), np.nan).to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            out, good = np.zeros(len(flat)), np.zeros(len(sizes), bool)
            for s in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == s)
                place = begin[at][:, None] + np.arange(s)
                x = flat[place]
                fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
                x, place = x[fine], place[fine]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                out[place] = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0  # no negative zeros
                good[at[fine]] = True
            offsets = np.concatenate(([0], np.cumsum(np.where(good, sizes, 0)))).astype(np.int32)
            units = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[np.repeat(good, sizes)]), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([ids, units], ["id", "payload"])

    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, payload array<double>")


def dots(left: np.ndarray, right: np.ndarray, near: float) -> np.ndarray:
    """Products of all pairs of rows; those about ``near`` are added up component by component, as SQL does it."""
    out = left @ right.T
    i, j = np.nonzero(np.abs(out - near) < 1e-9)
    if len(i):
        total = np.zeros(len(i))
        for k in range(left.shape[1]):
            total += left[i, k] * right[j, k]
        out[i, j] = total
    return out


def linked_table(left: list, right: list, cosine: float) -> np.ndarray:
    """Which pairs of two lists of unit vectors reach ``cosine``; vectors of different lengths do not."""
    out = np.zeros((len(left), len(right)), bool)
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for s in np.intersect1d(a, b):
        i, j = np.flatnonzero(a == s), np.flatnonzero(b == s)
        out[np.ix_(i, j)] = dots(np.stack([left[k] for k in i]), np.stack([right[k] for k in j]), cosine) >= cosine
    return out


def count_links(components: DataFrame, classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(id, k): the weight of all other classes that a class links with, by tiles of two blocks of a component at a time."""
    sizes = stash(components.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    rows = join_salted(components, sizes, ["component"], "n", ["id"], components.count()).withColumn("parts", linking.blocks_of(F.col("n"), block))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: F.struct(F.least(s, F.col("own")).alias("x"), F.greatest(s, F.col("own")).alias("y"), F.when(F.col("own") <= s, 0).otherwise(1).alias("side")))
    dealt = rows.withColumn("own", own).select("component", "id", F.explode(tiles).alias("t")).select("component", "id", "t.*").join(classes.select("id", "payload", "weight"), "id")

    def run(batches):
        for g in linking.groups(batches, ["component", "x", "y"]):
            a = g["side"] == 0
            left, weight = g["payload"][a].tolist(), g["weight"]
            if g["x"][0] == g["y"][0]:
                linked = linked_table(left, left, cosine)
                np.fill_diagonal(linked, False)
                yield pd.DataFrame({"id": g["id"][a], "k": linked @ weight[a]})
            elif a.any() and not a.all():
                linked = linked_table(left, g["payload"][~a].tolist(), cosine)
                yield pd.DataFrame({"id": np.concatenate((g["id"][a], g["id"][~a])), "k": np.concatenate((linked @ weight[~a], weight[a] @ linked))})

    counted = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInPandas(run, "id long, k long")
    return counted.groupBy("id").agg(F.sum("k").alias("k"))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding, ...).

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and so do rows with a null vec_id, whose component_id is
    null and which are kept. Vectors of different lengths never link. Rows that
    repeat a vec_id and its vector, but for its length, are one vector. Rows
    that repeat a vec_id with another vector are vectors of their own: each has
    its own links and component, and they link with each other if they are near
    enough. Other columns are ignored; an empty table gives an empty frame.
    """
    one, two = F.xxhash64("payload").alias("h1"), F.xxhash64(F.lit(1), "payload").alias("h2")
    vectors = stash(unit_vectors(embeddings).select("id", one, two, "payload"), "vectors")
    able = vectors.filter("payload is not null")
    weights = able.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    listed = able.groupBy("h1", "h2").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("rows"))
    # The number of a class is none of its vec_ids, which may repeat with other vectors. It is fixed once written.
    classes = stash(listed.join(weights, ["h1", "h2"]).withColumn("id", F.monotonically_increasing_id()), "classes")

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            lists = batch.column("payload")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                unit = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), s)
                hashed = np.sort(cells(unit, *PLAN), axis=1)
                once = np.concatenate((np.ones((len(at), 1), bool), hashed[:, 1:] != hashed[:, :-1]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)[once]), pa.array(np.repeat(ids[at], once.sum(axis=1)))], ["bucket", "id"])

    def members_of(frame):
        return stash(frame.select("id", "payload").mapInArrow(run, "bucket long, id long"), "members")

    def star_test(one, two):
        dot = F.aggregate(F.zip_with(one, two, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        return (F.size(one) == F.size(two)) & (dot >= cosine)

    with scratch(embeddings.sparkSession) as made:
        found = linking.link_buckets(members_of(classes), lambda ids: classes.select("id", "payload").join(ids, "id", "left_semi"), star_test, lambda a, b: linked_table(a, b, cosine), block)
        found = stash(found, "found")
        made.pop()
        links = stash(count_links(found, classes, cosine, block), "links")
        made.pop()
    least = classes.join(found, "id").groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_salted(found, least, ["component"], "n", ["id"], found.count()).select("id", "component_id")
    placed = classes.select("h1", "h2", "first", "weight", "rows", "id").join(named, "id", "left").join(links, "id", "left")
    placed = placed.select("h1", "h2", "rows", (F.coalesce("k", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = join_salted(able.select("id", "h1", "h2"), placed, ["h1", "h2"], "rows", ["id"], able.count()).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = vectors.filter("payload is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
