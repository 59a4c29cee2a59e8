"""MinHash near-dedup with min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so 60 permutations fill 24 bands of 5 values: 12 bands of
minima and 12 of maxima. At Jaccard 0.85 a pair shares a band with probability
1 - 1e-6, at 0.80 with 1 - 7e-5. Documents with equal sets form one class; classes that share a band
are linked (see ``linking``) if their full sets meet the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.llm import linking, wordset
from refweave.llm.shared import join_salted, lean, maybe_among, passes, scratch, sieve, spare, stash, without

PERMUTATIONS, BAND = 60, 5
_RNG = np.random.default_rng(8128)
_MUL = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)
_FOLD = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)

SIGNED = "doc_id long, mark long, n_shingles long, hi long, lo long, bands array<long>"


def _sets(batches, column, width):
    for batch in batches:
        for part in wordset.runs(batch, column):
            words, first = wordset.word_hashes(*wordset.texts(part.column(column)))
            yield part, *wordset.shingles(words, first, width)


def _fingerprint(values, starts):
    sums = [np.add.reduceat(wordset.mix(values + salt), starts) for salt in _FOLD[:2]]
    return [s.view(np.int64) for s in sums]


def _bands(values, starts):
    low = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    high = np.empty_like(low)
    for k in range(PERMUTATIONS):
        turned = values * _MUL[k] + _ADD[k]
        low[k], high[k] = np.minimum.reduceat(turned, starts), np.maximum.reduceat(turned, starts)
    signature = np.concatenate((low, high))
    out = np.empty((len(starts), len(signature) // BAND), np.uint64)
    for b in range(out.shape[1]):
        acc = np.full(len(starts), _FOLD[3]) + np.uint64(b)
        for k in range(BAND):
            acc = wordset.mix(acc ^ signature[b * BAND + k]) * _FOLD[4 + k]
        out[:, b] = acc
    return out.view(np.int64)


def mark_of(text: Column) -> Column:
    """With the doc_id, what tells rows apart."""
    return F.xxhash64(text.cast("string"))


def sign(documents: DataFrame, width: int = 5) -> DataFrame:
    """A row per document: ``mark_of`` its text, size and 128-bit fingerprint of its shingle set, and its bands (none if empty)."""

    def run(batches):
        for part, values, begin in _sets(batches, "text", width):
            n, full = np.diff(begin), np.diff(begin) > 0
            hi, lo = np.zeros((2, len(n)), np.int64)
            per = len(_MUL) * 2 // BAND
            flat = np.zeros(0, np.int64)
            if full.any():
                starts = begin[:-1][full]
                hi[full], lo[full] = _fingerprint(values, starts)
                flat = _bands(values, starts).ravel()
            offsets = np.concatenate(([0], np.cumsum(np.where(full, per, 0)))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns = [part.column("doc_id"), part.column("mark"), pa.array(n.astype(np.int64)), pa.array(hi), pa.array(lo), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "hi", "lo", "bands"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    return lean(rows).mapInArrow(run, SIGNED)


def shingle_sets(documents: DataFrame, bits: np.ndarray, width: int = 5) -> DataFrame:
    """(doc_id, hi, lo, payload): the full sets, as sorted 64-bit hashes, of documents (doc_id, text) that pass the sieve ``bits``."""

    def sifted(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            yield batch.filter(pc.and_(ids.is_valid(), pa.array(passes(bits, ids.fill_null(0).to_numpy()))))

    def run(batches):
        for part, values, begin in _sets(sifted(batches), "text", width):
            hi, lo = np.zeros((2, len(begin) - 1), np.int64)
            full = np.diff(begin) > 0
            if full.any():
                hi[full], lo[full] = _fingerprint(values, begin[:-1][full])
            sets = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hi), pa.array(lo), sets], ["doc_id", "hi", "lo", "payload"])

    return lean(documents).mapInArrow(run, "doc_id long, hi long, lo long, payload array<long>")


def jaccard_table(left: list, right: list, percent: int) -> np.ndarray:
    """Which pairs of two lists of sets have 100 * intersection >= percent * union; shared values go through in slices."""
    a, b = [np.asarray(x, np.int64) for x in left], [np.asarray(x, np.int64) for x in right]
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    shared = np.intersect1d(va, vb)
    both = np.zeros((len(a), len(b)), np.float32)
    if len(shared):
        ka, kb = np.searchsorted(shared, va), np.searchsorted(shared, vb)
        oka = shared[np.minimum(ka, len(shared) - 1)] == va
        okb = shared[np.minimum(kb, len(shared) - 1)] == vb
        ka, ra, kb, rb = ka[oka], ra[oka], kb[okb], rb[okb]
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka, ra, kb, rb = ka[oa], ra[oa], kb[ob], rb[ob]
        for lo in range(0, len(shared), 4096):
            hi = min(lo + 4096, len(shared))
            i, j = np.searchsorted(ka, [lo, hi])
            k, m = np.searchsorted(kb, [lo, hi])
            x, y = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
            x[ra[i:j], ka[i:j] - lo] = 1
            y[rb[k:m], kb[k:m] - lo] = 1
            both += x @ y.T
    common = both.astype(np.int64)
    return 100 * common >= percent * (na[:, None] + nb[None, :] - common)


def _finer(percent: int):
    """Buckets by rare shingle: of two sets that reach ``percent``, the prefixes share a shingle, so no link is lost.

    A set of n shingles has ceil(percent * n / 100) in common with such a
    partner, so they share one of their n + 1 less that rarest. Rarity is counted
    within the bucket, so what all its documents have, as a template's words,
    brings none of them together.
    """

    def refine(rows: DataFrame) -> DataFrame:
        held = rows.select("bucket", "id", F.explode("payload").alias("s"))
        often = held.groupBy("bucket", "s").agg(F.count(F.lit(1)).alias("k"))
        total = held.count()
        ranked = join_salted(held, often, ["bucket", "s"], "k", ["id"], total).groupBy("bucket", "id").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("all"))
        prefix = F.size("all") - F.ceil(percent * F.size("all") / 100.0).cast("int") + 1
        cut = ranked.select("bucket", "id", F.explode(F.slice("all", F.lit(1), prefix)).alias("t")).filter("t.k > 1")
        return cut.select(F.xxhash64("bucket", "t.s").alias("bucket"), "id").distinct()

    return refine


def _grouped(documents: DataFrame, percent: int, width: int, block: int) -> DataFrame:
    """(doc_id, mark, n_shingles, class, component_id) of every row; ``class`` names the group, null where a row links with nothing."""
    signed = stash(sign(documents, width), "signed")
    rows = signed.filter("n_shingles > 0 and doc_id is not null")
    listed = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    # The number of a class is none of its documents' ids, which may repeat with other texts. It is fixed once written.
    classes = stash(listed.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", F.explode("bands").alias("bucket")).select("bucket", "id").distinct()

    def items(ids: DataFrame) -> DataFrame:
        wanted = stash(classes.join(ids, "id").select("id", "first", "hi", "lo"), "wanted")
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        sets = shingle_sets(texts, sieve(wanted, "first"), width)
        return sets.join(wanted.withColumnRenamed("first", "doc_id"), ["doc_id", "hi", "lo"]).dropDuplicates(["id"]).select("id", "payload")

    def star_test(one, two):
        common = F.size(F.array_intersect(one, two))
        return 100 * common >= percent * (F.size(one) + F.size(two) - common)

    with scratch(documents.sparkSession) as made:
        found = linking.link_buckets(members, items, star_test, lambda a, b: jaccard_table(a, b, percent), block, _finer(percent), merge=True)
        found = stash(found, "found")
        made.pop()
    least = classes.join(found, "id").groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    named = join_salted(found, least, ["component"], "n", ["id"], found.count()).select("id", "component", "least")
    placed = classes.select("hi", "lo", "first", "rows", "id").join(named, "id", "left").select("hi", "lo", "rows", F.coalesce("component", "id").alias("class"), F.coalesce("least", "first").alias("component_id"))
    out = join_salted(rows, placed, ["hi", "lo"], "rows", ["doc_id"], rows.count()).select("doc_id", "mark", "n_shingles", "class", "component_id")
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return out.union(alone)


def near_duplicates(documents: DataFrame, percent: int = 85, width: int = 5, block: int = 128) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents`` (doc_id, text, ...).

    Null or blank texts have an empty set and link with nothing. Rows that
    repeat a doc_id are each judged by their own text, and so may differ in
    component_id and kept. Rows with a null doc_id link with nothing; their
    component_id is null and they are kept. Other columns are ignored; an empty
    table gives an empty frame.
    """
    out = _grouped(documents, percent, width, block)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, percent: int = 80, width: int = 5, block: int = 128) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates: that of the smallest doc_id, whatever its text.

    Where that doc_id repeats within the group, the row with the smallest hash of
    its text stays, and of rows that repeat both, the one with the smallest
    other columns. Rows that repeat a doc_id with unlike texts are in groups of
    their own. Null and blank texts and rows with a null doc_id all stay. Any
    other columns pass through; an empty table gives an empty frame.
    """
    rows = stash(_grouped(documents, percent, width, block).filter("class is not null"), "grouped")
    # A row here for each text of the smallest doc_id of a group; nearly always one.
    own = stash(rows.filter("doc_id = component_id").groupBy("doc_id", "class", "mark").agg(F.count(F.lit(1)).alias("n")), "own")
    heads = own.groupBy("doc_id", "class").agg(F.min("mark").alias("least"), F.max("mark").alias("most"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    both = stash(own.join(heads, ["doc_id", "class"]), "repeated")
    gone = rows.filter("doc_id <> component_id").select("doc_id", "mark").union(both.filter("mark <> least").select("doc_id", "mark"))
    key, mark = F.col("doc_id").cast("long"), mark_of(F.col("text"))
    left = without(documents, stash(gone.distinct(), "gone"), key, mark)
    again = both.filter("mark = least and n > 1").select("doc_id", "mark").distinct()
    if again.isEmpty():
        return left
    # Rows that repeat doc_id and text: one of each stays.
    one, two, whole = spare(documents, "one", "two", "whole")
    bits = sieve(again.select(F.xxhash64("doc_id", "mark").alias("id")))
    some = left.withColumn(one, key).withColumn(two, mark).filter(maybe_among(bits, F.xxhash64(one, two)))
    first = some.groupBy(one, two).agg(F.min(F.struct(*documents.columns)).alias(whole)).join(again.toDF(one, two), [one, two], "left_semi")
    return without(left, again, key, mark).union(first.select(f"{whole}.*"))
