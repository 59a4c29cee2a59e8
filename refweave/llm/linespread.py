"""Line dedup by distinct-site spread.

Sketches (HyperLogLog) of the sites of each line hash merge by aggregation.
Lines whose estimate lies near the threshold get an exact distinct count; the
others are decided by the estimate. A line of at least ``sites`` sites is
boilerplate: it stays in the document of the smallest doc_id that holds it, at
its first place there, and goes everywhere else. A document is a doc_id with a
text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from refweave.llm.shared import lean, spare, stash

SITES = 5
LOG_K = 6  # 64 registers at most: a standard error of about 0.13 once a sketch is dense, none below
MARGIN = 3 * 1.04 / 8


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> tuple[Column, Column]:
    """128 bits of a line without the white space around it."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    one = F.xxhash64(bare)
    return one.alias("h1"), F.xxhash64(one, bare).alias("h2")


def occurrences(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, site, n, h1, h2): a row per non-blank line. ``mark`` hashes the text; a null source is a site of its own."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.xxhash64(F.col("source").cast("string")).alias("site"), F.posexplode(lines_of(F.col("text"))).alias("n", "line"))
    one, two = key_of(F.col("line"))
    return rows.filter(F.btrim("line", F.lit(" \t\r\x0b\x0c")) != "").select("doc_id", "mark", "site", "n", one, two)


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2, first): hashes on ``sites`` sites or more, and where each is first: smallest doc_id, its mark and the line there."""
    spread = stash(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.min(F.struct("doc_id", "mark", "n")).alias("first"), F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") >= sites)
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate"), "first")
        .filter(F.col("estimate") >= sites * (1 - MARGIN)),
        "spread",
    )
    near = spread.filter(F.col("estimate") <= sites * (1 + MARGIN))
    exact = (
        lines.select("h1", "h2", "site").distinct()
        .join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
        .filter(F.col("exact") >= sites)
    )
    sure = spread.filter(F.col("estimate") > sites * (1 + MARGIN))
    return sure.select("h1", "h2", "first").union(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def drop_boilerplate(documents: DataFrame, sites: int = SITES, count: str = "dropped") -> DataFrame:
    """``documents`` with text, n_chars (if present) and ``count``, the number of lines taken out, which replaces a column of that name.

    Lines are the parts between newlines; blank lines always stay. Null texts
    stay null and null doc_ids stay unchanged. Rows that repeat a doc_id each
    lose lines of their own text; where they repeat the text as well they are
    one document, and keep the same lines. Of a doc_id with several texts, that
    of the smallest hash keeps a line that is first there. Texts without
    boilerplate come back as they were. Other columns pass through, whatever
    their names; an empty table gives an empty frame.
    """
    lines = occurrences(documents.filter("text is not null and doc_id is not null"))
    common = stash(boilerplate(lines, sites), "boilerplate")
    names = [c for c in documents.columns if c.lower() != count.lower()]
    rows = documents.select(*names)
    key, mark, gone = spare(rows, "key", "mark", "gone")
    lost = (
        lines.join(common, ["h1", "h2"])
        .filter(F.struct("doc_id", "mark", "n") != F.col("first"))
        .groupBy(F.col("doc_id").alias(key), F.col("mark").alias(mark)).agg(F.collect_set("n").alias(gone))
    )
    rows = rows.withColumn(key, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(lost.hint("shuffle_hash"), [key, mark], "left").select(*names, gone)
    schema = StructType([*documents.select(*names).schema.fields]).add(count, IntegerType())

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            lost = columns.pop(gone)
            where = np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False))
            dropped = np.zeros(batch.num_rows, np.int32)
            if len(where):
                mask = np.zeros(batch.num_rows, bool)
                mask[where] = True
                kept = []
                for i in where:
                    parts, out = columns["text"][i].as_py().split("\n"), set(lost[i].as_py())
                    rest = [x for k, x in enumerate(parts) if k not in out]
                    dropped[i] = len(parts) - len(rest)
                    kept.append("\n".join(rest))
                text = pa.array(kept, columns["text"].type)
                columns["text"] = pc.replace_with_mask(columns["text"], pa.array(mask), text)
                if "n_chars" in columns:
                    columns["n_chars"] = pc.replace_with_mask(columns["n_chars"], pa.array(mask), pc.utf8_length(text).cast(columns["n_chars"].type))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(dropped)], [*columns, count])

    return lean(joined).mapInArrow(run, schema)
