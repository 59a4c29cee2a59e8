"""Citation keys: a suggestion for a work, and letters that keep keys of one bibliography apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refweave.store import written

# Fixed word list: title words that identify nothing.
DULL = (
    "a", "an", "the", "of", "on", "in", "for", "and", "or", "to", "with", "using", "via", "towards", "toward", "into", "from", "by", "at", "as", "is",
    "are", "new", "novel", "improved", "efficient", "learning", "deep", "approach", "method", "study", "analysis", "based",
)


def cleaned(ascii_text: Column) -> Column:
    return F.regexp_replace(F.lower(ascii_text), "[^a-z0-9]", "")


def suggest_key(family: Column, year: Column, title: Column) -> Column:
    """Surname, year and first telling title word, of ASCII text (see ``latex.ascii_text``); nulls leave their part out."""
    words = F.transform(F.split(title, r"(?U)[\s:–—-]+"), cleaned)
    word = F.get(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*DULL)), F.lit(0))
    key = F.concat(F.coalesce(F.left(cleaned(family), F.lit(20)), F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(F.left(word, F.lit(14)), F.lit("")))
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("reference"))


def suffix_of(n: Column) -> Column:
    """What the n-th row of a key adds to it: nothing, a to z, then 2, 3 and so on."""
    return F.when(n == 0, "").when(n <= 26, F.char(n + 96)).otherwise((n - 25).cast("string"))


def unique_keys(rows: DataFrame, base: str, order: list[str], within: list[str], out: str = "key") -> DataFrame:
    """``rows`` with a key each that no other row of their group has: in ``order``, the rows of a base take it, base + a and so on.

    The n-th row of a base can't do better than the n-th ending, so rows start
    there. Where two bases meet in a key, its first row keeps it, and the ending
    is closed to the other base from its row on; this is repeated until no two
    rows meet, which mostly is at once. Where bases meet again and again an ending
    may be passed over though it is free. ``order`` must tell the rows of a group apart.
    """
    place = F.struct(*order)
    columns = rows.columns
    ranked = rows.withColumn("_n", (F.row_number().over(Window.partitionBy(*within, base).orderBy(*order)) - 1).cast("long")).withColumn("_o", place)
    closed = None
    while True:
        if closed is None:
            keyed = ranked.withColumn("_i", F.col("_n"))
        else:
            # Closed endings at or below a row's number move it on by one each, in rising order.
            once = closed.groupBy(*within, base, "_i").agg(F.min("_from").alias("_from"))
            lists = once.groupBy(*within, base).agg(F.array_sort(F.collect_set(F.struct(F.col("_i").alias("i"), F.col("_from").alias("o")))).alias("_closed"))
            moved = F.aggregate("_closed", F.col("_n"), lambda acc, x: F.when((x["i"] <= acc) & (x["o"] <= F.col("_o")), acc + 1).otherwise(acc))
            keyed = ranked.join(lists, [*within, base], "left").withColumn("_i", F.when(F.col("_closed").isNull(), F.col("_n")).otherwise(moved)).drop("_closed")
        keyed = written(keyed.withColumn(out, F.concat(F.col(base), suffix_of(F.col("_i")))), "keys")
        first = keyed.groupBy(*within, out).agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_k")).filter("_k > 1")
        lost = keyed.join(first, [*within, out]).filter(F.col("_o") != F.col("_first")).groupBy(*within, base, "_i").agg(F.min("_o").alias("_from"))
        lost = written(lost, "closed")
        if lost.isEmpty():
            return keyed.select(*columns, out)
        closed = lost if closed is None else written(closed.unionByName(lost), "closed")
