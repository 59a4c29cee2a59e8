"""The shape of bibliographies in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed thresholds of the notes.
OLD_YEARS, PREPRINTS, SELF, MISSING, OLD, ONE_VENUE, ENOUGH = 10, 0.35, 0.25, 0.2, 0.6, 0.4, 8
TOP = 5


def share(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def top_counts(rows: DataFrame, name: str, top: int | None = TOP) -> DataFrame:
    """(bib_id, name, n, rank): values by how often they occur, earlier ones first among equals."""
    counted = rows.filter(F.col(name).isNotNull()).groupBy("bib_id", name).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("bib_id").orderBy(F.desc("n"), "first")))
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).drop("first")


def totals(entries: DataFrame, reference_year: int, self_family_keys: list[str] = ()) -> DataFrame:
    """Counts per bibliography of entries with facts. ``reference_year`` is a parameter: results must not depend on the day."""
    own = F.exists(F.coalesce("authors", F.array().cast(entries.schema["authors"].dataType)), lambda a: a["family_key"].isin(*self_family_keys)) if self_family_keys else F.lit(False)
    preprint = (F.col("kind") == "preprint") | (F.col("arxiv_id").isNotNull() & F.col("doi").isNull())
    return entries.groupBy("bib_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("doi").alias("with_doi"), F.count(F.coalesce("doi", "arxiv_id")).alias("with_identifier"), F.count_if(preprint).alias("preprints"),
        F.count_if(own).alias("self_citations"), F.median("year").cast("int").alias("median_year"), F.min("year").alias("oldest_year"), F.max("year").alias("newest_year"),
        F.count_if(F.lit(reference_year) - F.col("year") > OLD_YEARS).alias("older_than_10y"),
    )


def percent(part: Column, total: Column) -> Column:
    """Whole percent, half to even."""
    return F.concat(F.bround(100.0 * share(part, total)).cast("int").cast("string"), F.lit("%"))


def notes(venue: Column, count: Column) -> Column:
    """Remarks where a number stands out; ``venue`` and ``count`` are of the most frequent venue."""
    c = F.col
    n = c("total")
    of = lambda part: F.concat(part.cast("string"), F.lit(" of "), n.cast("string"))
    missing = n - c("with_identifier")
    said = [
        (share(c("preprints"), n) > PREPRINTS, F.concat(of(c("preprints")), F.lit(" references are preprints ("), percent(c("preprints"), n), F.lit("); check whether any have since been published"))),
        (share(c("self_citations"), n) > SELF, F.concat(of(c("self_citations")), F.lit(" are self-citations ("), percent(c("self_citations"), n), F.lit(")"))),
        ((missing > 0) & (share(missing, n) > MISSING), F.concat(missing.cast("string"), F.lit(" references carry no DOI or arXiv id, so they cannot be verified automatically"))),
        ((share(c("older_than_10y"), n) > OLD) & (n >= ENOUGH), F.concat(of(c("older_than_10y")), F.lit(f" references are more than {OLD_YEARS} years old"))),
        ((n >= ENOUGH) & (share(count, n) > ONE_VENUE), F.concat(of(count), F.lit(" references come from "), venue)),
    ]
    return F.filter(F.array(*[F.when(when, text) for when, text in said]), lambda x: x.isNotNull())


def summarise(entries: DataFrame, reference_year: int, self_family_keys: list[str] = ()) -> DataFrame:
    """``totals`` with venues, kinds and notes: all that the health report shows."""
    listed = lambda name, top: top_counts(entries, name, top).groupBy("bib_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name, "n"))), lambda x: F.struct(x[name].alias("name"), x["n"].alias("count"))).alias(f"{name}s"))
    out = totals(entries, reference_year, self_family_keys).join(listed("venue", TOP), "bib_id", "left").join(listed("kind", None), "bib_id", "left")
    first = F.get("venues", F.lit(0))
    return out.withColumn("notes", notes(first["name"], F.coalesce(first["count"], F.lit(0))))


def stats_json(summaries: DataFrame) -> DataFrame:
    """(bib_id, json) of ``summarise``; numbers that are not known are null."""
    c = F.col
    kinds = F.transform("kinds", lambda k: F.struct(k["name"].alias("kind"), k["count"].alias("count")))
    body = F.struct("total", "with_doi", "with_identifier", "preprints", "self_citations", "median_year", "oldest_year", "newest_year", "older_than_10y", F.coalesce(c("venues"), F.array().cast("array<struct<name:string,count:long>>")).alias("venues"), kinds.alias("kinds"), "notes")
    return summaries.select("bib_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def stats_text(summaries: DataFrame) -> DataFrame:
    """(bib_id, text): the numbers worth a line, the three most frequent venues, and the notes."""
    c = F.col
    with_share = lambda n: F.concat(c(n).cast("string"), F.lit("  ("), percent(c(n), c("total")), F.lit(")"))
    lines = [
        ("references", c("total").cast("string"), F.lit(True)), ("with a DOI", with_share("with_doi"), F.lit(True)),
        ("years", F.concat(c("oldest_year").cast("string"), F.lit("–"), c("newest_year").cast("string"), F.lit("   median "), c("median_year").cast("string")), c("median_year").isNotNull()),
        (f"older than {OLD_YEARS}y", with_share("older_than_10y"), c("median_year").isNotNull()), ("preprints", with_share("preprints"), c("preprints") > 0), ("self-citations", with_share("self_citations"), c("self_citations") > 0),
    ]
    shown = F.filter(F.array(*[F.when(when, F.struct(F.lit(label).alias("l"), value.alias("v"))) for label, value, when in lines]), lambda x: x.isNotNull())
    width = F.array_max(F.transform("shown", lambda x: F.length(x["l"])))
    rows = F.transform("shown", lambda x: F.concat(F.lit("  "), F.lpad(x["l"], c("width"), F.lit(" ")), F.lit("  "), x["v"]))
    name = lambda v: F.when(F.length(v["name"]) > 52, F.concat(F.left(v["name"], F.lit(49)), F.lit("…"))).otherwise(v["name"])
    venues = F.transform(F.slice(F.coalesce("venues", F.array().cast("array<struct<name:string,count:long>>")), F.lit(1), F.lit(3)), lambda v: F.concat(F.lit("    "), F.lpad(v["count"].cast("string"), F.lit(3), F.lit(" ")), F.lit("  "), name(v)))
    said = F.transform("notes", lambda n: F.concat(F.lit("  · "), n))
    return summaries.withColumn("shown", shown).withColumn("width", width).select("bib_id", F.array_join(F.concat(rows, venues, said), "\n").alias("text"))
