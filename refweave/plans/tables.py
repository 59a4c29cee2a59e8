"""Deterministic readings of general tables as bibliographies, works, ledgers and citations.

The tables hold no bibliographic text. These projections give every operator
rows with hits, misses, gaps and ties that SQL can state as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.names import PEOPLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_entries(rows: DataFrame, bib_id, ord_, fields: dict, entry_type="article", key=None) -> DataFrame:
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[v.cast("string") for v in fields.values()])), lambda k, v: v.isNotNull())
    none = F.lit(None)
    kind = F.lit(entry_type) if isinstance(entry_type, str) else entry_type
    return rows.select(
        bib_id.cast("string").alias("bib_id"), ord_.cast("int").alias("ord"), (F.concat(F.lit("d"), ord_.cast("string")) if key is None else key).alias("key"), kind.alias("entry_type"),
        pairs.alias("fields"), F.map_keys(pairs).alias("field_order"), none.cast("int").alias("start_line"), none.cast("string").alias("source"), none.cast("string").alias("raw"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bibliography per source, an entry per document whose whole text is its title; every fifth has no DOI, some have another year or an abbreviated venue."""
    i = F.col("doc_id")
    start = F.col("n_chars") % 900
    doi = F.when(i % 5 != 0, F.concat(F.when(i % 3 == 0, "https://doi.org/10.5555/DOC.").otherwise("10.5555/doc."), i.cast("string")))
    fields = {
        "title": F.col("text"), "author": F.when(i % 6 != 0, "Doe, Jane"), "doi": doi, "year": 1990 + i % 35 + (i % 7 == 0).cast("int"), "journal": F.concat(F.when(i % 9 == 0, "J. of ").otherwise("Journal of "), "lang"),
        "volume": i % 40, "pages": F.concat(start.cast("string"), F.lit("--"), (start + i % 50).cast("string")), "eprint": F.when(i % 17 == 0, F.concat(F.lit("2101."), F.lpad((i % 100000).cast("string"), 5, "0"))),
    }
    return as_entries(table(spark, sf_dir, "documents"), F.col("source"), i, fields)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as registered works; labels stand for retractions and concerns."""
    i = F.col("doc_id")
    start = F.col("n_chars") % 900
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    none = F.lit(None).cast("string")
    end = start + i % 50 + (i % 19 == 0).cast("int")
    return rows.select(
        F.concat(F.lit("10.5555/doc."), i.cast("string")).alias("doi"), F.nullif(F.col("text"), F.lit("")).alias("title"), none.alias("subtitle"), F.array().cast(PEOPLE).alias("authors"),
        (1990 + i % 35).cast("int").alias("year"), F.when(i % 23 == 0, F.concat(F.lit("Annals of Botany "), "lang")).otherwise(F.concat(F.lit("Journal of "), "lang")).alias("venue"),
        (i % 40 + (i % 11 == 0).cast("int")).cast("string").alias("volume"), none.alias("issue"), F.struct(start.cast("string").alias("start"), end.cast("string").alias("end")).alias("pages"),
        none.alias("publisher"), none.alias("arxiv_id"), F.lit("journal-article").alias("kind"), (F.col("toxic") == 1).alias("retracted"), F.lit(False).alias("withdrawn"),
        (F.col("quality") == 0).alias("expression_of_concern"), F.array().cast("array<string>").alias("update_notices"),
        F.when(i % 17 == 0, F.concat(F.lit("10.5555/doc."), (i + 1).cast("string"))).alias("published_version_doi"),
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose DOIs, titles and years collide: the same work under several keys."""
    i, title = F.col("doc_id"), F.col("text")
    doi = F.when(i % 5 != 0, F.concat(F.lit("10.5555/"), "source", F.lit("."), (F.length(title) % 97).cast("string")))
    return as_entries(table(spark, sf_dir, "documents"), F.col("source"), i, {"title": title, "doi": doi, "year": 1990 + F.col("n_chars") % 35})


def part_title(key, *more) -> Column:
    """Four words that few parts have, and others."""
    return F.concat_ws(" ", *[F.concat(F.lit(letter), (key % n).cast("string")) for letter, n in (("a", 1499), ("b", 997), ("c", 613), ("d", 389))], *more)


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bibliography per brand, an entry per part: a third have a DOI, some of the rest a malformed one; the name is the author."""
    k = F.col("p_partkey")
    fields = {
        "title": part_title(k), "author": F.initcap("p_name"), "year": 1950 + k % 60,
        "doi": F.when(k % 3 == 0, F.concat(F.lit("10.5555/part."), k.cast("string"))).when(k % 9 == 1, F.concat(F.lit("see part "), k.cast("string"))),
    }
    return as_entries(table(spark, sf_dir, "part"), F.col("p_brand"), k, fields)


def part_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as registered works, but for every seventh: titles in other words or another order, other people, shorter and later editions."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    words = F.split(part_title(k), " ")
    main = (
        F.when(k % 5 == 1, F.concat_ws(" ", F.reverse(words))).when((k % 5 == 2) & (k % 3 == 0), F.concat_ws(" ", F.slice(words, 1, 2), F.concat(F.lit("other"), k.cast("string")), F.lit("title")))
        .when(k % 5 == 3, part_title(k, F.lit("revisited"))).otherwise(part_title(k))
    )
    given, family = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    shown = F.when(k % 4 == 2, F.concat(F.left(given, F.lit(1)), F.lit("."))).otherwise(given)
    person = F.struct(F.concat_ws(" ", shown, F.col("f")).alias("display"), F.col("f").alias("family"), shown.alias("given"), F.lit("").alias("suffix"), F.lower("f").alias("family_key"), F.lower(F.left(given, F.lit(1))).alias("given_initial"))
    none = F.lit(None).cast("string")

    def made(kind, rows, title, year):
        rows = rows.withColumn("f", F.when(k % 4 == 1, F.lit("Other")).otherwise(family))
        return rows.select(
            F.concat(F.lit(f"10.5555/{kind}."), k.cast("string")).alias("doi"), title.alias("title"), none.alias("subtitle"), F.when(k % 4 == 3, F.array().cast(PEOPLE)).otherwise(F.array(person).cast(PEOPLE)).alias("authors"),
            year.cast("int").alias("year"), none.alias("venue"), none.alias("volume"), none.alias("issue"), F.lit(None).cast("struct<start:string,end:string>").alias("pages"), none.alias("publisher"), none.alias("arxiv_id"),
            F.lit("journal-article").alias("kind"), F.lit(False).alias("retracted"), (k % 17 == 0).alias("withdrawn"), F.lit(False).alias("expression_of_concern"), F.array().cast("array<string>").alias("update_notices"), none.alias("published_version_doi"),
        )

    there = parts.filter(k % 7 != 6)
    year = 1950 + k % 60
    works_ = made("part", there, main, year - (k % 13 == 0).cast("int"))
    works_ = works_.union(made("short", there.filter(k % 6 == 1), F.concat_ws(" ", F.slice(words, 1, 3)), year))
    works_ = works_.union(made("first", there.filter(k % 6 == 1), F.concat_ws(" ", F.slice(words, 1, 2)), year))
    return works_.union(made("again", there.filter(k % 10 == 4), part_title(k), year + 3))


def no_replies(spark: SparkSession, works_: DataFrame) -> DataFrame:
    """Recorded searches that found nothing."""
    from refweave.operators.resolve import FACTS, FLAGS

    return works_.limit(0).select(F.lit("").alias("bib_id"), F.lit(0).alias("ord"), F.lit(0).alias("pos"), F.struct(*FACTS, *FLAGS).alias("known"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.lit("work").alias("namespace"), F.col("user_id").cast("string").alias("identifier"), F.when(kind == "error", 503).when(kind == "signup", 404).otherwise(200).alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("fetched_at"), F.col("event_id").alias("event_id"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bib_id, key): one cited key per turn, some of which nobody defines."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "conversations").crossJoin(F.broadcast(n))  # one row
    return rows.select(F.lit("all").alias("bib_id"), F.concat(F.lit("d"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % (F.col("n") + 20)).cast("string")).alias("key"))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bib_id, ord, author): part names as people, every third with an initial only."""
    given, family = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("bib_id"), k.cast("int").alias("ord"), F.concat(F.when(k % 3 == 0, F.concat(F.left(given, F.lit(1)), F.lit("."))).otherwise(given), F.lit(" "), family).alias("author"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with facts from orders: a bibliography per status."""
    k = F.col("o_orderkey")
    own = F.when(F.col("o_custkey") % 50 == 0, "self").otherwise("other")
    person = F.struct(own.alias("display"), own.alias("family"), F.lit("").alias("given"), F.lit("").alias("suffix"), own.alias("family_key"), F.lit("").alias("given_initial"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("bib_id"), k.cast("int").alias("ord"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("venue"),
        F.when(k % 3 != 0, F.concat(F.lit("10.1/o"), k.cast("string"))).alias("doi"), F.when(k % 4 == 0, F.lit("2101.00001")).alias("arxiv_id"),
        F.when(k % 10 == 0, "preprint").when(k % 7 == 0, "book").otherwise("journal-article").alias("kind"), F.array(person).alias("authors"),
    )
