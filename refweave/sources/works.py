"""Registry responses (JSON) as a works table.

Responses differ in shape from record to record, so they are read as VARIANT:
whatever has another type than expected counts as absent and never fails.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions.identifiers import normalize_arxiv, normalize_doi
from refweave.functions.latex import mapped, unicode_text
from refweave.functions.names import PEOPLE, person
from refweave.functions.scalars import pages_of, present, stripped, volume_of
from refweave.schema import KIND_OF_WORK, lookup

# What update notices mean.
RETRACTED = ("retraction", "partial_retraction")
WITHDRAWN = ("withdrawal", "removal")
CONCERN = ("expression_of_concern",)
DATES = ("issued", "published", "published-print", "published-online", "created")


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def text(value: Column) -> Column:
    """A trimmed, non-empty string, else null."""
    return F.when(is_text(value), present(stripped(F.try_variant_get(value, "$", "string"))))


def items(value: Column) -> Column:
    """The elements of an array, null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def first_text(value: Column) -> Column:
    listed = F.filter(F.transform(items(value), text), lambda x: x.isNotNull())
    return F.coalesce(text(value), F.get(listed, F.lit(0)))


def year(value: Column) -> Column:
    """The first plausible year that heads a group of date parts."""

    def head(group):
        x = at(group, "$[0]")
        kind = F.schema_of_variant(x)
        digits = F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind == "BIGINT", F.try_variant_get(x, "$", "long").cast("string"))
        return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))

    years = F.filter(F.transform(items(at(value, "$['date-parts']")), head), lambda y: y.between(1600, 2200))
    return F.get(years, F.lit(0))


def _people(raw: str) -> list[dict]:
    try:
        listed = json.loads(raw)
    except ValueError:
        return []
    out = []
    for item in listed if isinstance(listed, list) else []:
        get = lambda k: v.strip() if isinstance(item, dict) and isinstance(v := item.get(k), str) and v.strip() else ""
        family, given, name = get("family"), get("given"), get("name")
        if family:
            out.append(person(f"{family}, {given}" if given else family, family, given))
        elif name:
            out.append(person(name, name))
    return out


people_of_json = mapped(_people, PEOPLE)


def notices(message: Column) -> Column:
    """Types of the updates that a work has had or is, in order, each once."""

    def kinds(path):
        named = F.transform(items(at(message, path)), lambda x: F.translate(F.lower(text(at(x, "$.type"))), "- ", "__"))
        return F.coalesce(F.filter(named, lambda x: x.isNotNull()), F.array().cast("array<string>"))

    return F.array_distinct(F.concat(kinds("$['updated-by']"), kinds("$['update-to']")))


def relation(message: Column, name: str) -> Column:
    return F.coalesce(F.filter(items(at(message, f"$.relation['{name}']")), is_object), F.array().cast("array<variant>"))


def relation_doi(message: Column, name: str) -> Column:
    """The first valid DOI that a relation names; an identifier without a type counts as one."""
    found = F.transform(relation(message, name), lambda x: F.when(F.coalesce(F.lower(text(at(x, "$['id-type']"))), F.lit("doi")) == "doi", normalize_doi(text(at(x, "$.id")))))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def kind_of(message: Column) -> Column:
    declared = F.lower(F.coalesce(text(at(message, "$.type")), F.lit("")))
    sub = F.lower(F.coalesce(text(at(message, "$.subtype")), F.lit("")))
    return F.when((declared == "posted-content") & ~sub.isin("", "preprint"), "other").otherwise(lookup(KIND_OF_WORK, declared, "other"))


def map_works(messages: DataFrame, column: str = "message") -> DataFrame:
    """``messages`` with the fields of a work in place of its JSON text ``column``. Text that is no JSON object has nulls throughout."""
    rest = [c for c in messages.columns if c != column]
    m = F.col("_m")
    venue = F.coalesce(
        first_text(at(m, "$['container-title']")),
        first_text(at(m, "$['short-container-title']")),
        F.get(F.filter(F.transform(items(at(m, "$.institution")), lambda x: text(at(x, "$.name"))), lambda x: x.isNotNull()), F.lit(0)),
        first_text(at(m, "$.publisher")),
    )
    raw = messages.withColumn("_m", F.try_parse_json(column)).select(
        *rest,
        normalize_doi(text(at(m, "$.DOI"))).alias("doi"),
        first_text(at(m, "$.title")).alias("_title"),
        first_text(at(m, "$.subtitle")).alias("_subtitle"),
        F.to_json(at(m, "$.author")).alias("_author"),
        F.coalesce(*[year(at(m, f"$['{d}']")) for d in DATES]).alias("year"),
        venue.alias("_venue"),
        text(at(m, "$.volume")).alias("_volume"),
        text(at(m, "$.issue")).alias("_issue"),
        text(at(m, "$.page")).alias("_pages"),
        text(at(m, "$.publisher")).alias("_publisher"),
        F.filter(F.transform(items(at(m, "$['alternative-id']")), lambda x: normalize_arxiv(text(x))), lambda x: x.isNotNull()).alias("_other"),
        kind_of(m).alias("kind"),
        notices(m).alias("update_notices"),
        (F.size(relation(m, "is-retracted-by")) > 0).alias("_by"),
        relation_doi(m, "is-preprint-of").alias("published_version_doi"),
    )
    shown = lambda c: present(unicode_text(c))
    done = raw.select(
        *rest, "doi", shown("_title").alias("title"), shown("_subtitle").alias("subtitle"),
        F.coalesce(people_of_json("_author"), F.array().cast(PEOPLE)).alias("authors"), "year", shown("_venue").alias("venue"),
        unicode_text("_volume").alias("_volume"), unicode_text("_issue").alias("_issue"), unicode_text("_pages").alias("_pages"),
        shown("_publisher").alias("publisher"), "_other", "kind", "update_notices", "_by", "published_version_doi",
    )
    has = lambda kinds: F.arrays_overlap("update_notices", F.array(*map(F.lit, kinds)))
    return done.select(
        *rest, "doi", "title", "subtitle", "authors", "year", "venue", volume_of(F.col("_volume")).alias("volume"), volume_of(F.col("_issue")).alias("issue"),
        pages_of(F.col("_pages")).alias("pages"), "publisher", F.coalesce(normalize_arxiv(F.col("doi")), F.get("_other", F.lit(0))).alias("arxiv_id"), "kind",
        (has(RETRACTED) | F.col("_by")).alias("retracted"), has(WITHDRAWN).alias("withdrawn"), has(CONCERN).alias("expression_of_concern"),
        "update_notices", "published_version_doi",
    )


def messages_of(responses: DataFrame, column: str = "body") -> DataFrame:
    """The ``message`` of each response envelope as JSON text; null where there is none."""
    m = at(F.try_parse_json(column), "$.message")
    return responses.withColumn("message", F.when(is_object(m), F.to_json(m))).drop(column)


def search_items(responses: DataFrame, column: str = "body") -> DataFrame:
    """A row per result of a search response: its place and its JSON text. Results that are no objects are passed over."""
    listed = F.filter(items(at(F.try_parse_json(column), "$.message.items")), is_object)
    rest = [c for c in responses.columns if c != column]
    return responses.select(*rest, F.posexplode(F.transform(listed, lambda x: F.to_json(x))).alias("pos", "message"))
