"""Shapes that all frames share, and the fixed vocabularies of kinds, codes and severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = (
    "bib_id string, ord int, key string, entry_type string, fields map<string,string>, field_order array<string>, "
    "start_line int, source string, raw string"
)
PROBLEM_FIELDS = "code string, severity string, message string, field string, local string, authoritative string, confidence double, url string"
PROBLEM = f"bib_id string, ord int, rule_ord int, seq int, {PROBLEM_FIELDS}"
FILE_PROBLEM = f"bib_id string, seq int, {PROBLEM_FIELDS}"

# Kinds of BibTeX and of registry types; everything else is "other".
KIND_OF_ENTRY = {
    "article": "journal-article", "inproceedings": "conference-paper", "conference": "conference-paper", "proceedings": "conference-paper",
    "book": "book", "inbook": "chapter", "incollection": "chapter", "phdthesis": "thesis", "mastersthesis": "thesis",
    "techreport": "report", "manual": "report", "online": "webpage", "electronic": "webpage", "misc": "other", "unpublished": "other",
}
KIND_OF_WORK = {
    "journal-article": "journal-article", "proceedings-article": "conference-paper", "proceedings": "conference-paper", "book": "book",
    "monograph": "book", "reference-book": "book", "edited-book": "book", "book-chapter": "chapter", "book-part": "chapter",
    "book-section": "chapter", "dissertation": "thesis", "report": "report", "report-component": "report", "posted-content": "preprint",
}
ENTRY_OF_KIND = {
    "journal-article": "article", "conference-paper": "inproceedings", "preprint": "misc", "book": "book", "chapter": "incollection",
    "thesis": "phdthesis", "report": "techreport", "webpage": "misc", "other": "misc",
}
SEVERITIES = ("info", "warn", "critical")
STATUSES = ("ok", "warn", "critical", "unresolved", "network_error")


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def problem(code: str, severity: Column | str, message: Column | str, **more: Column | str) -> Column:
    """A finding; what it does not say is null."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    given = {"code": text(code), "severity": text(severity), "message": text(message)} | {k: text(v) for k, v in more.items()}
    parts = [x.split() for x in PROBLEM_FIELDS.split(", ")]
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in parts])


def field_of(fields: Column):
    """Access to a field's raw value by lower-cased name; empty values are kept apart from absent ones by the caller."""
    return lambda name: F.element_at(fields, name.lower())


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each computed once a row.

    Columns of a generator are never folded into the expressions that read them, as those of a
    projection are where these feed a Python function.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
