"""Entries in the shape in which both sides are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.identifiers import extract_arxiv, extract_doi
from refweave.functions.latex import title_keys, unicode_text, venue_keys
from refweave.functions.names import PEOPLE, people
from refweave.functions.scalars import pages_of, present, volume_of, year_of
from refweave.schema import KIND_OF_ENTRY, field_of, lookup

# Fixed order in which fields name the venue.
VENUE_FIELDS = ("journal", "journaltitle", "booktitle", "series", "school", "institution", "publisher", "howpublished")

FACTS = ("title", "subtitle", "authors", "year", "venue", "volume", "issue", "pages", "publisher", "doi", "arxiv_id", "kind")


def entry_facts(entries: DataFrame) -> DataFrame:
    """``entries`` with the facts of each (see ``FACTS``) and the keys title_key and venue_key.

    Each raw field goes through Python once, in one pass; empty values and
    empty author lists become null, so that plain comparison never takes
    absence for disagreement. Extra columns pass through.
    """
    raw = field_of(F.col("fields"))
    said = lambda *names: F.coalesce(*[present(raw(n)) for n in names])
    shown = {
        "title": said("title"), "subtitle": said("subtitle"), "venue": said(*VENUE_FIELDS), "publisher": said("publisher"), "year": said("year", "date"),
        "volume": raw("volume"), "issue": said("number", "issue"), "pages": raw("pages"),
    }
    kind = lookup(KIND_OF_ENTRY, F.lower("entry_type"), "other")
    arxiv = extract_arxiv(raw)
    # Raw values are columns of their own first, so that what reads them several times does not repeat the look-up.
    shown |= {"author": said("author", "editor"), "doi": extract_doi(raw), "arxiv": arxiv}
    read = entries.select(*entries.columns, *[c.alias(f"_raw_{n}") for n, c in shown.items()])
    at = lambda n: F.col(f"_raw_{n}")
    once = read.select(
        *entries.columns, *[unicode_text(at(n)).alias(f"_{n}") for n in shown if n not in ("author", "doi", "arxiv")], people(at("author")).alias("_authors"),
        title_keys(at("title")).alias("title_key"), venue_keys(at("venue")).alias("venue_key"), at("doi").alias("doi"), at("arxiv").alias("arxiv_id"),
    )
    text = lambda n: present(F.col(f"_{n}"))
    return once.select(
        *entries.columns, text("title").alias("title"), text("subtitle").alias("subtitle"), F.when(F.size("_authors") > 0, F.col("_authors")).cast(PEOPLE).alias("authors"),
        year_of(F.col("_year")).alias("year"), text("venue").alias("venue"), volume_of(F.col("_volume")).alias("volume"), volume_of(F.col("_issue")).alias("issue"),
        pages_of(F.col("_pages")).alias("pages"), text("publisher").alias("publisher"), "doi", "arxiv_id",
        F.when(F.col("arxiv_id").isNotNull() & kind.isin("other", "report", "webpage"), "preprint").otherwise(kind).alias("kind"),
        present(F.col("title_key")).alias("title_key"), present(F.col("venue_key")).alias("venue_key"),
    )
