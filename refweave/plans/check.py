"""The whole check of a corpus of bibliographies, and single look-ups, as one plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.identifiers import normalize_arxiv, normalize_doi, query_kind
from refweave.functions.keys import suggest_key
from refweave.functions.latex import ascii_text, title_keys, venue_keys
from refweave.functions.names import PEOPLE
from refweave.operators import bibwide, export, rules, verdict
from refweave.operators.project import entry_facts
from refweave.operators.resolve import resolve


@dataclass
class Check:
    resolved: DataFrame
    problems: DataFrame
    reports: DataFrame
    crosschecks: DataFrame | None

    def release(self) -> None:
        self.resolved.unpersist()


def check(entries: DataFrame, works: DataFrame, manuscripts: DataFrame | None = None, style: str | None = None, failed: DataFrame | None = None, replies: DataFrame | None = None, limit: int | None = None) -> Check:
    """Findings and verdicts of ``entries`` against ``works``.

    ``manuscripts`` (bib_id, text) adds cited and uncited keys, ``style`` the
    style rules, and ``failed`` (bib_id, ord, outcome, detail) look-ups that got
    no answer. ``limit`` keeps the first entries of each bibliography. The
    resolved entries are kept in memory and on disk, since every rule reads them.
    """
    if limit is not None:
        entries = entries.filter(F.col("ord") < limit)
    resolved = resolve(entry_facts(entries), works, replies)
    if failed is not None:
        lost = failed.select("bib_id", "ord", F.col("outcome").alias("_o"), F.col("detail").alias("_d"))
        rest = [c for c in resolved.columns if c not in ("outcome", "detail")]
        resolved = resolved.join(lost, ["bib_id", "ord"], "left").select(*rest, F.coalesce("_o", "outcome").alias("outcome"), F.coalesce("_d", "detail").alias("detail"))
    resolved = resolved.persist(StorageLevel.MEMORY_AND_DISK)
    problems = rules.entry_problems(resolved, style).unionByName(bibwide.duplicates(resolved))
    if style:
        problems = problems.unionByName(bibwide.bibliography_problems(resolved))
    crosschecks = None
    if manuscripts is not None:
        problems = problems.unionByName(bibwide.uncited_problems(resolved, manuscripts))
        crosschecks = bibwide.crosscheck(resolved, manuscripts)
    return Check(resolved, problems, verdict.entry_reports(resolved, problems), crosschecks)


def cite(queries: DataFrame, works: DataFrame) -> DataFrame:
    """(query, outcome, confidence, key, bibtex) for rows of strings that are a DOI, an arXiv id or a title."""
    kind = query_kind(F.col("query"))
    doi = F.when(kind == "doi", normalize_doi(F.col("query"))).when(kind == "arxiv", F.concat(F.lit("10.48550/arxiv."), normalize_arxiv(F.col("query"))))
    none = F.lit(None).cast("string")
    asked = queries.select(F.col("query").alias("bib_id"), F.lit(0).alias("ord"), none.alias("key"), F.lit("").alias("entry_type"), F.when(kind == "title", F.col("query")).alias("title"), none.alias("subtitle"), F.lit(None).cast(PEOPLE).alias("authors"), F.lit(None).cast("int").alias("year"), none.alias("venue"), none.alias("volume"), none.alias("issue"), F.lit(None).cast("struct<start:string,end:string>").alias("pages"), none.alias("publisher"), doi.alias("doi"), none.alias("arxiv_id"), F.lit("other").alias("kind"))
    found = resolve(asked.select("*", title_keys("title").alias("title_key"), venue_keys("venue").alias("venue_key")), works).filter("outcome = 'found'")
    keyed = found.select(*found.columns, ascii_text(F.get("known.authors", F.lit(0))["family"]).alias("_f"), ascii_text("known.title").alias("_t"))
    named = keyed.withColumn("key", suggest_key(F.col("_f"), F.col("known.year"), F.col("_t")))
    shown = export.render_entries(named).select("bib_id", "text")
    out = named.select("bib_id", "key", "confidence").join(shown, "bib_id", "left")
    rows = queries.select("query").distinct().join(out, F.col("query") == F.col("bib_id"), "left")
    return rows.select("query", F.when(F.col("bib_id").isNull(), "not_found").otherwise("found").alias("outcome"), "confidence", "key", F.col("text").alias("bibtex"))
