"""Bibliographies written out: BibTeX, JSON reports and plain-text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions.names import display_people
from refweave.functions.scalars import pages_key, present
from refweave.operators.project import FACTS
from refweave.schema import ENTRY_OF_KIND, STATUSES, lookup


def escaped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?<!\\)([&%$#_])", r"\\$1")


def bibtex_fields(facts, kind: Column) -> Column:
    """array<struct<name, value>> of what there is to say, in the usual order."""
    meeting, preprint = kind == "inproceedings", facts("arxiv_id").isNotNull() & (kind == "misc")
    title = F.when(facts("title").isNotNull(), F.concat_ws(": ", facts("title"), facts("subtitle")))
    arxiv = facts("arxiv_id")
    pairs = [
        (F.lit("title"), title), (F.lit("author"), present(display_people(facts("authors")))), (F.when(meeting, "booktitle").otherwise("journal"), F.when(~preprint, facts("venue"))),
        (F.lit("volume"), facts("volume")), (F.lit("number"), facts("issue")), (F.lit("pages"), F.replace(pages_key(facts("pages")), F.lit("-"), F.lit("--"))),
        (F.lit("year"), facts("year").cast("string")), (F.lit("publisher"), F.when(kind.isin("book", "techreport"), facts("publisher"))), (F.lit("doi"), facts("doi")),
        (F.lit("eprint"), arxiv), (F.lit("archiveprefix"), F.when(arxiv.isNotNull(), "arXiv")),
    ]
    listed = F.array(*[F.struct(n.alias("name"), v.alias("value")) for n, v in pairs])
    return F.filter(listed, lambda x: x["value"] != "")


def render_entries(resolved: DataFrame) -> DataFrame:
    """(bib_id, ord, text): the registry's facts where an entry resolved, else what was read, marked as such."""
    known = (F.col("outcome") == "found") & F.col("known").isNotNull()
    picked = resolved.select("bib_id", "ord", "key", "entry_type", known.alias("sure"), *[F.when(known, F.col(f"known.{f}")).otherwise(F.col(f)).alias(f) for f in FACTS])
    mapped = lookup(ENTRY_OF_KIND, F.col("kind"), "misc")
    kind = F.when((mapped == "misc") & F.col("arxiv_id").isNull() & (F.col("entry_type") != ""), F.col("entry_type")).otherwise(mapped)
    rows = picked.withColumn("out_type", kind).withColumn("pairs", bibtex_fields(F.col, F.col("out_type"))).filter(F.size("pairs") > 0)
    width = F.array_max(F.transform("pairs", lambda x: F.length(x["name"])))
    lines = F.transform("pairs", lambda x: F.concat(F.lit("  "), F.rpad(x["name"], F.col("width"), F.lit(" ")), F.lit(" = {"), escaped(x["value"]), F.lit("}")))
    note = F.when(F.col("sure"), "").otherwise("% unverified: this entry could not be resolved, and is as-read\n")
    text = F.concat(note, F.lit("@"), "out_type", F.lit("{"), "key", F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return rows.withColumn("width", width).select("bib_id", "ord", text.alias("text"))


def to_bibtex(resolved: DataFrame, header: str | None = None) -> DataFrame:
    """(bib_id, text): one BibTeX file per bibliography."""
    top = "" if not header else "\n".join(f"% {line}" for line in header.splitlines()) + "\n\n"
    blocks = render_entries(resolved).groupBy("bib_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return blocks.select("bib_id", F.concat(F.lit(top), F.array_join(F.transform("b", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


def report_json(reports: DataFrame, crosschecks: DataFrame | None = None, parse_problems: DataFrame | None = None) -> DataFrame:
    """(bib_id, json): a report per bibliography. Findings leave out what they do not say; entries always have a line."""
    own = F.transform("problems", lambda p: F.to_json(p))
    quoted = lambda c: F.coalesce(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), F.lit("{}"))
    value = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"x":(.*)\}$', 1)
    entry = F.concat(
        F.lit('{"key":'), value(F.col("key")), F.lit(',"entry_type":'), value(F.col("entry_type")), F.lit(',"status":"'), "status", F.lit('","line":'), F.coalesce(F.col("line").cast("string"), F.lit("null")),
        F.lit(',"problems":['), F.array_join(own, ","), F.lit("]}"),
    )
    rows = reports.groupBy("bib_id").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))).alias("es"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    if crosschecks is not None:
        rows = rows.join(crosschecks.select("bib_id", F.to_json(F.struct("uncited", "undefined")).alias("cc")), "bib_id", "left")
    else:
        rows = rows.withColumn("cc", F.lit(None).cast("string"))
    if parse_problems is not None:
        names = ("code", "severity", "message", "field", "local", "authoritative", "confidence", "url")
        ps = parse_problems.groupBy("bib_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*names)).alias("j")))), lambda x: x["j"]).alias("ps"))
        rows = rows.join(ps, "bib_id", "left")
    else:
        rows = rows.withColumn("ps", F.array().cast("array<string>"))
    tally = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{s}":'), F.col(s).cast("string")) for s in STATUSES]), F.lit("}"))
    text = F.concat(
        F.lit('{"bib_path":'), value(F.col("bib_id")), F.lit(',"summary":'), tally, F.lit(',"entries":['), F.array_join(F.transform("es", lambda x: x["e"]), ","),
        F.lit('],"parse_problems":['), F.coalesce(F.array_join("ps", ","), F.lit("")), F.lit('],"crosscheck":'), F.coalesce("cc", F.lit("null")), F.lit("}"),
    )
    return rows.select("bib_id", text.alias("json"))


GLYPHS = {"ok": "✓", "warn": "!", "critical": "✗", "unresolved": "?", "network_error": "…"}
TALLY = (("critical", "critical"), ("warn", "warn"), ("unresolved", "unresolved"), ("network_error", "error"), ("ok", "ok"))


def report_text(reports: DataFrame, show_ok: bool = True) -> DataFrame:
    """(bib_id, text): a line per entry with its findings below it, then a tally; without ``show_ok`` only entries with something to say."""
    detail = lambda p: F.concat(
        F.lit("    "), F.rpad(p["code"], F.lit(24), F.lit(" ")), F.lit(" "), p["message"],
        F.when(p["code"].endswith("_mismatch"), F.concat(F.lit(": "), p["local"], F.lit(" → "), p["authoritative"])).otherwise(
            F.concat(F.coalesce(F.concat(F.lit(": "), p["local"]), F.lit("")), F.coalesce(F.concat(F.lit(" (confidence "), p["confidence"].cast("string"), F.lit(")")), F.lit("")))
        ),
    )
    mark = F.lit(None).cast("string")
    for s, g in GLYPHS.items():
        mark = F.when(F.col("status") == s, g).otherwise(mark)
    line = F.concat(F.lit("  "), mark, F.lit(" "), F.rpad(F.left("key", F.lit(32)), F.lit(32), F.lit(" ")), F.lit(" "), "status")
    # Chosen within the aggregate: a filter on the verdict would send its whole expression through the optimizer's inferences.
    wanted = F.lit(True) if show_ok else F.col("status") != "ok"
    rows = F.when(wanted, F.struct("ord", F.concat_ws("\n", F.array(line), F.transform("problems", detail)).alias("lines")))
    body = reports.groupBy("bib_id").agg(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["lines"]).alias("ls"))
    counts = reports.groupBy("bib_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("n"))
    tally = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {name}"))) for s, name in TALLY])
    return counts.join(body, "bib_id", "left").select("bib_id", F.concat("bib_id", F.lit(": "), F.col("n").cast("string"), F.lit(" entries\n"), F.coalesce(F.array_join("ls", "\n"), F.lit("")), F.lit("\n"), tally, F.lit("\n")).alias("text"))
