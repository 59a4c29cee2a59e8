"""Corrections that are safe to make, and their splicing into the source text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed choices: fields that the registry may correct, fields that need no registry, and how sure a DOI must be.
FROM_REGISTRY = {"year_mismatch": "year", "volume_mismatch": "volume", "pages_mismatch": "pages"}
LOCAL = {"case_protection": "title", "suspect_pages": "pages"}
DOI_FROM = 0.95

FIX = "bib_id string, ord int, key string, field string, old string, new string, added boolean"


def bibtex_value(field: Column, value: Column) -> Column:
    return F.when(field == "pages", F.regexp_replace(F.trim(value), r"\s*-{1,3}\s*", "--")).otherwise(value)


def _remedies(rows: DataFrame) -> DataFrame:
    """Corrections of problem rows that know their entry's key, doi, outcome, sure, found_doi and whether it is ``critical``."""
    open_ = (F.col("outcome") == "found") & ~F.col("critical")
    remedy = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    local = F.when((F.col("severity") != "info") & (F.col("authoritative") != ""), F.element_at(remedy(LOCAL), F.col("code")))
    known = F.when(open_ & (F.col("sure") >= 1.0) & F.col("authoritative").isNotNull(), F.element_at(remedy(FROM_REGISTRY), F.col("code")))
    picked = rows.select("bib_id", "ord", "key", F.coalesce(known, local).alias("field"), F.col("local").alias("old"), "authoritative", F.struct(known.isNotNull(), "rule_ord", "seq").alias("rank")).filter("field is not null")
    best = picked.groupBy("bib_id", "ord", "key", "field").agg(F.max_by(F.struct("old", "authoritative"), "rank").alias("b"))
    return best.select("bib_id", "ord", "key", "field", "b.old", bibtex_value(F.col("field"), F.col("b.authoritative")).alias("new"), F.lit(False).alias("added"))


def _additions(entries: DataFrame) -> DataFrame:
    open_ = (F.col("outcome") == "found") & ~F.col("critical")
    added = entries.filter(open_ & F.col("doi").isNull() & F.col("found_doi").isNotNull() & (F.col("sure") >= DOI_FROM))
    return added.select("bib_id", "ord", "key", F.lit("doi").alias("field"), F.lit(None).cast("string").alias("old"), F.col("found_doi").alias("new"), F.lit(True).alias("added"))


STATE = ("bib_id", "ord", "key", "doi", "outcome")


def plan_fixes(resolved: DataFrame, problems: DataFrame) -> DataFrame:
    """(bib_id, ord, key, field, old, new, added): at most one correction per field, the registry's before a local one.

    An entry with a critical finding only gets local ones; fields are corrected
    from the registry on a certain match, and a missing DOI is added on a near-certain one.
    """
    state = problems.groupBy("bib_id", "ord").agg(F.bool_or(F.col("severity") == "critical").alias("_c"))
    entries = resolved.select(*STATE, F.col("confidence").alias("sure"), F.col("known.doi").alias("found_doi")).join(state, ["bib_id", "ord"], "left")
    entries = entries.withColumn("critical", F.coalesce("_c", F.lit(False))).drop("_c")
    return _remedies(problems.join(entries, ["bib_id", "ord"])).union(_additions(entries))


def plan_row_fixes(rows: DataFrame) -> DataFrame:
    """As ``plan_fixes``, of entries that carry their ``findings`` (see ``rules.with_findings``): one pass, no join."""
    critical = F.exists("findings", lambda f: f["p"]["severity"] == "critical")
    entries = rows.select(*STATE, F.col("confidence").alias("sure"), F.col("known.doi").alias("found_doi"), critical.alias("critical"), "findings")
    found = entries.withColumn("f", F.explode_outer("findings")).filter("f is not null").select(*STATE, "sure", "found_doi", "critical", "f.rule_ord", "f.seq", "f.p.*")
    return _remedies(found).union(_additions(entries))


def describe(fixes: DataFrame) -> DataFrame:
    """``fixes`` with a line of text each."""
    text = F.when(F.col("added"), F.concat("key", F.lit(": added "), "field", F.lit(" = "), "new")).otherwise(F.concat("key", F.lit(": "), "field", F.lit(" "), F.coalesce("old", F.lit("None")), F.lit(" → "), "new"))
    return fixes.withColumn("text", text)


def value_end(text: str, at: int) -> tuple[int | None, str, str]:
    """(end of the value at ``at``, what opens it, what closes it); no end if it never closes."""
    if at < len(text) and text[at] == "{":
        depth = 0
        for m in re.compile("[{}]").finditer(text, at):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.end(), "{", "}"
        return None, "{", "}"
    if at < len(text) and text[at] == '"':
        m = re.compile(r'(?<!\\)"').search(text, at + 1)
        return (m.end() if m else None), '"', '"'
    return (re.compile(r"[^,\n}]*").match(text, at).end() if at < len(text) else None), "", ""


def edited(block: str, field: str, new: str, added: bool) -> str | None:
    """``block`` with one field changed or added in its own style; None where it cannot be found."""
    m = re.search(rf"(?im)^[ \t]*{re.escape(field)}[ \t]*=[ \t]*", block)
    if m:
        end, left, right = value_end(block, m.end())
        return None if end is None else f"{block[: m.end()]}{left}{new}{right}{block[end:]}"
    model = re.search(r"(?im)^([ \t]*)([A-Za-z][\w-]*)([ \t]*)=([ \t]*)", block)
    close = block.rfind("}")
    if not added or not model or close < 0:
        return None
    room = max(1, len(model[2]) + len(model[3]) - len(field))
    head = block[:close].rstrip()
    comma = "" if head.endswith(",") else ","
    return f"{head}{comma}\n{model[1]}{field}{' ' * room}={model[4]}{{{new}}}\n{block[close:]}"


def splice(text: str, starts: list[tuple[str, int]], fixes: list[tuple[str, str, str, bool]]) -> tuple[str, list[tuple[str, str]]]:
    """(new text, applied (key, field)): an entry reaches from its start line to that of the next."""
    offsets = [m.start() for m in re.finditer(r"(?m)^", text)] or [0]
    begin = sorted(((offsets[min(line, len(offsets)) - 1], key) for key, line in starts))
    stops = [b for b, _ in begin[1:]] + [len(text)]
    wanted: dict[str, list] = {}
    for key, field, new, added in fixes:
        wanted.setdefault(key, []).append((field, new, added))
    out, applied, last = [], [], 0
    for (at, key), stop in zip(begin, stops):
        block = text[at:stop]
        for field, new, added in wanted.get(key, ()):
            changed = edited(block, field, new, added)
            if changed is not None:
                block = changed
                applied.append((key, field))
        out += [text[last:at], block]
        last = stop
    return "".join(out) + text[last:], applied


def apply_fixes(files: DataFrame, entries: DataFrame, fixes: DataFrame) -> DataFrame:
    """(bib_id, text, applied): each file of ``files`` (bib_id, text) with its corrections; files without any are absent.

    One file is one row of work; its size bounds the memory that is needed.
    """
    starts = entries.filter("start_line is not null").groupBy("bib_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "key"))).alias("starts"))
    todo = fixes.groupBy("bib_id").agg(F.array_sort(F.collect_list(F.struct("ord", "field", "key", "new", "added"))).alias("fixes"))

    def run(batches):
        for batch in batches:
            rows = []
            for bib_id, text, starts, fixes in zip(batch["bib_id"], batch["text"], batch["starts"], batch["fixes"]):
                new, applied = splice(text or "", [(s["key"], s["start_line"]) for s in starts], [(f["key"], f["field"], f["new"], f["added"]) for f in fixes])
                rows.append((bib_id, new, [f"{k}: {f}" for k, f in applied]))
            yield pd.DataFrame(rows, columns=["bib_id", "text", "applied"])

    return files.join(todo, "bib_id").join(starts, "bib_id").select("bib_id", "text", "starts", "fixes").mapInPandas(run, "bib_id string, text string, applied array<string>")


def write_fixed(source: str, target: str, text: str, force: bool = False) -> None:
    """Write corrected text on the driver, never over its source and over another file only with ``force``."""
    from pathlib import Path

    a, b = Path(source).resolve(), Path(target).resolve()
    if a == b:
        raise ValueError("corrections go to another file than the one they were read from")
    if b.exists() and not force:
        raise FileExistsError(f"{b} exists; force overwrites it")
    b.parent.mkdir(parents=True, exist_ok=True)
    b.write_text(text, encoding="utf-8")
