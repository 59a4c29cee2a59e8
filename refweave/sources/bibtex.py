"""BibTeX files as entry rows and problem rows.

A small scanner reads ``@type{key, name = value, ...}`` with braced, quoted, bare
and ``#``-joined values, resolves ``@string`` names and skips comments and
preambles. It never fails: a block that does not close is reported and the scan
goes on at the next line that opens a block.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.schema import ENTRY, FILE_PROBLEM

_OPEN = re.compile(r"(?m)^[ \t]*@[ \t]*([A-Za-z][\w-]*)[ \t]*([{(])")
_NAME = re.compile(r"\s*([^\s=,{}\"#()]+)\s*=\s*")
_KEY = re.compile(r"\s*([^,{}\"]*?)\s*(?=[,})])")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


class Unclosed(Exception):
    pass


def _balanced(text: str, at: int, stop: int) -> int:
    """The place behind the brace that closes the one at ``at``; backslashed braces do not count."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.DOTALL).finditer(text, at, stop):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return m.end()
    raise Unclosed("a value is not closed")


def _quoted(text: str, at: int, stop: int) -> int:
    depth = 0
    for m in re.compile(r"\\.|[{}\"]", re.DOTALL).finditer(text, at + 1, stop):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == '"' and depth <= 0:
            return m.end()
    raise Unclosed("a quoted value is not closed")


def _value(text: str, at: int, stop: int, names: dict[str, str]) -> tuple[str, int]:
    """A value and the place behind it: parts joined by #."""
    parts = []
    while True:
        while at < stop and text[at].isspace():
            at += 1
        if at >= stop:
            raise Unclosed("a field has no value")
        if text[at] == "{":
            end = _balanced(text, at, stop)
            parts.append(text[at + 1 : end - 1])
        elif text[at] == '"':
            end = _quoted(text, at, stop)
            parts.append(text[at + 1 : end - 1])
        else:
            m = re.compile(r"[^\s,#})]*").match(text, at, stop)
            end = m.end()
            parts.append(names.get(m[0].lower(), m[0]))
        rest = re.compile(r"\s*#").match(text, end, stop)
        if not rest:
            return "".join(parts), end
        at = rest.end()


def _fields(text: str, at: int, stop: int, close: str, names: dict[str, str]) -> list[tuple[str, str]]:
    out = []
    while True:
        m = re.compile(r"[\s,]*").match(text, at, stop)
        at = m.end()
        if at >= stop:
            raise Unclosed("an entry is not closed")
        if text[at] == close:
            return out
        m = _NAME.match(text, at, stop)
        if not m:
            raise Unclosed(f"no field at {text[at : at + 20]!r}")
        value, at = _value(text, m.end(), stop, names)
        out.append((m[1], value))


def scan_text(text: str) -> tuple[list[dict], list[dict]]:
    """(entries, problems) of one file in block order; the first definition of a key and of a field wins."""
    lines = [m.start() for m in re.finditer(r"(?m)^", text)]
    opens = list(_OPEN.finditer(text))
    names, seen, entries, problems = {}, set(), [], []
    done = 0
    for k, m in enumerate(opens):
        if m.start() < done:
            continue  # inside a value that closed properly
        kind, close = m[1].lower(), "}" if m[2] == "{" else ")"
        limits = [o.start() for o in opens[k + 1 :]] + [len(text)]
        line = bisect_right(lines, m.start(1) - 1)
        if kind in ("comment", "preamble"):
            try:
                done = _balanced(text, m.end() - 1, len(text)) if close == "}" else done
            except Unclosed:
                pass
            continue
        if kind == "string":
            try:
                name = _NAME.match(text, m.end(), limits[0])
                if name:
                    names[name[1].lower()], done = _value(text, name.end(), limits[0], names)
            except Unclosed:
                pass
            continue
        key = ""
        try:
            if not (head := _KEY.match(text, m.end(), limits[0])):
                raise Unclosed("an entry has no key")
            key = head[1]
            found = _fields(text, head.end(), limits[0], close, names)
        except Unclosed as reason:
            first = text[m.start() : limits[0]].strip().split("\n")[0].strip()
            problems.append(dict(code="malformed_entry", severity="warn", message=f"{reason} (starting at {first[:60]!r})", local=f"line {line}"))
            continue
        if key in seen:
            problems.append(dict(code="duplicate_key", severity="warn", message=f"citation key {key!r} is defined more than once (line {line}); the first definition is used", local=key))
            continue
        seen.add(key)
        values: dict[str, str] = {}
        order = []
        for name, value in found:
            low = name.lower()
            if low in values:
                problems.append(dict(code="duplicate_field", severity="warn", message=f"field {low!r} appears more than once; the first value is used", field=low, local=values[low], authoritative=value))
            else:
                values[low] = value
                order.append(name)
        entries.append(dict(key=key, entry_type=kind, fields=values, field_order=order, start_line=line))
    return entries, problems


def decoded(content):
    """UTF-8 where it is that, Latin-1 otherwise."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(bib_id, text) of the files under ``path``; the path names the bibliography."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("bib_id"), decoded(F.col("content")).alias("text"))


_ROWS = f"kind string, {ENTRY}, seq int, code string, severity string, message string, field string, local string, authoritative string, confidence double, url string"


def parse(files: DataFrame) -> DataFrame:
    """Entry rows (kind "entry") and problem rows (kind "problem") of ``files`` (bib_id, text); null texts are empty."""
    columns = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for bib_id, text in zip(batch["bib_id"], batch["text"]):
                entries, problems = scan_text(text or "")
                rows += [dict(kind="entry", bib_id=bib_id, ord=i, source=bib_id, **e) for i, e in enumerate(entries)]
                rows += [dict(kind="problem", bib_id=bib_id, seq=i, **p) for i, p in enumerate(problems)]
            frame = pd.DataFrame(rows, columns=columns).astype(object)
            yield frame.where(frame.notna(), None)

    return files.select("bib_id", "text").mapInPandas(run, _ROWS)


def entries_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'entry'").select(*[x.split()[0] for x in ENTRY.split(", ")])


def problems_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'problem'").select(*[x.split()[0] for x in FILE_PROBLEM.split(", ")])
