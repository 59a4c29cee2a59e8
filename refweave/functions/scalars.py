"""Years, volumes, page ranges and abbreviations as SQL expressions over display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = "(1[6-9][0-9]{2}|20[0-9]{2}|21[0-9]{2})"
PAGES = r"(?U)^\s*([A-Za-z]?\d+(?:\.\d+)?)(?:\s*(?:-{1,3}|–|—|‒|to)\s*([A-Za-z]?\d+(?:\.\d+)?))?\s*$"


def present(value: Column) -> Column:
    """Null for an empty string: absence is not disagreement."""
    return F.nullif(value, F.lit(""))


def stripped(value: Column) -> Column:
    """Without the white space on either side, of any kind."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def year_of(text: Column) -> Column:
    """The first run that reads as a year from 1600 to 2199, anywhere in the text."""
    return present(F.regexp_extract(text, YEAR, 1)).cast("int")


def volume_of(text: Column) -> Column:
    return F.coalesce(present(F.regexp_extract(text, r"(?U)(\d+)", 1)), present(stripped(text)))


def pages_of(text: Column) -> Column:
    """struct<start, end>, null if the text is no page range. An elided end takes the missing digits from the start."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    start, raw = F.regexp_extract(bare, PAGES, 1), present(F.regexp_extract(bare, PAGES, 2))
    short = (F.length(raw) < F.length(start)) & ~start.endswith(raw)
    end = F.when(short, F.concat(F.left(start, F.length(start) - F.length(raw)), raw)).otherwise(raw)
    return F.when(bare.rlike(PAGES), F.struct(start.alias("start"), end.alias("end")))


def pages_key(pages: Column) -> Column:
    return F.when(pages.isNotNull(), F.concat_ws("-", pages["start"], pages["end"]))


def looks_abbreviated(text: Column) -> Column:
    return text.rlike(r"(?U)\b[A-Za-z]{1,6}\.(?!\w)")
