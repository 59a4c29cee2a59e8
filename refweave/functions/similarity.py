"""How alike two keys are, and how likely a candidate is the cited work."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))


def shared(a: Column, b: Column) -> Column:
    """Share of common words of two arrays of distinct words, from 0 to 1; 0 where both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def dice(left: Column, right: Column) -> Column:
    """``shared`` words of two keys. Each key is split once where it is used once; give arrays to ``shared`` to keep them."""
    return shared(tokens(left), tokens(right))


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def similarity(left: Column, right: Column, enough: float = 1.0) -> Column:
    """The better of the word share and the matching-blocks ratio.

    The ratio runs in Python. Where words alone reach ``enough`` it is not
    needed, and nulls are passed in its place, which cost nothing.
    """
    words = dice(left, right)
    settled = (left == "") | (right == "") | (left == right) | (words >= enough)
    text = lambda c: F.when(~settled, c)
    ratio = F.pandas_udf(_ratios, "double")(text(left), text(right))
    return F.when((left == "") | (right == "") | left.isNull() | right.isNull(), 0.0).when(left == right, 1.0).otherwise(F.greatest(words, F.coalesce(ratio, F.lit(0.0))))


def year_score(local: Column, known: Column) -> Column:
    gap = F.abs(local - known)
    return F.when(gap.isNull(), 0.5).when(gap == 0, 1.0).when(gap == 1, 0.7).when(gap == 2, 0.3).otherwise(0.0)


def author_score(local: Column, known: Column) -> Column:
    """1 for the same first author, else the share of local surnames that are known, 0.8 at most; 0.5 where either side has none."""
    keys = lambda people: F.array_distinct(F.filter(F.transform(people, lambda p: p["family_key"]), lambda k: k != ""))
    a, b = keys(local), keys(known)
    none = F.coalesce((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(True))
    first = F.get(local, F.lit(0))["family_key"]
    same = (first != "") & (first == F.get(known, F.lit(0))["family_key"])
    return F.when(none, 0.5).when(same, 1.0).otherwise(F.least(F.lit(0.8), F.size(F.array_intersect(a, b)) / F.size(a)))


def confidence(title: Column, authors: Column, year: Column) -> Column:
    return F.bround(0.60 * title + 0.25 * authors + 0.15 * year, 4)
