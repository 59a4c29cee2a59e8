"""From findings to a verdict per entry and counts per bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.schema import PROBLEM_FIELDS, STATUSES, severity_rank

# Fixed orders: the most serious status first, which is not the order of a verdict.
WORST = ("critical", "network_error", "unresolved", "warn", "ok")
FAIL_ON = {
    "critical": ("critical",), "warn": ("critical", "warn"), "unresolved": ("unresolved",), "error": ("network_error",), "any": ("critical", "warn", "unresolved", "network_error"),
}


def status(failed: Column, worst: Column, resolved: Column) -> Column:
    """``worst`` is the highest severity rank, null without findings. A failed lookup outranks all; unresolved outranks warnings."""
    return F.when(failed, "network_error").when(worst == 2, "critical").when(~resolved, "unresolved").when(worst == 1, "warn").otherwise("ok")


def entry_reports(resolved: DataFrame, problems: DataFrame) -> DataFrame:
    """(bib_id, ord, key, entry_type, line, status, problems): findings in order, one row per entry."""
    names = [x.split()[0] for x in PROBLEM_FIELDS.split(", ")]
    listed = problems.groupBy("bib_id", "ord").agg(
        F.array_sort(F.collect_list(F.struct("rule_ord", "seq", F.struct(*names).alias("p")))).alias("ps"), F.max(severity_rank(F.col("severity"))).alias("worst")
    )
    rows = resolved.select("bib_id", "ord", "key", "entry_type", F.col("start_line").alias("line"), "outcome").join(listed, ["bib_id", "ord"], "left")
    kind = problems.select(F.struct(*names).alias("p")).schema["p"].dataType.simpleString()
    verdict = status(F.col("outcome").isin("network_error", "offline_miss"), F.col("worst"), F.col("outcome") == "found")
    return rows.select("bib_id", "ord", "key", "entry_type", "line", verdict.alias("status"), (F.col("outcome") == "found").alias("resolved"), F.coalesce(F.transform("ps", lambda x: x["p"]), F.array().cast(f"array<{kind}>")).alias("problems"))


def row_reports(rows: DataFrame) -> DataFrame:
    """As ``entry_reports``, of entries that carry their ``findings`` (see ``rules.with_findings``): no join, no shuffle."""
    worst = F.array_max(F.transform("findings", lambda f: severity_rank(f["p"]["severity"])))
    found = F.col("outcome") == "found"
    verdict = status(F.col("outcome").isin("network_error", "offline_miss"), worst, found)
    return rows.select("bib_id", "ord", "key", "entry_type", F.col("start_line").alias("line"), verdict.alias("status"), found.alias("resolved"), F.transform("findings", lambda f: f["p"]).alias("problems"))


def summary(reports: DataFrame) -> DataFrame:
    """A row per bibliography with the number of entries of each status, zeros included, and the worst status."""
    rank = F.array_position(F.array(*map(F.lit, WORST)), F.col("status"))
    return reports.groupBy("bib_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.min_by("status", rank).alias("worst_status"), F.count_if("resolved").alias("verified"))


def wanted(spec: str) -> list[str]:
    """The statuses that a comma list of ``FAIL_ON`` names stands for."""
    names = [x.strip() for x in spec.split(",") if x.strip()]
    unknown = [x for x in names if x not in FAIL_ON]
    if unknown:
        raise ValueError(f"unknown --fail-on value: {', '.join(unknown)}")
    return sorted({s for x in names for s in FAIL_ON[x]})


def fails(reports: DataFrame, spec: str) -> DataFrame:
    """(bib_id, fails): whether any entry has a status that ``spec`` asks for."""
    return reports.groupBy("bib_id").agg(F.coalesce(F.bool_or(F.col("status").isin(*wanted(spec))), F.lit(False)).alias("fails"))
