"""The response ledger: what was asked, when, and what came back.

A row is (namespace, identifier, status, fetched_at, payload). Answers and
refusals (404) are kept; failures of the server never are, so that they cannot
hide an answer for as long as the ledger remembers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_DAYS = 30


def ledger_key(namespace: Column, identifier: Column) -> Column:
    return F.concat_ws("/", namespace, F.sha2(identifier, 256))


def storable(status: Column) -> Column:
    return status.between(200, 299) | (status == 404)


def latest(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The last storable response per key; ``tie`` breaks equal times. One aggregate, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("fetched_at", tie))
    return rows.filter(storable(F.col("status"))).groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def look_up(rows: DataFrame, now: Column, keys: list[str], tie: str, ttl_days: int = TTL_DAYS, offline: bool = False) -> DataFrame:
    """``latest`` with outcome (found, not_found, or miss where it has expired) and stale; offline, what has expired is served."""
    expired = F.col("fetched_at") + F.make_dt_interval(days=F.lit(ttl_days)) < now
    miss = expired & F.lit(not offline)
    out = latest(rows, keys, tie)
    return out.withColumn("outcome", F.when(miss, "miss").when(F.col("status") == 404, "not_found").otherwise("found")).withColumn("stale", expired & ~miss)


def append(rows: DataFrame, path: str) -> None:
    """Add storable responses to the ledger at ``path``, dealt by namespace and the first two digits of the key's digest."""
    keyed = rows.filter(storable(F.col("status"))).withColumn("shard", F.left(F.sha2("identifier", 256), F.lit(2)))
    keyed.write.mode("append").partitionBy("namespace", "shard").parquet(path)
