"""Registry updates as a stream: which entries of which bibliographies a notice touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTICE = "doi string, type string, noticed_at timestamp"


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(NOTICE).parquet(path)


def daily_notices(notices: DataFrame, late: str = "7 days") -> DataFrame:
    """(window, type, n): notices per day and type; those later than ``late`` are dropped."""
    return notices.withWatermark("noticed_at", late).groupBy(F.window("noticed_at", "1 day"), "type").agg(F.count(F.lit(1)).alias("n"))


def fresh_notices(notices: DataFrame, late: str = "7 days") -> DataFrame:
    """Each (doi, type) once within the watermark, however often it is sent."""
    return notices.withWatermark("noticed_at", late).dropDuplicatesWithinWatermark(["doi", "type"])


def affected(entries: DataFrame, notices: DataFrame) -> DataFrame:
    """(bib_id, ord, key, doi, type, noticed_at) of entries that cite a noticed work; works for streams against a static table of entries."""
    return notices.join(entries.select("bib_id", "ord", "key", "doi"), "doi").select("bib_id", "ord", "key", "doi", "type", "noticed_at")


def watch(notices: DataFrame, entries: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run once over all notices that are there, batch by batch; ``sink`` gets the affected entries of each."""
    hit = affected(entries, fresh_notices(notices))
    return hit.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
