"""Fares from a stream of reports. Batch and stream share the aggregate of operators.matching but for the median, which a stream can't keep exactly in bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fare_windows(reports: DataFrame, window: str = "1 hour", late: str = "2 hours", distinct: bool = False) -> DataFrame:
    """(route_id, start, n_reports, n_confirmed, latest) by event-time window; reports over `late` behind the newest are dropped and their state is freed.

    reports: (route_id, fare, confirmed, ts, report_id); works on a stream in append mode and on a table. distinct: reports that repeat an id count once, on a
    stream those within the watermark.
    """
    known = reports.withWatermark("ts", late) if reports.isStreaming else reports
    if distinct:
        known = known.dropDuplicatesWithinWatermark(["report_id"]) if reports.isStreaming else known.dropDuplicates(["report_id"])
    grouped = known.groupBy("route_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n_reports"), F.count_if("confirmed").alias("n_confirmed"), F.max_by("fare", F.struct("ts", "report_id")).alias("latest"))
    return grouped.select("route_id", F.col("w.start").alias("start"), "n_reports", "n_confirmed", "latest")
