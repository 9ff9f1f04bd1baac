"""Audit of event rates against limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.shapes import sliding_count

# Limits as (rows, seconds).
OVERALL_LIMIT = (28, 1)
GROUP_LIMIT = (18, 60)
SOURCE_LIMIT = (8, 1)


def rate_audit(df: DataFrame, max_rows: int, period_seconds: int, by: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """Times at which the window ``[t - period, t]`` holds more rows than allowed."""
    stamped = df.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    counts = sliding_count(stamped, "_us", period_seconds * 1_000_000, by)
    return counts.filter(F.col("in_window") > max_rows).select(
        *by, F.timestamp_micros("_us").alias("at"), "at_time", "in_window")
