"""Differences from the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_day_of


def anomalies(daily: DataFrame, baseline: DataFrame) -> DataFrame:
    """Daily tile value minus the baseline value of its calendar day. Days without a baseline
    value drop out. A key holds at most one row per year on the daily side, so no key is hot."""
    return (
        daily.withColumn("MonthDay", month_day_of(F.col("Date")))
        .join(baseline, ["MonthDay", "Element", "Tile_Id"])
        .select(
            "Year", "MonthDay", "Element", "Tile_Id",
            (F.col("Value") - F.col("Value_baseline")).alias("Value"),
        )
    )
