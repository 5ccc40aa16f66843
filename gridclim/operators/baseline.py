"""The baseline: a year of mean daily values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClimateConfig
from ..functions.calendar import month_day_of


def baseline_year(daily: DataFrame, config: ClimateConfig) -> DataFrame:
    """Mean of the daily tile values over the baseline years, per calendar day. 29 February is a
    day of its own."""
    in_span = F.col("Year").between(config.year_start_baseline, config.year_end_baseline)
    return (
        daily.where(in_span)
        .groupBy(month_day_of(F.col("Date")).alias("MonthDay"), "Element", "Tile_Id")
        .agg(F.avg("Value").alias("Value_baseline"))
    )


def baseline_tiles(baseline: DataFrame) -> DataFrame:
    return baseline.select("Tile_Id").distinct()


def stored_baseline(stored: DataFrame) -> DataFrame:
    """A baseline year that was saved in the form of daily values (``read_daily_values``)."""
    return stored.withColumnsRenamed({"Date": "MonthDay", "Value": "Value_baseline"})
