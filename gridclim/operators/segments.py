"""Year, summer and winter half-year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import segments_of


def with_segments(daily: DataFrame) -> DataFrame:
    """Each row once per time segment it belongs to."""
    return daily.withColumn("segment", F.explode(segments_of(F.col("MonthDay"))))


def segment_means(daily_anomalies: DataFrame) -> DataFrame:
    """Mean anomaly per year, tile, element and time segment."""
    return (
        with_segments(daily_anomalies)
        .groupBy("Year", "Tile_Id", "segment", "Element")
        .agg(F.avg("Value").alias("Value"))
    )
