"""The wide table: nine measures per tile and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SEGMENTS, TILE_ELEMENTS
from ..functions.calendar import in_segment
from ..functions.grid import centre_of_tile_id
from .lookups import full_join_list


def wide_table(daily_anomalies: DataFrame) -> DataFrame:
    """All nine means in one grouping; a missing combination is NULL."""
    cells = [
        F.avg(
            F.when((F.col("Element") == element) & in_segment(F.col("MonthDay"), segment),
                   F.col("Value"))
        ).alias(f"{element}_{segment}")
        for segment in SEGMENTS
        for element in TILE_ELEMENTS
    ]
    return daily_anomalies.groupBy("Year", "Tile_Id").agg(*cells)


def spread_segment(means: DataFrame, segment: str) -> DataFrame:
    """The elements of one time segment as columns ``<element>_<segment>``."""
    spread = (
        means.where(F.col("segment") == segment)
        .groupBy("Year", "Tile_Id")
        .pivot("Element", list(TILE_ELEMENTS))
        .agg(F.first("Value"))
    )
    return spread.select(
        "Year", "Tile_Id", *[F.col(e).alias(f"{e}_{segment}") for e in TILE_ELEMENTS]
    )


def wide_from_segments(means: DataFrame) -> DataFrame:
    """The wide table from long segment means: one pivot per segment, then a full join."""
    return full_join_list([spread_segment(means, s) for s in SEGMENTS], ["Year", "Tile_Id"])


def attach_centres(wide: DataFrame, centres: DataFrame) -> DataFrame:
    """Tile centres by lookup; a tile without a centre keeps its row."""
    return wide.join(centres, "Tile_Id", "left")


def with_centres(wide: DataFrame, tile_size: int) -> DataFrame:
    """Tile centres computed from the tile id; equal to the lookup, without a join."""
    lat, long = centre_of_tile_id(F.col("Tile_Id"), tile_size)
    return wide.withColumns({"Lat": lat, "Long": long})
