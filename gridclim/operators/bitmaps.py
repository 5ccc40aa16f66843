"""Exact distinct counts that can be stored and added to: bitmaps of days and of stations.

A tile and year has one bit for each day with a record, and one for each station that reports.
Bitmaps are made in one grouping, combined before they move, and tables of them can be put together
and merged again, so that new files touch only their own years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["Tile_Id", "Year"]


def numbered_stations(tiled_stations: DataFrame) -> DataFrame:
    """The station list with a number that is unique within the tile, which is all that a count per
    tile needs. The grid's largest tile is what a task sorts."""
    in_tile = Window.partitionBy("Tile_Id").orderBy("Id")
    return tiled_stations.withColumn("number", F.row_number().over(in_tile).cast("bigint"))


def day_bitmaps(days: DataFrame) -> DataFrame:
    """Tile_Id, Year, days: the days of the year with any record. A date that is no day has none."""
    day = F.dayofyear(F.try_to_date("Date", "yyyyMMdd")).cast("bigint")
    known = days.select(*KEYS, day.alias("day")).where(F.col("day").isNotNull())
    return known.groupBy(*KEYS).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("day")).alias("days")
    )


def station_bitmaps(numbered: DataFrame) -> DataFrame:
    """Tile_Id, Year, part, stations: the numbers that report. A bitmap holds 32,768 of them; a tile
    with more has several parts."""
    return numbered.groupBy(*KEYS, F.bitmap_bucket_number("number").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("stations")
    )


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Tables of bitmaps that were put together, one row per key again."""
    column = "days" if "days" in bitmaps.columns else "stations"
    keys = [name for name in bitmaps.columns if name != column]
    return bitmaps.groupBy(*keys).agg(F.bitmap_or_agg(column).alias(column))


def days_counted(bitmaps: DataFrame) -> DataFrame:
    """``active_days_per_year`` from merged bitmaps, without another shuffle."""
    return bitmaps.select(*KEYS, F.bitmap_count("days").alias("Count"))


def stations_counted(bitmaps: DataFrame) -> DataFrame:
    """``station_counts`` from merged bitmaps."""
    return bitmaps.groupBy("Year", "Tile_Id").agg(
        F.sum(F.bitmap_count("stations")).alias("Station_count")
    )
