"""From stations to tiles: one value per day, tile and element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MEAN_ELEMENTS, STORM
from ..functions.elements import fold_storms
from .lookups import lookup_join

SUMS = ("n", "n_value", "sum_value")


def observation_facts(accepted: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """One row per accepted observation in a form that can be summed in any number of steps; the
    columns of ``also`` stay."""
    kept = [c for c in ("Station", "Year", "Date", "Tile_Id") if c in accepted.columns]
    return accepted.select(
        *kept,
        *also,
        fold_storms(F.col("Element")).alias("Element"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("Value").isNotNull().cast("bigint").alias("n_value"),
        F.col("Value").cast("bigint").alias("sum_value"),
    )


def facts_on_tiles(
    facts: DataFrame, tiled_stations: DataFrame, broadcast: bool, also: Sequence[str] = ()
) -> DataFrame:
    """Facts with the tile of their station, apart by the columns of ``also``; unknown stations drop
    out.

    A station list that can be broadcast (``fits_broadcast``) meets the rows where they are read.
    A longer list needs a shuffle by station; there the rows are first summed per station, day and
    element, so that a station with very many records is small before it moves."""
    stations = tiled_stations.select(F.col("Id").alias("Station"), "Tile_Id")
    if not broadcast:
        facts = facts.groupBy("Station", "Year", "Date", "Element", *also).agg(*_sums())
    return lookup_join(facts, stations, ["Station"], ["Date"], broadcast, salts=1)


def daily_from_facts(facts: DataFrame) -> DataFrame:
    """Daily tile values from facts on tiles, reading them once.

    One grouping yields both the sums per day, tile and element and the distinct stations per
    year and tile; they combine before the shuffle, whatever the size of a tile. The stations
    are then counted (again before a shuffle), and the count joins the days of its tile and year
    in a window that holds little more than three rows per day of the year."""
    return _daily(summed_facts(facts))


DAYS = ["Year", "Tile_Id", "Date", "Element"]


def summed_facts(facts: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Facts summed per day, tile and element, and the distinct stations per year and tile, both
    apart by the columns of ``also``. Rows of the second kind have a station and no element, the
    first ones the other way round. Tables of this form can be put together and summed again."""
    sets = [[*DAYS, *also], ["Year", "Tile_Id", "Station", *also]]
    return (
        facts.where(F.col("Tile_Id").isNotNull() & F.col("Year").isNotNull())
        .groupingSets([[F.col(c) for c in s] for s in sets], *DAYS, "Station", *also)
        .agg(*_sums())
    )


def daily_from_sums(sums: DataFrame) -> DataFrame:
    """Daily tile values from tables of ``summed_facts`` that were put together."""
    return _daily(sums.groupBy(*DAYS, "Station").agg(*_sums()))


def _daily(sums: DataFrame) -> DataFrame:
    counted = sums.groupBy(*DAYS).agg(*_sums(), F.count("Station").alias("stations"))
    in_tile_year = Window.partitionBy("Year", "Tile_Id")
    storm_rate = F.col("n") / F.col("Station_count")
    value = F.when(F.col("Element") == STORM, storm_rate).otherwise(_mean())
    return (
        counted.withColumn("Station_count", F.max("stations").over(in_tile_year))
        .where(F.col("Element").isNotNull())
        .select("Year", "Date", "Element", "Tile_Id", value.alias("Value"))
    )


def daily_tile_values(tiled: DataFrame) -> DataFrame:
    """Mean precipitation and temperature and the storm rate, per day and tile."""
    return daily_from_facts(observation_facts(tiled))


def daily_tile_mean(tiled: DataFrame) -> DataFrame:
    """Mean precipitation and temperature per day and tile."""
    wanted = F.col("Element").isin(*MEAN_ELEMENTS) & F.col("Tile_Id").isNotNull()
    return (
        tiled.where(wanted)
        .groupBy("Year", "Date", "Element", "Tile_Id")
        .agg(F.avg("Value").alias("Value"))
    )


def daily_storm_rate(tiled: DataFrame) -> DataFrame:
    """Storm records per reporting station; a day without storm records has no row. Stations
    count with whatever they report, so all elements are read."""
    return daily_tile_values(tiled).where(F.col("Element") == STORM)


def station_tiles(tiled: DataFrame) -> DataFrame:
    """Each station that reports in a year, once per tile and year."""
    return tiled.select("Year", "Tile_Id", "Station").distinct()


def station_counts(tiled: DataFrame) -> DataFrame:
    """Number of reporting stations per tile and year. Distinct first, then a plain count, so
    that no task ever holds the stations of a whole tile."""
    return station_tiles(tiled).groupBy("Year", "Tile_Id").agg(
        F.count(F.lit(1)).alias("Station_count")
    )


def with_station_count(
    tiled: DataFrame, counts: DataFrame, broadcast: bool = False
) -> DataFrame:
    """Every observation with the station count of its tile and year, without its station.

    ``counts`` comes from ``station_counts`` and is best stored first (``keep_stage``).
    ``broadcast`` is for counts that were found to fit (``fits_broadcast``); else the join salts
    its keys."""
    return lookup_join(
        tiled.drop("Station"), counts, ["Year", "Tile_Id"], ["Date", "Element", "Value"], broadcast
    )


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def _mean() -> Column:
    return F.try_divide(F.col("sum_value").cast("double"), F.col("n_value"))
