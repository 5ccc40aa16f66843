"""From raw observations to observations on tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import is_accepted
from ..sources.observations import with_year
from .lookups import lookup_join


def accepted_observations(observations: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Quality-checked records of the wanted elements; only the columns that are used later, and
    those of ``also``."""
    return (
        with_year(observations)
        .where(is_accepted(F.col("Element"), F.col("QFlag")))
        .select("Station", "Date", "Element", "Value", "Year", *also)
    )


def tiled_observations(
    observations: DataFrame,
    tiled_stations: DataFrame,
    broadcast: bool = False,
) -> DataFrame:
    """Accepted observations with the tile of their station; unknown stations drop out.

    ``broadcast`` is for a station list that was found to fit (``fits_broadcast``)."""
    return lookup_join(
        accepted_observations(observations),
        tiled_stations.withColumnRenamed("Id", "Station"),
        ["Station"],
        spread_by=["Date", "Element", "Value"],
        broadcast=broadcast,
    )


def unknown_station_audit(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations that report but are not in the list, with their number of accepted records.
    Counts first, so that the anti-join sees one row per station."""
    per_station = accepted_observations(observations).groupBy("Station").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_station.join(stations.select(F.col("Id").alias("Station")), "Station", "left_anti")
