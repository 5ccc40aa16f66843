"""Stations on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import check_tile_size
from ..functions.grid import LAT_RANGE, LONG_RANGE, tile_centre, tile_id


def tile_stations(stations: DataFrame, tile_size: int) -> DataFrame:
    """Id, Tile_Id and the centre (Lat, Long) of the tile each station lies in."""
    check_tile_size(tile_size)
    lat, long = F.col("Lat"), F.col("Long")
    return stations.select(
        "Id",
        tile_id(lat, long, tile_size).alias("Tile_Id"),
        tile_centre(lat, LAT_RANGE, tile_size).alias("Lat"),
        tile_centre(long, LONG_RANGE, tile_size).alias("Long"),
    )


def tile_centres(tiled_stations: DataFrame) -> DataFrame:
    """Each tile that holds a station, once, with its centre."""
    return tiled_stations.select("Tile_Id", "Lat", "Long").distinct()
