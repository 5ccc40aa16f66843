"""The latitude/longitude grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAT_RANGE = 90
LONG_RANGE = 180


def tile_index(coordinate: Column, half_range: int, tile_size: int) -> Column:
    """Row or column of the grid; floors, so that both sides of zero stay apart."""
    return F.floor((coordinate + F.lit(half_range)) / F.lit(tile_size)).cast("int")


def centre_of_index(index: Column, half_range: int, tile_size: int) -> Column:
    return (index * F.lit(tile_size) + F.lit(tile_size // 2 - half_range)).cast("int")


def tile_id(lat: Column, long: Column, tile_size: int) -> Column:
    return F.concat(
        tile_index(lat, LAT_RANGE, tile_size).cast("string"),
        F.lit("-"),
        tile_index(long, LONG_RANGE, tile_size).cast("string"),
    )


def tile_centre(coordinate: Column, half_range: int, tile_size: int) -> Column:
    return centre_of_index(tile_index(coordinate, half_range, tile_size), half_range, tile_size)


def centre_of_tile_id(id_column: Column, tile_size: int) -> tuple[Column, Column]:
    """(Lat, Long) of the centre, read back from the id, so that no lookup is needed."""
    parts = r"^(-?[0-9]+)-(-?[0-9]+)$"
    lat = F.regexp_extract(id_column, parts, 1).try_cast("int")
    long = F.regexp_extract(id_column, parts, 2).try_cast("int")
    return (
        centre_of_index(lat, LAT_RANGE, tile_size),
        centre_of_index(long, LONG_RANGE, tile_size),
    )
