"""GeoJSON as nested columns; ``to_json`` turns them into text at the sink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One FeatureCollection of tile polygons, as published per year.
FEATURE_COLLECTION = (
    "type STRING, features ARRAY<STRUCT<type: STRING, id: INT,"
    " properties: STRUCT<Lat: INT, Long: INT, Year: INT>,"
    " geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<INT>>>>>>"
)


def ring(lat: Column, long: Column, tile_size: int) -> Column:
    """Closed square around a tile centre, as polygon coordinates (one ring of five points)."""
    half = F.lit(tile_size // 2)
    west, east = long - half, long + half
    south, north = lat - half, lat + half
    corners = [(west, south), (west, north), (east, north), (east, south), (west, south)]
    return F.array(F.array(*[F.array(x, y) for x, y in corners]))


def polygon(lat: Column, long: Column, tile_size: int) -> Column:
    return F.struct(
        F.lit("Polygon").alias("type"), ring(lat, long, tile_size).alias("coordinates")
    )


def point(lat: Column, long: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(long, lat).alias("coordinates"))


def feature(geometry: Column, properties: Column, id: Column | None = None) -> Column:
    fields = [F.lit("Feature").alias("type")]
    if id is not None:
        fields.append(id.alias("id"))
    return F.struct(*fields, properties.alias("properties"), geometry.alias("geometry"))
