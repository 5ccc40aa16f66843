"""Tiles as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geojson import feature, point, polygon


def tile_polygons(wide: DataFrame, tile_size: int) -> DataFrame:
    """The square of every (tile, year) of the wide table as a nested geometry."""
    return wide.select(
        "Lat", "Long", "Year",
        polygon(F.col("Lat"), F.col("Long"), tile_size).alias("geometry"),
    )


def feature_ids(tiles: DataFrame) -> DataFrame:
    """Numbers the rows 1, 2, ... across the years, by Lat and Long within a year.

    The rank runs within a year, which the grid bounds. What the earlier years add is summed
    over an array of one small entry per year."""
    position = F.row_number().over(Window.partitionBy("Year").orderBy("Lat", "Long"))
    per_year = tiles.groupBy("Year").agg(F.count(F.lit(1)).alias("n"))
    years = per_year.agg(F.collect_list(F.struct("Year", "n")).alias("years"))
    starts = years.select(
        F.explode(
            F.transform(
                "years",
                lambda this: F.struct(
                    this["Year"].alias("Year"),
                    F.aggregate(
                        F.filter("years", lambda other: other["Year"] < this["Year"]),
                        F.lit(0).cast("bigint"),
                        lambda total, other: total + other["n"],
                    ).alias("start"),
                ),
            )
        ).alias("y")
    ).select("y.Year", "y.start")
    return (
        tiles.withColumn("position", position)
        .join(starts, "Year")
        .withColumn("id", (F.col("start") + F.col("position")).cast("int"))
        .drop("start", "position")
    )


def feature_collections(polygons: DataFrame) -> DataFrame:
    """One FeatureCollection per year as JSON text, from ``feature_ids(tile_polygons(..))``. A
    year holds at most one feature per tile of the grid."""
    properties = F.struct("Lat", "Long", "Year")
    features = polygons.select(
        "Year", feature(F.col("geometry"), properties, F.col("id")).alias("feature"), "id"
    )
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("id", "feature"))), lambda f: f["feature"]
    )
    return features.groupBy("Year").agg(ordered.alias("features")).select(
        "Year",
        F.to_json(
            F.struct(F.lit("FeatureCollection").alias("type"), F.col("features"))
        ).alias("json"),
    )


def point_features(wide: DataFrame) -> DataFrame:
    """Each row of the wide table as a Point feature with all its columns as properties."""
    properties = F.struct(*[F.col(c) for c in wide.columns])
    return wide.select(
        "Year", "Lat", "Long",
        F.to_json(
            feature(point(F.col("Lat"), F.col("Long")), properties), {"ignoreNullFields": "false"}
        ).alias("json"),
    )
