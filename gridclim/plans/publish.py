"""Publishing the tile polygons of a result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.polygons import feature_collections, feature_ids, tile_polygons
from ..published import publish_by_year, read_pointer, read_published
from ..session import list_path, remove_path
from ..sinks.tables import write_feature_collections


def publish_polygons(wide: DataFrame, path: str, tile_size: int) -> None:
    """One GeoJSON FeatureCollection per year, with ids that run on across the years.

    All years are published together, as a new version that ``read_feature_collections`` finds by
    its pointer. For tools that know no pointers, the years are then copied to ``Year=<year>`` below
    ``path``."""
    spark = wide.sparkSession
    collections = feature_collections(feature_ids(tile_polygons(wide, tile_size)))
    lines = collections.select(F.col("json").alias("value"), "Year")
    publish_by_year(lines, path, whole=True, text=True)
    write_feature_collections(
        read_published(spark, path).withColumnRenamed("value", "json"), path, whole=False
    )
    years = read_pointer(spark, path)["folders"]
    for name in list_path(spark, path):
        if name.startswith("Year=") and name not in years:
            remove_path(spark, f"{path}/{name}")
