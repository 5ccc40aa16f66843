"""Published tile polygons: one FeatureCollection per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geojson import FEATURE_COLLECTION
from ..published import is_published, published_folders


def read_feature_collections(
    spark: SparkSession, path: str | list[str], year: int | None = None
) -> DataFrame:
    """One row per file; a file holds at most one feature per tile of the grid. With ``year``, only
    the files of that year are opened; ``path`` is then the folder of ``publish_polygons``, of
    which the last complete version is read."""
    reader = spark.read.schema(FEATURE_COLLECTION).option("multiLine", True)
    if isinstance(path, str) and is_published(spark, path):
        _, folders = published_folders(spark, path)
        files = reader.option("basePath", path).json(folders)
    else:
        files = reader.json(path)
    if year is not None:
        files = files.where(F.col("Year") == year)
    return files.drop("Year", "version")


def explode_features(collections: DataFrame) -> DataFrame:
    """One row per feature: id, Lat, Long, Year and the nested geometry."""
    feature = F.col("feature")
    return collections.select(F.explode("features").alias("feature")).select(
        feature["id"].alias("id"),
        feature["properties"]["Lat"].alias("Lat"),
        feature["properties"]["Long"].alias("Long"),
        feature["properties"]["Year"].alias("Year"),
        feature["geometry"].alias("geometry"),
    )
