"""Tables that the library wrote itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import MEASURES
from ..published import is_published, read_published

RESULT_SCHEMA = ", ".join([f"{m} DOUBLE" for m in MEASURES] + ["Lat INT", "Long INT", "Year INT"])
DAILY_SCHEMA = "Date STRING, Element STRING, Tile_Id STRING, Value DOUBLE"


def read_daily_values(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Daily tile values (or a baseline year) from CSV; dates stay text."""
    return spark.read.schema(DAILY_SCHEMA).csv(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """A saved list of considered tiles, CSV with a header."""
    return spark.read.schema("Tile_Id STRING").option("header", True).csv(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The wide table, stored by Year; a filter on Year reads only that year. Of a published table
    this is the last complete version."""
    return read_published(spark, path) if is_published(spark, path) else spark.read.parquet(path)


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide table from its CSV export."""
    return spark.read.schema(RESULT_SCHEMA).option("header", True).csv(path)
