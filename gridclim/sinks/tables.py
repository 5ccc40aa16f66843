"""Writers. Tables are stored by Year, and a year that is written again is replaced."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, read_text, remove_path, write_text

#: Beside the files of a baseline; readers of CSV pass over it.
ABOUT = "_about.json"


def write_by_year(df: DataFrame, path: str, whole: bool = False) -> None:
    """Replaces the years in ``df`` and leaves the others, so any year can be run again; with
    ``whole``, nothing of an earlier table is left.

    The rebalance hint gathers a year into few files and lets adaptive execution split a year
    that is too large for one task."""
    (
        df.hint("rebalance", F.col("Year"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy("Year")
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str, append: bool = False, header: bool = True) -> None:
    """CSV for other tools: replaces the whole table or adds to it."""
    df.write.mode("append" if append else "overwrite").option("header", header).csv(path)


def export_baseline(baseline: DataFrame, path: str, about: dict | None = None) -> None:
    """The baseline year as CSV in the form of daily values, for a later run. ``about`` says what it
    was made of; it is written last, so that a baseline that has it is whole."""
    spark = baseline.sparkSession
    remove_path(spark, f"{path}/{ABOUT}")
    export_csv(
        baseline.select("MonthDay", "Element", "Tile_Id", "Value_baseline"), path, header=False
    )
    if about is not None:
        write_text(spark, f"{path}/{ABOUT}", json.dumps(about, indent=1, sort_keys=True))


def read_about(spark: SparkSession, path: str) -> dict | None:
    """What a saved baseline was made of, if it says so."""
    about = f"{path}/{ABOUT}"
    return json.loads(read_text(spark, about)) if path_exists(spark, about) else None


def write_feature_collections(collections: DataFrame, path: str, whole: bool = True) -> None:
    """One folder per year with one line: the year's FeatureCollection (columns Year, json).
    Replaces all that was published before, as the ids run on across the years; without ``whole``,
    only the years in ``collections``."""
    (
        collections.select("Year", F.col("json").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy("Year")
        .text(path)
    )
