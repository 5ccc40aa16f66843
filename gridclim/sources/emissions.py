"""Yearly carbon emissions: CSV with a header and some lines that are no data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CARBON_TO_CO2

TOTAL_PREFIX = "total carbon emissions"


def read_co2(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines as text columns; no pass to infer types."""
    return spark.read.option("header", True).csv(path)


def co2_series(raw: DataFrame) -> DataFrame:
    """Year and Total_in_mega_tons of carbon dioxide; only lines with a four-character year."""
    total = next(
        (c for c in raw.columns if c.strip().lower().replace("_", " ").startswith(TOTAL_PREFIX)),
        None,
    )
    year = next((c for c in raw.columns if c.strip().lower() == "year"), None)
    if total is None or year is None:
        raise ValueError(f"no year or total column among {raw.columns}")
    year_text, total_text = raw[f"`{year}`"].cast("string"), raw[f"`{total}`"].cast("string")
    return raw.where(F.length(year_text) == 4).select(
        year_text.try_cast("int").alias("Year"),
        (total_text.try_cast("double") * F.lit(CARBON_TO_CO2)).alias("Total_in_mega_tons"),
    )
