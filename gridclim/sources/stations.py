"""Station list: fixed-width text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field name, width and type, in file order.
FIELDS = (
    ("Id", 11, "string"),
    ("Lat", 9, "double"),
    ("Long", 10, "double"),
    ("Elevation", 7, "double"),
    ("State", 3, "string"),
    ("Name", 31, "string"),
    ("GSN", 4, "string"),
    ("HCN_CRN", 4, "string"),
    ("WMO_Id", 6, "string"),
)


def parse_station_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """All nine fields of each line that is not blank. Empty text and bad numbers are NULL."""
    fields, start = [], 1
    for name, width, kind in FIELDS:
        text = F.nullif(F.trim(F.substring(column, start, width)), F.lit(""))
        fields.append((text if kind == "string" else text.try_cast(kind)).alias(name))
        start += width
    return lines.where(F.trim(F.col(column)) != "").select(*fields)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return parse_station_lines(spark.read.text(path)).select("Id", "Lat", "Long")
