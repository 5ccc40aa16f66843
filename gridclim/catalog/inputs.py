"""The given tables, read as stations, observations and emissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ClimateConfig

CONFIG = ClimateConfig(
    year_start_data=1995, year_end_data=2001, year_start_baseline=1995, year_span_baseline=3
)
# A day count that some tiles reach and some do not, in tables of about 60,000 measurements.
STRICT_CONFIG = ClimateConfig(
    year_start_data=1995, year_end_data=2001, year_start_baseline=1995, year_span_baseline=3,
    days_divisor=131,
)

CO2_HEADER = (
    "Total carbon emissions from fossil fuel consumption and cement production"
    " (million metric tons of C)"
)


SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_size INT",
    "lineitem": (
        "l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING,"
        " l_shipdate TIMESTAMP_NTZ"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), key).alias("Id"),
        ((key * 37) % 400 / F.lit(10.0) - 20).alias("Lat"),
        ((key * 91) % 600 / F.lit(10.0) - 30).alias("Long"),
    )


def listed_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station list from which some reporting stations are missing."""
    key = F.col("p_partkey")
    listed = table(spark, sf_dir, "part").where(F.col("p_size") > 10)
    return listed.select(F.concat(F.lit("P"), key).alias("Id"))


def station_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station list as fixed-width text."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return parts.select(
        F.format_string(
            "%-11s%9.4f%10.4f%7.1f%3s%-31s%4s%4s%6s",
            F.concat(F.lit("P"), key),
            (key * 37) % 400 / F.lit(10.0) - 20,
            (key * 91) % 600 / F.lit(10.0) - 30,
            F.col("p_size").cast("double"),
            F.lit(""),
            F.col("p_name"),
            F.lit("GSN"),
            F.lit(""),
            (key % 100000).cast("string"),
        ).alias("value")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an observation file, and Year as the reader adds it."""
    number = F.col("l_linenumber")
    element = (
        F.when(number == 1, "PRCP")
        .when(number == 2, "TMAX")
        .when(number == 3, "WT03")
        .when(number == 4, "WT05")
        .otherwise("SNOW")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("Station"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("Date"),
        element.alias("Element"),
        F.col("l_quantity").cast("int").alias("Value"),
        F.lit(None).cast("string").alias("MFlag"),
        F.when(F.col("l_returnflag") == "R", "G").alias("QFlag"),
        F.lit(None).cast("string").alias("SFlag"),
        F.lit(None).cast("string").alias("Time"),
        F.year("l_shipdate").alias("Year"),
    )


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of observation files (value, Year), of which some are not sound."""
    number, key = F.col("l_linenumber"), F.col("l_partkey")
    station, date = F.concat(F.lit("P"), key), F.date_format("l_shipdate", "yyyyMMdd")
    value = F.col("l_quantity").cast("int").cast("string")
    year = F.year("l_shipdate")

    def line(*fields: Column) -> Column:
        return F.concat_ws(",", *fields)

    empty = F.lit(",,,")
    text = (
        F.when(number == 7, line(station, date))
        .when(number == 6, line(station, date, F.lit("SNOW"), F.lit("much"), empty))
        .when((number == 5) & (key % 3 == 0), line(station, F.concat(year, F.lit("0230")),
                                                   F.lit("SNOW"), value, empty))
        .when((number == 5) & (key % 3 == 1), line(F.lit(""), date, F.lit("SNOW"), value, empty))
        .when((number == 4) & (key % 5 == 0), line(station, date, F.lit(""), value, empty))
        .otherwise(line(station, date, F.lit("PRCP"), value, empty))
    )
    return table(spark, sf_dir, "lineitem").select(text.alias("value"), year.alias("Year"))


def co2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals as text, with a line that is no data."""
    years = table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("year"), "l_quantity"
    )
    return (
        years.rollup("year")
        .agg(
            F.sum(F.col("l_quantity").cast("int")).cast("string").alias("total"),
            F.grouping("year").alias("is_total"),
        )
        .select(
            F.coalesce("year", F.lit("Year (*)")).alias("Year"),
            F.when(F.col("is_total") == 0, F.col("total")).alias(CO2_HEADER),
        )
    )
