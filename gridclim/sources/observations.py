"""Daily observations: headerless CSV, one file per year."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import year_of

OBSERVATION_SCHEMA = (
    "Station STRING, Date STRING, Element STRING, Value INT,"
    " MFlag STRING, QFlag STRING, SFlag STRING, Time STRING"
)


def with_year(observations: DataFrame) -> DataFrame:
    """Adds Year from Date. A column Year that names file or folder gives way: it serves the
    choice of files, and a misfiled row counts in the year of its date."""
    return observations.withColumn("Year", year_of(F.col("Date")))


def yearly_files(folder: str, years: Iterable[int]) -> list[str]:
    """The files of these years, so that no other year is opened."""
    return [f"{folder.rstrip('/')}/{year}.csv" for year in years]


def read_observations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All yearly files at once. Values that are no numbers become NULL."""
    return with_year(spark.read.schema(OBSERVATION_SCHEMA).csv(path))


#: The whole line, where it has not the fields of an observation.
LINE = "_line"


def read_checked_observations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Yearly files like ``read_observations``, with their ``file`` and a ``reject``: NULL for a
    sound row, else what is wrong first. ``line``: fields are missing, are too many, or hold no
    number where one belongs; ``station``, ``date``, ``element``: the field is empty, or no day of the
    calendar. The column ``line`` has the text of a reject. An empty Value is sound."""
    names = [field.split()[0] for field in OBSERVATION_SCHEMA.split(", ")]
    rows = (
        spark.read.schema(", ".join(f"{name} STRING" for name in (*names, LINE)))
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
        # All fields are parsed, whichever are asked for, so that their number is seen.
        .option("columnPruning", False)
        .csv(path)
    )
    number = F.col("Value").try_cast("int")
    text = F.concat_ws(",", *[F.coalesce(F.col(name), F.lit("")) for name in names])
    blank = {name: F.trim(F.coalesce(F.col(name), F.lit(""))) == "" for name in ("Station", "Element")}
    is_day = F.col("Date").rlike("^[0-9]{8}$") & F.try_to_date("Date", "yyyyMMdd").isNotNull()
    reject = (
        F.when(F.col(LINE).isNotNull() | (F.col("Value").isNotNull() & number.isNull()), "line")
        .when(blank["Station"], "station")
        .when(~F.coalesce(is_day, F.lit(False)), "date")
        .when(blank["Element"], "element")
    )
    return with_year(rows.select(
        *[number.alias(name) if name == "Value" else F.col(name) for name in names],
        F.col("_metadata.file_path").alias("file"), reject.alias("reject"),
        F.when(reject.isNotNull(), F.coalesce(F.col(LINE), text)).alias("line"),
    ))


def sound_observations(checked: DataFrame) -> DataFrame:
    """The rows of ``read_checked_observations`` without fault, as ``read_observations`` has them."""
    return checked.where(F.col("reject").isNull()).drop("file", "reject", "line")


def rejected_observations(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject").isNotNull())


def rejects_per_file(checked: DataFrame) -> DataFrame:
    """Rows and rejects of each file; summed before they move."""
    kinds = [
        F.count_if(F.col("reject") == kind).alias(kind)
        for kind in ("line", "station", "date", "element")
    ]
    return checked.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("reject").alias("n_rejects"), *kinds
    )


class TooManyRejects(ValueError):
    """More rows of a file are unsound than the run may leave out."""


def check_rejects(per_file: DataFrame, most_share: float) -> None:
    """Raises TooManyRejects, which names the worst files, if more than ``most_share`` of a file's
    rows are rejected."""
    share = F.col("n_rejects") / F.col("n_rows")
    worst = per_file.where(share > most_share).orderBy(share.desc(), "file").limit(5).collect()
    if worst:
        named = "; ".join(f"{r['file']}: {r['n_rejects']} of {r['n_rows']} rows" for r in worst)
        raise TooManyRejects(f"more than {most_share:g} of the rows are unsound: {named}")


def year_mismatch_audit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows whose Date disagrees with the year that names their file, counted per file.

    The year is the file's own name (``1917.csv``) or that of its folder (``Year=1917/...``)."""
    named_year = r"[/=]([0-9]{4})(?:\.[^/]*|/[^/]*)$"
    rows = spark.read.schema(OBSERVATION_SCHEMA).csv(path).select(
        F.col("_metadata.file_path").alias("file"), year_of(F.col("Date")).alias("Year")
    )
    return (
        rows.groupBy("file", "Year")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("file_year", F.regexp_extract("file", named_year, 1).try_cast("int"))
        .where(~F.col("Year").eqNullSafe(F.col("file_year")))
    )
