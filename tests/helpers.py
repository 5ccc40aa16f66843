"""Small hand-made tables."""

from gridclim.sources import OBSERVATION_SCHEMA, with_year


def observations(spark, rows):
    """Rows (Station, Date, Element, Value[, QFlag])."""
    full = [
        (r[0], r[1], r[2], r[3], None, r[4] if len(r) > 4 else None, None, None) for r in rows
    ]
    return with_year(spark.createDataFrame(full, OBSERVATION_SCHEMA))


def stations(spark, rows):
    return spark.createDataFrame(rows, "Id STRING, Lat DOUBLE, Long DOUBLE")


def daily(spark, rows):
    """Rows (Date, Element, Tile_Id, Value)."""
    return with_year(
        spark.createDataFrame(rows, "Date STRING, Element STRING, Tile_Id STRING, Value DOUBLE")
    ).select("Year", "Date", "Element", "Tile_Id", "Value")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
