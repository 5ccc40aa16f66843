import random

from gridclim import ClimateConfig
from gridclim.operators import (
    active_days_per_year, active_tiles, active_tiles_per_year, day_bitmaps, days_counted,
    initial_tiles, merged_bitmaps, numbered_stations, restrict_to_tiles, station_bitmaps,
    station_counts, stations_counted, tiles_active_in,
)

from helpers import daily, plan, rows


def dates(year, n):
    return [f"{year}{1 + i // 28:02d}{1 + i % 28:02d}" for i in range(n)]


def test_daily_coverage(spark):
    made = [(d, e, "a", 1.0) for d in dates(1917, 24) for e in ("PRCP", "TMAX")]
    made += [(d, "PRCP", "b", None) for d in dates(1917, 23)]
    days = daily(spark, made)
    assert rows(active_days_per_year(days), "Tile_Id", "Count") == [("a", 24), ("b", 23)]
    assert rows(active_tiles_per_year(days, 30, 0.8), "Tile_Id", "Year") == [("a", 1917)]
    assert rows(active_tiles_per_year(days, 365, 0.8), "Tile_Id") == []


def tile_years(spark, made):
    return spark.createDataFrame(made, "Tile_Id STRING, Year INT")


def test_yearly_coverage(spark):
    made = [("a", y) for y in range(1917, 1941)] + [("b", y) for y in range(1917, 1940)]
    made += [("c", y) for y in range(1918, 1947)]
    years = tile_years(spark, made)
    assert rows(active_tiles(years, 30, 0.8), "Tile_Id") == [("a",), ("c",)]
    since_first = tiles_active_in(years, 1917)
    assert rows(active_tiles(since_first, 30, 0.8), "Tile_Id") == [("a",)]
    assert since_first.where("Tile_Id = 'c'").count() == 0


def test_initial_tiles_equal_the_step_by_step_selection(spark):
    random.seed(3)
    config = ClimateConfig(1990, 1999, 1992, 5, 0.6, 10, days_divisor=10)
    made = []
    for tile in "abcdefghijklmnop":
        for year in range(1990, 1999):
            made += [(d, "PRCP", tile, 1.0) for d in dates(year, random.randrange(3, 12))]
    days = daily(spark, made)
    span = days.where("Year BETWEEN 1992 AND 1996")
    by_steps = active_tiles(
        tiles_active_in(active_tiles_per_year(span, 10, 0.6), 1992), 5, 0.6
    )
    found = rows(initial_tiles(days, config), "Tile_Id")
    assert found == rows(by_steps, "Tile_Id")
    assert 0 < len(found) < 16


def test_restriction_does_not_multiply_rows(spark):
    days = daily(spark, [("19170101", "PRCP", "a", 1.0), ("19170101", "PRCP", "b", 2.0)])
    tiles = spark.createDataFrame([("a",), ("a",), ("z",)], "Tile_Id STRING")
    for broadcast in (True, False, None):
        kept = restrict_to_tiles(days, tiles, broadcast)
        assert rows(kept, "Tile_Id", "Value") == [("a", 1.0)]


def test_bitmaps_count_as_distinct_does(spark):
    """Also when they are stored in parts, and with more stations than one bitmap holds."""
    made = [
        ("a", 1917, f"1917{month:02}{day:02}", f"s{day % 5}")
        for month in (1, 2, 12) for day in (1, 2, 2, 28, 31) if (month, day) != (2, 31)
    ] + [("a", 1920, "19200229", "s1"), ("b", 1920, "19201231", "s9"), ("b", 1920, "1920", "s9")]
    days = spark.createDataFrame(made, "Tile_Id STRING, Year INT, Date STRING, Station STRING")
    parts = [day_bitmaps(days.where(c)) for c in ("Station < 's2'", "Station >= 's2'")]
    merged = merged_bitmaps(parts[0].unionByName(parts[1]))
    known = days.where("length(Date) = 8")
    assert rows(days_counted(merged), "Tile_Id", "Year", "Count") == rows(
        active_days_per_year(known), "Tile_Id", "Year", "Count"
    )
    listed = spark.range(70_000).selectExpr(
        "concat('s', id) AS Id", "CASE WHEN id = 69999 THEN 'b' ELSE 'a' END AS Tile_Id"
    )
    seen = numbered_stations(listed).where("substr(Id, -1) <> '7'").selectExpr(
        "Tile_Id", "1917 AS Year", "number", "Id AS Station"
    )
    halves = [station_bitmaps(seen.where(c)) for c in ("number % 3 = 0", "number % 3 > 0 OR number % 2 = 0")]
    counted = stations_counted(merged_bitmaps(halves[0].unionByName(halves[1])))
    assert rows(counted, "Year", "Tile_Id", "Station_count") == rows(
        station_counts(seen), "Year", "Tile_Id", "Station_count"
    )
    assert plan(days_counted(day_bitmaps(days))).count("Exchange") == 1
