import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridclim import ClimateConfig, build_yearly_anomalies
from gridclim.config import MEASURES
from gridclim.operators import (
    BroadcastLimit, anomalies, attach_centres, baseline_tiles, baseline_year, full_join_list,
    segment_means, spread_segment, tile_centres, tile_stations, wide_from_segments, wide_table,
    with_centres, with_segments,
)
from gridclim.plans import climate_tables

from helpers import daily, observations, rows, stations

CONFIG = ClimateConfig(1917, 1921, 1917, 2, 0.8, 10, days_divisor=1)


def test_baseline_is_a_mean_of_daily_means(spark):
    values = daily(spark, [
        ("19170101", "PRCP", "a", 20.0), ("19180101", "PRCP", "a", 40.0),
        ("19190101", "PRCP", "a", 99.0), ("19170102", "PRCP", "a", None),
    ])
    baseline = baseline_year(values, CONFIG)
    assert rows(baseline, "MonthDay", "Element", "Tile_Id", "Value_baseline") == [
        ("0101", "PRCP", "a", 30.0), ("0102", "PRCP", "a", None),
    ]
    assert rows(baseline_tiles(baseline), "Tile_Id") == [("a",)]


def test_days_without_baseline_drop_out(spark):
    values = daily(spark, [
        ("19170228", "TMAX", "a", 10.0), ("19200228", "TMAX", "a", 13.0),
        ("19200229", "TMAX", "a", 50.0), ("19200228", "TMAX", "b", 50.0),
        ("19200228", "PRCP", "a", 50.0),
    ])
    found = anomalies(values, baseline_year(values.where("Tile_Id = 'a' AND Element = 'TMAX'"),
                                            CONFIG))
    assert rows(found, "Year", "MonthDay", "Element", "Tile_Id", "Value") == [
        (1917, "0228", "TMAX", "a", 0.0), (1920, "0228", "TMAX", "a", 3.0),
    ]


def test_segments(spark):
    days = spark.createDataFrame(
        [(d,) for d in ("0503", "0504", "1102", "1103", "0229", None)], "MonthDay STRING"
    )
    found = rows(with_segments(days), "MonthDay", "segment")
    assert found == sorted([
        ("0503", "year"), ("0503", "winter"), ("0504", "year"), ("0504", "summer"),
        ("1102", "year"), ("1102", "summer"), ("1103", "year"), ("1103", "winter"),
        ("0229", "year"), ("0229", "winter"), (None, "year"),
    ], key=repr)


def differences(spark, made):
    return spark.createDataFrame(
        made, "Year INT, MonthDay STRING, Element STRING, Tile_Id STRING, Value DOUBLE"
    )


def test_missing_elements_are_null(spark):
    wide = wide_table(differences(spark, [(1917, "0701", "TMAX", "9-18", 2.0)]))
    row = wide.first().asDict()
    assert {m for m in MEASURES if row[m] is not None} == {"TMAX_year", "TMAX_summer"}


def random_differences(spark, n=3000):
    random.seed(11)
    made = [
        (random.randrange(1917, 1920),
         f"{random.randrange(1, 13):02d}{random.randrange(1, 29):02d}",
         random.choice(["PRCP", "TMAX", "WTXX"]), random.choice(["9-18", "8-18", "0-0"]),
         random.choice([None, random.uniform(-9, 9)]))
        for _ in range(n)
    ]
    made.append((1950, "0101", "PRCP", "1-1", 4.0))
    return differences(spark, made)


def test_pivot_and_full_join_equal_the_single_grouping(spark):
    given = random_differences(spark)
    one = wide_table(given).select("Year", "Tile_Id", *cells())
    other = wide_from_segments(segment_means(given)).select("Year", "Tile_Id", *cells())
    assert rows(one, *one.columns) == rows(other, *one.columns)
    assert one.count() == 10


def test_spread_names(spark):
    means = segment_means(random_differences(spark))
    assert spread_segment(means, "winter").columns == [
        "Year", "Tile_Id", "PRCP_winter", "TMAX_winter", "WTXX_winter"
    ]


def test_full_join_list(spark):
    one = spark.createDataFrame([(1, 10), (2, 20)], "k INT, a INT")
    two = spark.createDataFrame([(2, 200), (3, 300)], "k INT, b INT")
    three = spark.createDataFrame([(3, 3000), (4, 4000)], "k INT, c INT")
    assert rows(full_join_list([one, two, three], "k"), "k", "a", "b", "c") == [
        (1, 10, None, None), (2, 20, 200, None), (3, None, 300, 3000), (4, None, None, 4000),
    ]
    assert rows(full_join_list([one], "k"), "k") == [(1,), (2,)]
    with pytest.raises(ValueError):
        full_join_list([], "k")


def test_centres_by_lookup_and_by_id(spark):
    wide = wide_table(random_differences(spark))
    tiled = tile_stations(stations(spark, [("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", -1.0, 1.0),
                                           ("d", -90.0, -180.0)]), 10)
    looked_up = attach_centres(wide, tile_centres(tiled))
    assert looked_up.count() == wide.count()
    computed = {(r["Tile_Id"]): (r["Lat"], r["Long"]) for r in with_centres(wide, 10).collect()}
    for r in looked_up.where("Lat IS NOT NULL").collect():
        assert computed[r["Tile_Id"]] == (r["Lat"], r["Long"])
    assert computed["1-1"] == (-75, -165)
    assert looked_up.where("Tile_Id = '1-1'").first()["Lat"] is None


def years_of_observations(spark, shift=0, seed=5):
    random.seed(seed)
    made = []
    for offset in range(0, 5 * 365 + 1, 2):
        date = (datetime.date(1917, 1, 1) + datetime.timedelta(days=offset)).strftime("%Y%m%d")
        for station in "ABCE":
            made.append((station, date, "TMAX", random.randrange(-100, 300) + shift))
            if random.random() < 0.5:
                made.append((station, date, "PRCP", random.randrange(0, 90)))
            if random.random() < 0.2:
                made.append((station, date, "WT03", 1))
    return observations(spark, made)


STATIONS = [("A", 1.0, 1.0), ("B", 2.0, 2.0), ("C", -3.0, 3.0), ("E", 15.0, 15.0)]


def cells():
    return [F.round(m, 9).alias(m) for m in MEASURES]


def test_a_constant_shift_changes_no_anomaly(spark):
    listed = stations(spark, STATIONS)
    one = build_yearly_anomalies(spark, years_of_observations(spark), listed, CONFIG).wide
    other = build_yearly_anomalies(spark, years_of_observations(spark, 1000), listed, CONFIG).wide
    columns = ["Year", "Tile_Id"] + list(MEASURES)
    assert rows(one.select("Year", "Tile_Id", *cells()), *columns) == rows(
        other.select("Year", "Tile_Id", *cells()), *columns
    )
    assert one.count() == 15


def test_a_baseline_of_one_year_has_no_anomaly(spark):
    config = ClimateConfig(1917, 1917, 1917, 1, 0.8, 10)
    wide = build_yearly_anomalies(
        spark, years_of_observations(spark), stations(spark, STATIONS), config
    ).wide
    row_values = [r.asDict() for r in wide.collect()]
    assert len(row_values) == 3
    assert all(r[m] == 0 for r in row_values for m in MEASURES)


def test_long_station_lists_give_the_same_result(spark):
    seen, listed = years_of_observations(spark), stations(spark, STATIONS)
    columns = ["Year", "Tile_Id", "Lat", "Long"] + list(MEASURES)
    one = build_yearly_anomalies(spark, seen, listed, CONFIG).wide
    other = build_yearly_anomalies(spark, seen, listed, CONFIG, limit=BroadcastLimit(rows=0)).wide
    assert rows(one.select("Year", "Tile_Id", "Lat", "Long", *cells()), *columns) == rows(
        other.select("Year", "Tile_Id", "Lat", "Long", *cells()), *columns
    )


def test_restart_uses_the_stored_stage(spark, tmp_path):
    path = str(tmp_path / "stage")
    seen, listed = years_of_observations(spark), stations(spark, STATIONS)
    first = build_yearly_anomalies(spark, seen, listed, CONFIG, path, inputs="one")
    columns = ["Year", "Tile_Id"] + list(MEASURES)
    expected = rows(first.wide.select("Year", "Tile_Id", *cells()), *columns)
    again = build_yearly_anomalies(spark, seen.limit(0), listed, CONFIG, path, inputs="one")
    assert rows(again.wide.select("Year", "Tile_Id", *cells()), *columns) == expected
    # Other input under the same path, named or not, is computed.
    for label in ("two", None):
        none = build_yearly_anomalies(spark, seen.limit(0), listed, CONFIG, path, inputs=label)
        assert none.wide.count() == 0
    changed = ClimateConfig(1917, 1918, 1917, 2, 0.8, 10, days_divisor=1)
    other = build_yearly_anomalies(spark, seen, listed, changed, path)
    assert {r["Year"] for r in other.wide.collect()} == {1917, 1918}


def test_only_baseline_years_are_read_for_the_baseline(spark):
    tables = build_yearly_anomalies(
        spark, years_of_observations(spark), stations(spark, STATIONS), CONFIG
    )
    text = tables.baseline._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in text
    assert climate_tables(tables.daily, CONFIG).wide.count() == tables.wide.count()
