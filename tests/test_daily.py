import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridclim import ClimateConfig
from gridclim.operators import (
    BroadcastLimit, daily_from_facts, daily_storm_rate, daily_tile_mean, daily_tile_values,
    facts_on_tiles, fits_broadcast, accepted_observations, observation_facts, station_counts,
    tile_stations, tiled_observations, unknown_station_audit, with_station_count,
)

from helpers import observations, plan, rows, stations

LIST = [("A", 1.0, 1.0), ("B", 2.0, 2.0), ("C", 3.0, 3.0), ("D", 4.0, 4.0), ("E", -5.0, 1.0)]


@pytest.fixture
def tiled_list(spark):
    return tile_stations(stations(spark, LIST), 10)


@pytest.mark.parametrize("broadcast", [True, False])
def test_unknown_stations_and_flags_drop_out(spark, tiled_list, broadcast):
    seen = observations(spark, [
        ("A", "19170101", "PRCP", 1), ("A", "19170101", "TMAX", 2, "G"),
        ("X", "19170101", "PRCP", 3), ("E", "19170101", "TMIN", 4),
        ("E", "19170101", "WT18", 5),
    ])
    tiled = tiled_observations(seen, tiled_list, broadcast)
    assert rows(tiled, "Station", "Element", "Value", "Tile_Id", "Lat", "Long") == [
        ("A", "PRCP", 1, "9-18", 5, 5), ("E", "WT18", 5, "8-18", -5, 5),
    ]
    assert rows(unknown_station_audit(seen, stations(spark, LIST)), "Station", "n") == [("X", 1)]


def test_storms_per_station(spark, tiled_list):
    seen = observations(spark, [
        ("A", "19170101", "WT03", 1), ("A", "19170101", "WT05", 1),
        ("B", "19170101", "WT03", 1), ("B", "19170101", "WT05", 9),
        ("C", "19170101", "WT03", None),
        ("D", "19170220", "PRCP", 7),
        ("A", "19180101", "WT03", 1),
    ])
    tiled = tiled_observations(seen, tiled_list)
    assert rows(station_counts(tiled), "Year", "Station_count") == [(1917, 4), (1918, 1)]
    expected = [("19170101", "WTXX", "9-18", 1.25), ("19180101", "WTXX", "9-18", 1.0)]
    assert rows(daily_storm_rate(tiled), "Date", "Element", "Tile_Id", "Value") == expected
    values = daily_tile_values(tiled)
    assert rows(values, "Date", "Element", "Tile_Id", "Value") == sorted(
        expected + [("19170220", "PRCP", "9-18", 7.0)]
    )
    counted = with_station_count(tiled, station_counts(tiled))
    assert "Station" not in counted.columns
    assert {(r["Year"], r["Station_count"]) for r in counted.collect()} == {(1917, 4), (1918, 1)}


def test_means_skip_missing_values(spark, tiled_list):
    seen = observations(spark, [
        ("A", "19170101", "PRCP", 10), ("B", "19170101", "PRCP", None),
        ("C", "19170101", "PRCP", 21), ("E", "19170101", "TMAX", None),
    ])
    tiled = tiled_observations(seen, tiled_list)
    expected = [("8-18", "TMAX", None), ("9-18", "PRCP", 15.5)]
    assert rows(daily_tile_values(tiled), "Tile_Id", "Element", "Value") == expected
    assert rows(daily_tile_mean(tiled), "Tile_Id", "Element", "Value") == expected


def hot_observations(spark, n=6000):
    """One station holds half of all rows, one tile most of them."""
    random.seed(7)
    start = datetime.date(1917, 1, 1)
    made = []
    for _ in range(n):
        station = "A" if random.random() < 0.5 else random.choice("ABCDEX")
        date = (start + datetime.timedelta(days=random.randrange(800))).strftime("%Y%m%d")
        element = random.choice(["PRCP", "TMAX", "WT03", "WT05", "SNOW"])
        made.append((station, date, element, random.randrange(-50, 400)))
    return observations(spark, made)


def test_long_station_lists_give_the_same_values(spark, tiled_list):
    facts = observation_facts(accepted_observations(hot_observations(spark)))
    small = daily_from_facts(facts_on_tiles(facts, tiled_list, broadcast=True))
    large = daily_from_facts(facts_on_tiles(facts, tiled_list, broadcast=False))
    assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
    columns = ("Year", "Date", "Element", "Tile_Id", "Value")
    assert rows(small, *columns) == rows(large, *columns)


def test_salted_join_keeps_every_row(spark, tiled_list):
    seen = hot_observations(spark)
    one = tiled_observations(seen, tiled_list, broadcast=True)
    other = tiled_observations(seen, tiled_list, broadcast=False)
    columns = ("Station", "Date", "Element", "Value", "Tile_Id")
    assert rows(one, *columns) == rows(other, *columns)
    counts = station_counts(one)
    columns = ("Date", "Element", "Value", "Tile_Id", "Station_count")
    assert rows(with_station_count(one, counts, broadcast=True), *columns) == rows(
        with_station_count(one, counts, broadcast=False), *columns
    )


def test_salted_join_spreads_a_hot_station(spark, tiled_list):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tiled = tiled_observations(hot_observations(spark), tiled_list, broadcast=False)
        sizes = [
            r["count"]
            for r in tiled.where("Station = 'A'").groupBy(F.spark_partition_id()).count().collect()
        ]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) >= 6
    assert max(sizes) < sum(sizes) / 2


def test_hot_rows_shrink_before_the_shuffle(spark, tiled_list):
    """The rows of a tile are summed in the task that reads them."""
    facts = facts_on_tiles(
        observation_facts(accepted_observations(hot_observations(spark))), tiled_list, True
    )
    text = plan(daily_from_facts(facts))
    first_exchange = text.rindex("Exchange hashpartitioning")
    assert "partial_sum" in text[first_exchange:]


def test_one_scan(spark, tiled_list, tmp_path):
    path = str(tmp_path / "observations")
    hot_observations(spark).write.parquet(path)
    tiled = tiled_observations(spark.read.parquet(path), tiled_list)
    assert plan(daily_tile_values(tiled)).count("FileScan") == 1


def test_size_check(spark):
    lookup = spark.range(10).select(F.concat(F.lit("abcdefghi"), "id").alias("Id"))
    assert fits_broadcast(lookup, BroadcastLimit(10, 100))
    assert not fits_broadcast(lookup, BroadcastLimit(9, 100))
    assert not fits_broadcast(lookup, BroadcastLimit(10, 99))
    assert fits_broadcast(lookup.limit(0), BroadcastLimit(0, 0))


def test_row_order_does_not_matter(spark, tiled_list):
    seen = hot_observations(spark)
    columns = ("Year", "Date", "Element", "Tile_Id", "Value")
    shuffled = seen.repartition(5).orderBy(F.desc("Value"))
    assert rows(daily_tile_values(tiled_observations(seen, tiled_list)), *columns) == rows(
        daily_tile_values(tiled_observations(shuffled, tiled_list)), *columns
    )


def test_config_is_hashable():
    assert hash(ClimateConfig()) == hash(ClimateConfig())
