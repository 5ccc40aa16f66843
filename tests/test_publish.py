import json
import random

import pytest
from pyspark.sql import functions as F

from gridclim import publish_polygons
from gridclim.config import MEASURES
from gridclim.operators import (
    SERIES, feature_collections, feature_ids, global_series, map_layer, point_features,
    series_long, tile_polygons, with_color, year_lookup,
)
from gridclim.sinks import export_csv, write_by_year
from gridclim.sources import (
    explode_features, read_daily_values, read_feature_collections, read_result, read_result_csv,
    read_tiles,
)

from helpers import plan, rows

SCHEMA = "Year INT, Lat INT, Long INT, " + ", ".join(f"{m} DOUBLE" for m in MEASURES)


def wide(spark, places, value=lambda: random.uniform(-50, 50)):
    """Rows for (Year, Lat, Long)."""
    random.seed(4)
    return spark.createDataFrame([(*p, *[value() for _ in MEASURES]) for p in places], SCHEMA)


@pytest.fixture
def places():
    return [
        (year, lat, long)
        for year in (1917, 1918, 1920)
        for lat in (-15, 15)
        for long in (-175, 5)
        if (year, lat, long) != (1918, 15, 5)
    ]


def test_polygon_of_a_tile(spark):
    ring = tile_polygons(wide(spark, [(1917, 15, 5)]), 10).first()["geometry"]
    assert ring["type"] == "Polygon"
    assert ring["coordinates"] == [[[0, 10], [0, 20], [10, 20], [10, 10], [0, 10]]]


def test_ids_run_on_across_years(spark, places):
    numbered = feature_ids(tile_polygons(wide(spark, places), 10))
    found = [tuple(r) for r in numbered.orderBy("id").select("id", "Year", "Lat", "Long").collect()]
    assert [f[0] for f in found] == list(range(1, 12))
    assert [f[1:] for f in found] == sorted(places)
    assert "Nested" not in plan(numbered) and "Cartesian" not in plan(numbered)


def test_published_text(spark, tmp_path):
    publish_polygons(wide(spark, [(1917, 15, 5), (1917, 25, 35)]), str(tmp_path / "out"), 10)
    (file,) = (tmp_path / "out" / "Year=1917").glob("*.txt")
    assert file.read_text() == (
        '{"type":"FeatureCollection","features":['
        '{"type":"Feature","id":1,"properties":{"Lat":15,"Long":5,"Year":1917},"geometry":'
        '{"type":"Polygon","coordinates":[[[0,10],[0,20],[10,20],[10,10],[0,10]]]}},'
        '{"type":"Feature","id":2,"properties":{"Lat":25,"Long":35,"Year":1917},"geometry":'
        '{"type":"Polygon","coordinates":[[[30,20],[30,30],[40,30],[40,20],[30,20]]]}}]}\n'
    )


def test_published_files_read_back(spark, places, tmp_path):
    path = str(tmp_path / "out")
    given = wide(spark, places)
    publish_polygons(given, path, 10)
    read = explode_features(read_feature_collections(spark, path))
    assert rows(read, "Year", "Lat", "Long") == sorted(places, key=repr)
    polygons = tile_polygons(given, 10)
    assert rows(read, "Lat", "Long", "Year", "geometry") == rows(
        polygons, "Lat", "Long", "Year", "geometry"
    )
    for folder in (tmp_path / "out").glob("Year=*"):
        (file,) = folder.glob("*.txt")
        ids = [f["id"] for f in json.loads(file.read_text())["features"]]
        assert ids == list(range(ids[0], ids[0] + len(ids)))


def test_points_keep_missing_values(spark):
    given = wide(spark, [(1917, 15, 5)], lambda: None)
    text = point_features(given).first()["json"]
    feature = json.loads(text)
    assert feature["geometry"] == {"type": "Point", "coordinates": [5, 15]}
    assert feature["properties"]["TMAX_year"] is None and feature["properties"]["Year"] == 1917


def test_layers_and_labels(spark):
    given = wide(spark, [(1917, 15, 5), (1917, 25, 5), (1918, 15, 5)]).withColumns({
        "TMAX_year": F.when(F.col("Lat") == 15, 125.0),
        "PRCP_year": F.when(F.col("Lat") == 15, -3.0),
        "WTXX_year": F.when(F.col("Lat") == 25, 0.125),
    })
    layer = with_color(map_layer(given, tile_polygons(given, 10), 1917, "year"))
    found = {(r["Lat"], r["layer"]): r for r in layer.collect()}
    assert len(found) == 6
    hot = found[15, "temp"]
    assert (hot["value"], hot["label"]) == (12.5, "13 &#176;C")
    assert hot["scale_position"] is None and hot["color_class"] is None
    assert json.loads(hot["geometry"])["type"] == "Polygon"
    rain = found[15, "prec"]
    assert (rain["value"], rain["label"]) == (-0.3, "-0.3  mm")
    assert rain["color_class"] == "#f7f7f7"
    assert json.loads(rain["geometry"]) == {"type": "Point", "coordinates": [5, 15]}
    assert (found[25, "storm"]["value"], found[25, "storm"]["label"]) == (12.5, "12.5 Unwetter")
    assert found[25, "temp"]["value"] is None and found[25, "temp"]["label"] is None
    assert found[25, "temp"]["color_class"] is None
    assert found[15, "storm"]["label"] is None


@pytest.mark.parametrize("raw, labels", [
    ([125.0, -7.0, 3.04], ["12.5", "-0.7", " 0.3"]),
    ([996.0, 5.0, 0.0], ["99.6", " 0.5", " 0.0"]),
    ([1234.0, -250.0, None], ["123", "-25", None]),
    ([0.1, 0.123, 100.0], [" 0.010", " 0.012", "10.000"]),
])
def test_labels_share_a_format(spark, raw, labels):
    """As many decimals as two significant digits of every value need, and one width."""
    rows = [(1917, 5, 10 * n + 5) for n in range(3)]
    values = F.element_at(F.array(*[F.lit(v).cast("double") for v in raw]),
                          ((F.col("Long") - 5) / 10 + 1).cast("int"))
    given = wide(spark, rows).withColumn("PRCP_year", values)
    layer = map_layer(given, tile_polygons(given, 10), 1917, "year").where("layer = 'prec'")
    found = [r["label"] for r in layer.orderBy("Long").collect()]
    assert found == [None if x is None else x + "  mm" for x in labels]


def test_a_tile_without_polygon_keeps_its_values(spark):
    given = wide(spark, [(1917, 15, 5)])
    layer = map_layer(given, tile_polygons(given, 10).limit(0), 1917, "winter")
    found = {r["layer"]: r for r in layer.collect()}
    assert set(found) == {"temp", "prec", "storm"}
    assert found["temp"]["geometry"] is None and found["temp"]["value"] is not None


@pytest.mark.parametrize(
    "value, color", [(-120.0, "#053061"), (120.0, "#67001f"), (0.0, "#f7f7f7"), (121.0, None)]
)
def test_ends_of_the_scale(spark, value, color):
    given = wide(spark, [(1917, 15, 5)], lambda: value)
    layer = with_color(map_layer(given, tile_polygons(given, 10), 1917, "summer"))
    assert layer.where("layer = 'temp'").first()["color_class"] == color


def test_year_lookup(spark, places):
    with pytest.raises(ValueError):
        year_lookup(wide(spark, places), 1917, "spring")
    assert year_lookup(wide(spark, places), 1918, "winter").count() == 3


def test_global_series(spark):
    given = spark.createDataFrame(
        [(1917, 5, 5, 10.0, 20.0, 1.0, *[None] * 6), (1917, 15, 5, 30.0, None, 2.0, *[None] * 6),
         (2016, 5, 5, 1.0, 1.0, 1.0, *[None] * 6)], SCHEMA,
    )
    co2 = spark.createDataFrame([(1917, 3.5), (1800, 1.0)], "Year INT, Total_in_mega_tons DOUBLE")
    series = global_series(given, co2)
    assert rows(series, "Year", "PRCP_year", "TMAX_year", "WTXX_year", "PRCP_winter",
                "Total_in_mega_tons") == [
        (1917, 2.0, 2.0, 1.5, None, 3.5), (2016, 0.1, 0.1, 1.0, None, None),
    ]
    long = series_long(series)
    assert long.count() == 2 * len(SERIES)
    assert series_long(global_series(given)).count() == 2 * len(MEASURES)
    storm = long.where("series = 'WTXX_summer'").first()
    assert storm["title"] == (
        "Entwicklung der globalen Differenz der normierten Unwetteranzahl (Anz. Unwetter / Anz."
        " Stationen) pro Sommerliches Halbjahr (4. Mai - 3. Nov.)\nim Vergleich zur Baseline"
        " (Durchschnittswerte der Jahre 1917-1946)"
    )
    assert long.where("series = 'Total_in_mega_tons'").first()["unit"] == "CO2-Ausstoß (Mt)"


def test_a_year_is_replaced_alone(spark, places, tmp_path):
    path = str(tmp_path / "table")
    given = wide(spark, places)
    write_by_year(given, path)
    write_by_year(given.where("Year = 1918 AND Lat < 0"), path)
    stored = read_result(spark, path)
    assert rows(stored.groupBy("Year").count(), "Year", "count") == [
        (1917, 4), (1918, 2), (1920, 4)
    ]
    one_year = stored.where("Year = 1918")
    assert "PartitionFilters: [isnotnull(Year" in plan(one_year)


def test_csv_exports(spark, places, tmp_path):
    given = wide(spark, places).select(*MEASURES, "Lat", "Long", "Year")
    path = str(tmp_path / "csv")
    export_csv(given, path)
    export_csv(given, path, append=True)
    read = read_result_csv(spark, path)
    assert read.dtypes == given.dtypes
    assert read.count() == 2 * len(places)
    tiles = spark.createDataFrame([("9-18",)], "Tile_Id STRING")
    export_csv(tiles, str(tmp_path / "tiles"))
    assert rows(read_tiles(spark, str(tmp_path / "tiles")), "Tile_Id") == [("9-18",)]
    values = spark.createDataFrame(
        [("0101", "PRCP", "9-18", 0.5)],
        "Date STRING, Element STRING, Tile_Id STRING, Value DOUBLE",
    )
    export_csv(values, str(tmp_path / "values"), header=False)
    assert rows(read_daily_values(spark, str(tmp_path / "values") + "/*"), "Date", "Value") == [
        ("0101", 0.5)
    ]


def test_collections_are_ordered(spark, places):
    collections = feature_collections(feature_ids(tile_polygons(wide(spark, places), 10)))
    for r in collections.collect():
        ids = [f["id"] for f in json.loads(r["json"])["features"]]
        assert ids == sorted(ids)
