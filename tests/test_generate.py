"""From files to the published result."""

import pytest
from pyspark.sql import functions as F

from gridclim import ClimateConfig, build_yearly_anomalies, generate_result, publish_polygons
from gridclim.config import MEASURES
from gridclim.sources import explode_features, read_feature_collections, read_result

from helpers import plan, rows, stations
from test_anomalies import CONFIG, STATIONS, cells, years_of_observations

COLUMNS = ["Year", "Tile_Id", "Lat", "Long"] + list(MEASURES)


def result_rows(df):
    return rows(df.select("Year", "Tile_Id", "Lat", "Long", *cells()), *COLUMNS)


def write_files(spark, folder):
    seen = years_of_observations(spark).collect()
    folder.mkdir()
    for year in range(1917, 1922):
        lines = [
            f"{r['Station']},{r['Date']},{r['Element']},{r['Value']},,,S,\n"
            for r in seen if r["Year"] == year
        ]
        (folder / f"{year}.csv").write_text("".join(lines))
    text = "\n".join(f"{i:11}{lat:9.4f}{long:10.4f}{0:7.1f}" for i, lat, long in STATIONS)
    (folder.parent / "stations.txt").write_text(text)


def test_files_to_result(spark, tmp_path):
    write_files(spark, tmp_path / "by_year")
    result, baseline = str(tmp_path / "result"), str(tmp_path / "baseline")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    generate_result(spark, *files, result, CONFIG, baseline_path=baseline)
    expected = result_rows(
        build_yearly_anomalies(
            spark, years_of_observations(spark), stations(spark, STATIONS), CONFIG
        ).wide
    )
    assert result_rows(read_result(spark, result)) == expected
    again = str(tmp_path / "again")
    tables = generate_result(
        spark, *files, again, CONFIG, baseline_path=baseline, reuse_baseline=True
    )
    assert result_rows(read_result(spark, again)) == expected
    assert tables.tiles.count() == 3
    publish_polygons(read_result(spark, result), str(tmp_path / "geojson"), 10)
    features = explode_features(read_feature_collections(spark, str(tmp_path / "geojson")))
    assert features.select(F.max("id")).first()[0] == len(expected)


def test_a_new_run_replaces_the_result(spark, tmp_path):
    """Fewer years and another tile size leave nothing of the earlier result and polygons."""
    write_files(spark, tmp_path / "by_year")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    result, geojson = str(tmp_path / "result"), str(tmp_path / "geojson")
    generate_result(spark, *files, result, CONFIG)
    publish_polygons(read_result(spark, result), geojson, 10)
    smaller = ClimateConfig(1917, 1919, 1917, 2, 0.8, 30, days_divisor=1)
    generate_result(spark, *files, result, smaller)
    wide = read_result(spark, result)
    assert {r["Year"] for r in wide.collect()} == {1917, 1918, 1919}
    publish_polygons(wide, geojson, 30)
    features = explode_features(read_feature_collections(spark, geojson))
    assert sorted(r["id"] for r in features.collect()) == list(range(1, wide.count() + 1))


def test_corrected_files_are_seen(spark, tmp_path):
    write_files(spark, tmp_path / "by_year")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    result, stage = str(tmp_path / "result"), str(tmp_path / "stage")
    generate_result(spark, *files, result, CONFIG, stage_path=stage)
    before = result_rows(read_result(spark, result))
    generate_result(spark, *files, result, CONFIG, stage_path=stage)
    assert result_rows(read_result(spark, result)) == before
    file = tmp_path / "by_year" / "1920.csv"
    file.write_text(file.read_text().replace(",TMAX,", ",TMAX,1"))
    generate_result(spark, *files, result, CONFIG, stage_path=stage)
    after = result_rows(read_result(spark, result))
    assert after != before and len(after) == len(before)


def test_only_needed_files_are_opened(spark, tmp_path):
    """With a saved baseline, the files of its years may be gone."""
    write_files(spark, tmp_path / "by_year")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    result, baseline = str(tmp_path / "result"), str(tmp_path / "baseline")
    config = ClimateConfig(1920, 1921, 1917, 2, 0.8, 10, days_divisor=1)
    (tmp_path / "by_year" / "1919.csv").unlink()  # between the two ranges
    generate_result(spark, *files, result, config, baseline_path=baseline)
    expected = result_rows(read_result(spark, result))
    for year in (1917, 1918):
        (tmp_path / "by_year" / f"{year}.csv").unlink()
    again = str(tmp_path / "again")
    generate_result(spark, *files, again, config, baseline_path=baseline, reuse_baseline=True)
    assert result_rows(read_result(spark, again)) == expected and expected


def test_one_year_of_polygons(spark, tmp_path):
    wide = spark.createDataFrame(
        [(1917, 5, 5), (1917, 5, 15), (1918, 5, 5)], "Year INT, Lat INT, Long INT"
    )
    publish_polygons(wide, str(tmp_path / "geojson"), 10)
    collections = read_feature_collections(spark, str(tmp_path / "geojson"), 1918)
    assert [r["id"] for r in explode_features(collections).collect()] == [3]
    assert "PartitionFilters: [isnotnull(Year" in plan(collections)


def test_reuse_needs_a_path(spark):
    with pytest.raises(ValueError):
        generate_result(spark, "a", "b", "c", reuse_baseline=True)
