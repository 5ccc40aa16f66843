"""New versions beside old ones, and the pointer between them."""

import json

import pytest
from pyspark.sql import functions as F

from gridclim import ClimateConfig, generate_result, publish_polygons, published
from gridclim.plans import BaselineMismatch
from gridclim.published import (
    PublishConflict, publish_by_year, read_pointer, read_published, write_pointer,
)
from gridclim.sources import explode_features, read_feature_collections, read_result

from helpers import plan, rows
from test_anomalies import CONFIG
from test_generate import result_rows, write_files


def years(spark, made):
    return spark.createDataFrame(made, "Year INT, v STRING")


def test_years_replace_years(spark, tmp_path):
    path = str(tmp_path / "table")
    publish_by_year(years(spark, [(1, "a"), (2, "b"), (3, "c")]), path)
    publish_by_year(years(spark, [(2, "B"), (4, "d")]), path, years=[2, 3])
    assert rows(read_published(spark, path), "Year", "v") == [(1, "a"), (2, "B"), (4, "d")]
    publish_by_year(years(spark, [(9, "z")]), path, whole=True)
    assert rows(read_published(spark, path), "Year", "v") == [(9, "z")]
    assert rows(read_result(spark, path), "v") == [("z",)]
    publish_by_year(years(spark, []), path, whole=True)
    empty = read_published(spark, path)
    assert empty.count() == 0 and set(empty.columns) == {"Year", "v"}


def test_only_the_asked_year_is_read(spark, tmp_path):
    path = str(tmp_path / "table")
    publish_by_year(years(spark, [(1, "a"), (2, "b")]), path)
    chosen = read_published(spark, path).where("Year = 2")
    assert "PartitionFilters: [isnotnull(Year" in plan(chosen)
    assert rows(chosen, "v") == [("b",)]


def test_old_versions_go_after_the_next_but_one(spark, tmp_path):
    path = tmp_path / "table"
    for value in "abcd":
        publish_by_year(years(spark, [(1, value)]), str(path), whole=True)
    assert len(list(path.glob("version=*"))) == 2 and len(list(path.glob("_pointers/0*"))) == 2
    begun = read_published(spark, str(path))
    publish_by_year(years(spark, [(1, "e")]), str(path), whole=True)
    assert rows(begun, "v") == [("d",)]  # a reader that had begun can finish


@pytest.mark.parametrize("step", ["write", "pointer"])
def test_a_run_that_dies_leaves_the_earlier_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "table")
    publish_by_year(years(spark, [(1, "a"), (2, "b")]), path)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        if step == "pointer":
            patched.setattr(published, "write_pointer", die)
            made = years(spark, [(1, "A")])
        else:  # the job dies within its tasks, when part of its files is written
            made = spark.range(2).select(
                (F.col("id") + 1).cast("int").alias("Year"),
                F.when(F.col("id") == 1, F.raise_error(F.lit("dead"))).otherwise("A").alias("v"),
            )
        with pytest.raises(BaseException):
            publish_by_year(made, path, whole=True)
    assert rows(read_published(spark, path), "Year", "v") == [(1, "a"), (2, "b")]
    publish_by_year(years(spark, [(1, "A")]), path, whole=True)
    assert rows(read_published(spark, path), "Year", "v") == [(1, "A")]


def test_two_runs_at_a_time_cannot_both_win(spark, tmp_path):
    path = str(tmp_path / "table")
    publish_by_year(years(spark, [(1, "a")]), path)
    before = read_pointer(spark, path)
    write_pointer(spark, path, {"folders": {}, "schema": before["schema"], "text": False}, before)
    with pytest.raises(PublishConflict):
        write_pointer(spark, path, before, before)


def test_a_batch_run_that_dies_keeps_the_result(spark, tmp_path, monkeypatch):
    write_files(spark, tmp_path / "by_year")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    result, geojson = str(tmp_path / "result"), str(tmp_path / "geojson")
    generate_result(spark, *files, result, CONFIG)
    publish_polygons(read_result(spark, result), geojson, 10)
    before = result_rows(read_result(spark, result))
    features = explode_features(read_feature_collections(spark, geojson)).count()
    smaller = ClimateConfig(1917, 1919, 1917, 2, 0.8, 30, days_divisor=1)

    def die(*_):
        raise RuntimeError("dead")

    with monkeypatch.context() as patched:
        patched.setattr(published, "write_pointer", die)
        with pytest.raises(RuntimeError, match="dead"):
            generate_result(spark, *files, result, smaller)
        with pytest.raises(RuntimeError, match="dead"):
            publish_polygons(read_result(spark, result).where("Year = 1917"), geojson, 10)
    assert result_rows(read_result(spark, result)) == before
    read = explode_features(read_feature_collections(spark, geojson))
    assert read.count() == features == len(before)
    publish_polygons(read_result(spark, result).where("Year = 1917"), geojson, 10)
    assert [p.name for p in (tmp_path / "geojson").glob("Year=*")] == ["Year=1917"]


@pytest.mark.parametrize("change", [
    {"tile_size": 18}, {"year_start_baseline": 1918}, {"year_span_baseline": 3},
    {"coverage_threshold": 0.5}, {"days_divisor": 2},
])
def test_a_baseline_of_another_run_is_refused(spark, tmp_path, change):
    write_files(spark, tmp_path / "by_year")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    result, baseline = str(tmp_path / "result"), str(tmp_path / "baseline")
    generate_result(spark, *files, result, CONFIG, baseline_path=baseline)
    before = result_rows(read_result(spark, result))
    other = ClimateConfig(**{
        **{n: getattr(CONFIG, n) for n in CONFIG.__dataclass_fields__}, **change
    })
    with pytest.raises(BaselineMismatch, match="does not fit"):
        generate_result(
            spark, *files, result, other, baseline_path=baseline, reuse_baseline=True
        )
    assert result_rows(read_result(spark, result)) == before


def test_a_baseline_of_other_files_or_without_a_note_is_refused(spark, tmp_path):
    write_files(spark, tmp_path / "by_year")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    result, baseline = str(tmp_path / "result"), str(tmp_path / "baseline")
    again = {"baseline_path": baseline, "reuse_baseline": True}
    generate_result(spark, *files, result, CONFIG, baseline_path=baseline)
    about = json.loads((tmp_path / "baseline" / "_about.json").read_text())
    assert about["tile_size"] == 10 and set(about["files"]) == {"1917.csv", "1918.csv", "stations"}
    # A year outside the span may change, and files of the span may be gone.
    later = tmp_path / "by_year" / "1920.csv"
    later.write_text(later.read_text() + "X,19200101,TMAX,1,,,,\n")
    generate_result(spark, *files, result, CONFIG, **again)
    file = tmp_path / "by_year" / "1918.csv"
    text = file.read_text()
    file.write_text(text.replace(",TMAX,", ",TMAX,1"))
    with pytest.raises(BaselineMismatch, match="1918.csv has changed"):
        generate_result(spark, *files, result, CONFIG, **again)
    file.write_text(text)
    (tmp_path / "baseline" / "_about.json").unlink()
    with pytest.raises(BaselineMismatch, match="does not say"):
        generate_result(spark, *files, result, CONFIG, **again)
