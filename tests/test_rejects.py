"""Unsound rows of observation files: found, counted, kept apart, and a reason to stop."""

import pytest

from gridclim import generate_result
from gridclim.sources import (
    TooManyRejects, check_rejects, read_checked_observations, read_observations, read_result,
    rejected_observations, rejects_per_file, sound_observations,
)

from helpers import rows
from test_anomalies import CONFIG
from test_generate import result_rows, write_files

GOOD = ["A,19170101,TMAX,12,,,S,0700", "A,19160229,PRCP,,,,,", "B,19170102,WT03,-4,m,G,s,"]
BAD = {
    "A,19170101,TMAX": "line", "A,19170101,TMAX,1,,,,,,": "line", "A,19170101,TMAX,x,,,,": "line",
    "A,19170101,TMAX,1.5,,,,": "line", "A,19170101,TMAX,99999999999,,,,": "line", "nothing": "line",
    ",19170101,TMAX,1,,,,": "station", "  ,19170101,TMAX,1,,,,": "station",
    "A,19170229,TMAX,1,,,,": "date", "A,1917011,TMAX,1,,,,": "date", "A,,TMAX,1,,,,": "date",
    "A,1917-1-1,TMAX,1,,,,": "date", "A,19170101,,1,,,,": "element",
}


def test_kinds_of_rejects(spark, tmp_path):
    file = tmp_path / "1917.csv"
    file.write_text("\n".join([*GOOD, *BAD]) + "\n")
    (tmp_path / "empty.csv").write_text("")
    checked = read_checked_observations(spark, str(tmp_path))
    found = {r["line"]: r["reject"] for r in rejected_observations(checked).collect()}
    assert found == BAD
    (tmp_path / "good.csv").write_text("\n".join(GOOD) + "\n")
    sound = sound_observations(read_checked_observations(spark, str(file)))
    wanted = read_observations(spark, str(tmp_path / "good.csv"))
    assert sound.columns == wanted.columns
    assert rows(sound, *sound.columns) == rows(wanted, *wanted.columns)
    (row,) = rejects_per_file(read_checked_observations(spark, str(file))).collect()
    assert row["file"].endswith("1917.csv")
    assert tuple(row)[1:] == (len(GOOD) + len(BAD), len(BAD), 6, 2, 4, 1)


def test_the_counts_do_not_depend_on_the_columns_read(spark, tmp_path):
    (tmp_path / "1917.csv").write_text("\n".join([*GOOD, *BAD]) + "\n")
    checked = read_checked_observations(spark, str(tmp_path))
    assert checked.where("reject IS NULL").count() == len(GOOD)
    assert checked.select("Station", "reject").where("reject = 'line'").count() == 6
    assert rows(checked.groupBy("reject").count().where("reject = 'date'"), "count") == [(4,)]


def test_a_limit_names_the_worst_files(spark, tmp_path):
    (tmp_path / "1917.csv").write_text("\n".join(GOOD * 5 + list(BAD)[:1]) + "\n")
    (tmp_path / "1918.csv").write_text("\n".join(GOOD + list(BAD)[:3]) + "\n")
    per_file = rejects_per_file(read_checked_observations(spark, str(tmp_path)))
    check_rejects(per_file, 0.5)
    with pytest.raises(TooManyRejects, match="1918.csv: 3 of 6 rows$"):
        check_rejects(per_file, 0.2)
    with pytest.raises(TooManyRejects, match="1918.csv: 3 of 6 rows; .*1917.csv: 1 of 16 rows"):
        check_rejects(per_file, 0)


def test_a_run_leaves_rejects_out_or_stops(spark, tmp_path):
    write_files(spark, tmp_path / "by_year")
    files = (str(tmp_path / "by_year"), str(tmp_path / "stations.txt"))
    result, rejects = str(tmp_path / "result"), str(tmp_path / "rejects")
    generate_result(spark, *files, result, CONFIG)
    before = result_rows(read_result(spark, result))
    generate_result(spark, *files, result, CONFIG, rejects_path=rejects, most_rejects=0)
    assert result_rows(read_result(spark, result)) == before
    assert spark.read.parquet(rejects).count() == 0
    file = tmp_path / "by_year" / "1919.csv"
    file.write_text(file.read_text() + "A,19190101,TMAX\n" * 2 + "A,19199901,TMAX,5,,,,\n")
    with pytest.raises(TooManyRejects, match="1919.csv"):
        generate_result(spark, *files, result, CONFIG, rejects_path=rejects, most_rejects=0)
    assert rows(spark.read.parquet(rejects), "reject") == [("date",), ("line",), ("line",)]
    assert result_rows(read_result(spark, result)) == before
    generate_result(spark, *files, result, CONFIG, rejects_path=rejects, most_rejects=0.5)
    assert result_rows(read_result(spark, result)) == before
