"""The whole batch run: files in, result table out."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import ClimateConfig
from ..operators.baseline import stored_baseline
from ..published import publish_by_year
from ..session import files_label, path_exists
from ..sinks.tables import export_baseline, read_about
from ..sources.observations import (
    check_rejects, read_checked_observations, read_observations, rejected_observations,
    rejects_per_file, sound_observations, yearly_files,
)
from ..sources.stations import read_stations
from ..sources.tables import read_daily_values
from .anomalies import ClimateTables, build_yearly_anomalies

#: What of the configuration a baseline depends on.
BASELINE_FIELDS = (
    "tile_size", "year_start_baseline", "year_span_baseline", "coverage_threshold", "coverage_days",
)


class BaselineMismatch(ValueError):
    """A saved baseline belongs to another grid, span, coverage or input."""


def about_baseline(
    spark: SparkSession, folder: str, stations_path: str, config: ClimateConfig
) -> dict:
    """What a baseline is made of: the configuration, and a label for each file of its years and
    for the station list. A file that is gone has none."""
    years = range(config.year_start_baseline, config.year_end_baseline + 1)
    files = {file.rpartition("/")[2]: file for file in yearly_files(folder, years)}
    files["stations"] = stations_path
    return {
        **{name: getattr(config, name) for name in BASELINE_FIELDS},
        "files": {
            name: files_label(spark, file) if path_exists(spark, file) else None
            for name, file in files.items()
        },
    }


def check_baseline(saved: dict | None, wanted: dict, path: str) -> None:
    """Raises BaselineMismatch unless the saved baseline is the one that this run would make. Files
    of its years that are gone cannot tell, those that are there must be the same."""
    if saved is None:
        raise BaselineMismatch(f"the baseline under {path} does not say what it was made of")
    found = [
        f"{name} is {saved.get(name)!r}, not {wanted[name]!r}"
        for name in BASELINE_FIELDS if saved.get(name) != wanted[name]
    ]
    found += [
        f"{name} has changed" for name, label in wanted["files"].items()
        if label is not None and saved["files"].get(name) != label
    ]
    if found:
        raise BaselineMismatch(f"the baseline under {path} does not fit: {'; '.join(found)}")


def generate_result(
    spark: SparkSession,
    observations_folder: str,
    stations_path: str,
    result_path: str,
    config: ClimateConfig = ClimateConfig(),
    stage_path: str | None = None,
    baseline_path: str | None = None,
    reuse_baseline: bool = False,
    rejects_path: str | None = None,
    most_rejects: float = 1.0,
) -> ClimateTables:
    """Observation files ``<year>.csv`` and the station list to the wide table, published by Year;
    it replaces an earlier result as a whole, and readers have the earlier one until it is complete.
    Files that a needed year lacks are an error.

    The baseline is saved under ``baseline_path`` if one is given, with a note of what it was made
    of; with ``reuse_baseline`` it is read from there instead, and a note that names another grid,
    span, coverage or input raises BaselineMismatch.

    With ``rejects_path``, unsound rows (``read_checked_observations``) are written there with their
    file and stay out of the run, which stops before it computes anything if more than the share
    ``most_rejects`` of a file's rows is unsound. Without it, fields that cannot be read are NULL."""
    if reuse_baseline and not baseline_path:
        raise ValueError("reuse_baseline needs baseline_path")
    about = None
    if baseline_path:
        about = about_baseline(spark, observations_folder, stations_path, config)
    if reuse_baseline:
        check_baseline(read_about(spark, baseline_path), about, baseline_path)
    files = yearly_files(observations_folder, config.years_read(not reuse_baseline))
    if rejects_path is None:
        observations = read_observations(spark, files)
    else:
        checked = read_checked_observations(spark, files)
        rejected_observations(checked).write.mode("overwrite").parquet(rejects_path)
        check_rejects(rejects_per_file(checked), most_rejects)
        observations = sound_observations(checked)
    tables = build_yearly_anomalies(
        spark,
        observations,
        read_stations(spark, stations_path),
        config,
        stage_path,
        baseline=stored_baseline(read_daily_values(spark, baseline_path))
        if reuse_baseline else None,
        inputs=f"{files_label(spark, *files, stations_path)} {rejects_path is None}"
        if stage_path else None,
    )
    if baseline_path and not reuse_baseline:
        export_baseline(tables.baseline, baseline_path, about)
    publish_by_year(tables.wide, result_path, whole=True)
    return tables
