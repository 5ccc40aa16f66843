"""The queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from .. import sinks, sources
from ..config import MEASURES
from ..functions.calendar import year_of
from ..plans import (
    ClimateTables, build_yearly_anomalies, climate_tables, generate_result, keep_stage,
    publish_polygons,
)
from ..session import files_label, rename_path, scratch_path
from ..streaming import YearlyIncrements
from . import inputs
from .inputs import CONFIG, STRICT_CONFIG

SIZE = CONFIG.tile_size
QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Means depend on the order of summation in their last digits. These are cut off first, so
    that a value halfway between two results always goes up."""
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in columns})


def round_half_up(value: Column, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    return F.floor(F.round(value, digits + 3) * scale + F.lit(0.5)) / scale


def tiled_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tile_stations(inputs.stations(spark, sf_dir), SIZE)


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_tiles(spark, sf_dir, inputs.observations(spark, sf_dir))


def on_tiles(spark: SparkSession, sf_dir: str, observations: DataFrame) -> DataFrame:
    listed = tiled_stations(spark, sf_dir)
    return op.tiled_observations(observations, listed, op.fits_broadcast(listed))


def climate(spark: SparkSession, sf_dir: str, config=CONFIG, stage_path=None) -> ClimateTables:
    label = None
    if stage_path:
        label = files_label(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet")
    return build_yearly_anomalies(
        spark, inputs.observations(spark, sf_dir), inputs.stations(spark, sf_dir), config,
        stage_path, inputs=label,
    )


def stored_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table, written by Year and read back, for queries that use it more than once."""
    path = scratch_path(spark, "result")
    sinks.write_by_year(climate(spark, sf_dir).wide, path)
    return sources.read_result(spark, path)


def co2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.co2_series(inputs.co2_lines(spark, sf_dir))


def global_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.global_series(climate(spark, sf_dir).wide, co2(spark, sf_dir))


def ring_text() -> Column:
    return F.to_json("geometry.coordinates").alias("ring")


# Stations and observations


@query
def tile_stations(spark, sf_dir):
    return tiled_stations(spark, sf_dir)


@query
def station_fixed_width(spark, sf_dir):
    return sources.parse_station_lines(inputs.station_lines(spark, sf_dir))


@query
def station_file(spark, sf_dir):
    """The station list written as a text file and read back."""
    path = scratch_path(spark, "stations")
    inputs.station_lines(spark, sf_dir).write.text(path)
    return op.tile_stations(sources.read_stations(spark, path), SIZE)


@query
def tile_centres(spark, sf_dir):
    return op.tile_centres(tiled_stations(spark, sf_dir))


@query
def tiled_observations(spark, sf_dir):
    return tiled(spark, sf_dir)


@query
def observation_files(spark, sf_dir):
    """Yearly CSV files, read with their fixed schema, up to the daily values."""
    path = _write_yearly_csv(spark, sf_dir, "observations", F.col("Date"))
    read = sources.read_observations(spark, path)
    daily = op.daily_tile_values(on_tiles(spark, sf_dir, read))
    return rounded(daily, "Value")


@query
def year_mismatch_audit(spark, sf_dir):
    """Observations filed under the year of the day 30 days before their date."""
    filed = F.date_format(
        F.date_sub(F.to_date("Date", "yyyyMMdd"), 30), "yyyyMMdd"
    )
    path = _write_yearly_csv(spark, sf_dir, "misfiled", filed)
    audit = sources.year_mismatch_audit(spark, path)
    return audit.groupBy("file_year", "Year").agg(F.sum("n").alias("n"))


@query
def unknown_station_audit(spark, sf_dir):
    return op.unknown_station_audit(
        inputs.observations(spark, sf_dir), inputs.listed_stations(spark, sf_dir)
    )


@query
def rejected_lines(spark, sf_dir):
    """Yearly files with short lines, words for numbers and days that are none: rejects per file."""
    path = scratch_path(spark, "faulty")
    lines = inputs.faulty_lines(spark, sf_dir)
    lines.hint("rebalance", F.col("Year")).write.partitionBy("Year").text(path)
    per_file = sources.rejects_per_file(sources.read_checked_observations(spark, path))
    counts = ("n_rows", "n_rejects", "line", "station", "date", "element")
    year = F.regexp_extract("file", "/Year=([0-9]+)/", 1).cast("int")
    return per_file.groupBy(year.alias("Year")).agg(*[F.sum(c).alias(c) for c in counts])


# Coverage


@query
def active_days_per_year(spark, sf_dir):
    return op.active_days_per_year(tiled(spark, sf_dir))


@query
def stored_day_bitmaps(spark, sf_dir):
    """Active days from bitmaps of days, stored in two parts and merged."""
    rows = tiled(spark, sf_dir)
    parts = [
        keep_stage(
            spark, lambda part=part: op.day_bitmaps(rows.where(part)), scratch_path(spark, "days")
        )
        for part in (F.col("Element") == "PRCP", F.col("Element") != "PRCP")
    ]
    return op.days_counted(op.merged_bitmaps(parts[0].unionByName(parts[1])))


@query
def stored_station_bitmaps(spark, sf_dir):
    """Reporting stations per tile and year from bitmaps of their numbers, stored and merged."""
    listed = op.numbered_stations(tiled_stations(spark, sf_dir))
    rows = op.tiled_observations(
        inputs.observations(spark, sf_dir), listed, op.fits_broadcast(listed)
    )
    parts = [
        keep_stage(
            spark, lambda part=part: op.station_bitmaps(rows.where(part)),
            scratch_path(spark, "stations"),
        )
        for part in (F.col("Element") == "PRCP", F.col("Element") != "PRCP")
    ]
    return op.stations_counted(op.merged_bitmaps(parts[0].unionByName(parts[1])))


@query
def active_tiles_per_year(spark, sf_dir):
    return op.active_tiles_per_year(
        tiled(spark, sf_dir), STRICT_CONFIG.coverage_days, STRICT_CONFIG.coverage_threshold
    )


@query
def tiles_active_in(spark, sf_dir):
    return op.tiles_active_in(
        active_tiles_per_year(spark, sf_dir), STRICT_CONFIG.year_start_baseline
    )


@query
def active_tiles(spark, sf_dir):
    years = CONFIG.year_end_data - CONFIG.year_start_data + 1
    return op.active_tiles(active_tiles_per_year(spark, sf_dir), years, 0.5)


@query
def initial_tiles(spark, sf_dir):
    return op.initial_tiles(tiled(spark, sf_dir), STRICT_CONFIG)


@query
def saved_tiles(spark, sf_dir):
    """The initial tiles written as CSV and read back."""
    path = scratch_path(spark, "tiles")
    sinks.export_csv(initial_tiles(spark, sf_dir), path)
    return sources.read_tiles(spark, path)


@query
def restrict_to_tiles(spark, sf_dir):
    tiles = climate(spark, sf_dir, STRICT_CONFIG).tiles
    return op.restrict_to_tiles(tiled(spark, sf_dir), tiles)


# Daily values, baseline and anomalies


@query
def station_count(spark, sf_dir):
    rows = tiled(spark, sf_dir)
    counts = keep_stage(spark, lambda: op.station_counts(rows), scratch_path(spark, "counts"))
    return op.with_station_count(rows, counts, op.fits_broadcast(counts))


@query
def daily_tile_mean(spark, sf_dir):
    return rounded(op.daily_tile_mean(tiled(spark, sf_dir)), "Value")


@query
def daily_storm_rate(spark, sf_dir):
    return rounded(op.daily_storm_rate(tiled(spark, sf_dir)), "Value")


@query
def daily_tile_values(spark, sf_dir):
    return rounded(op.daily_tile_values(tiled(spark, sf_dir)), "Value")


@query
def daily_values_reread(spark, sf_dir):
    """Daily values written as CSV, the last year appended, read back and averaged."""
    daily = climate(spark, sf_dir).daily
    path = scratch_path(spark, "daily")
    last = F.col("Year") == CONFIG.year_end_baseline
    for chosen in (~last, last):
        part = daily.where(chosen).select("Date", "Element", "Tile_Id", "Value")
        sinks.export_csv(part, path, append=chosen is last, header=False)
    stored = sources.with_year(sources.read_daily_values(spark, path))
    return rounded(op.baseline_year(stored, CONFIG), "Value_baseline")


@query
def baseline_year(spark, sf_dir):
    return rounded(climate(spark, sf_dir, STRICT_CONFIG).baseline, "Value_baseline")


@query
def baseline_tiles(spark, sf_dir):
    return op.baseline_tiles(climate(spark, sf_dir, STRICT_CONFIG).baseline)


@query
def saved_baseline(spark, sf_dir):
    """Anomalies against a baseline that was saved as CSV and read back."""
    tables = climate(spark, sf_dir)
    path = scratch_path(spark, "baseline")
    sinks.export_baseline(tables.baseline, path)
    stored = op.stored_baseline(sources.read_daily_values(spark, path))
    return rounded(climate_tables(tables.daily, CONFIG, stored).anomalies, "Value")


@query
def daily_anomaly(spark, sf_dir):
    return rounded(climate(spark, sf_dir).anomalies, "Value")


@query
def segment_means(spark, sf_dir):
    return rounded(op.segment_means(climate(spark, sf_dir).anomalies), "Value")


# The wide table


@query
def wide_pivot(spark, sf_dir):
    means = op.segment_means(climate(spark, sf_dir).anomalies)
    return rounded(op.spread_segment(means, "summer"), *[m for m in MEASURES if "summer" in m])


@query
def wide_full_join(spark, sf_dir):
    means = op.segment_means(climate(spark, sf_dir).anomalies)
    wide = op.wide_from_segments(means)
    return rounded(
        op.attach_centres(wide, op.tile_centres(tiled_stations(spark, sf_dir))), *MEASURES
    )


@query
def yearly_anomalies(spark, sf_dir):
    return rounded(climate(spark, sf_dir).wide, *MEASURES)


@query
def yearly_anomalies_strict(spark, sf_dir):
    return rounded(climate(spark, sf_dir, STRICT_CONFIG).wide, *MEASURES)


@query
def restarted_anomalies(spark, sf_dir):
    """A second run that starts from the stage of the first."""
    path = scratch_path(spark, "restart")
    climate(spark, sf_dir, stage_path=path)
    return rounded(climate(spark, sf_dir, stage_path=path).wide, *MEASURES)


@query
def yearly_increment(spark, sf_dir):
    """All years written with wrong values first, then replaced year by year except the last."""
    wide = stored_result(spark, sf_dir)
    path = scratch_path(spark, "increment")
    sinks.write_by_year(wide.withColumns({m: F.col(m) + 1 for m in MEASURES}), path)
    for year in range(CONFIG.year_start_data, CONFIG.year_end_data):
        sinks.write_by_year(wide.where(F.col("Year") == year), path)
    return rounded(sources.read_result(spark, path), *MEASURES)


def yearly_input_files(spark, sf_dir) -> tuple[str, str]:
    """The observations as ``<year>.csv`` and the station list, as files."""
    folder, listed = _write_yearly_csv(spark, sf_dir, "by-year", F.col("Date")), (
        scratch_path(spark, "stations")
    )
    for year in CONFIG.years_read():
        rename_path(spark, f"{folder}/Year={year}", f"{folder}/{year}.csv")
    inputs.station_lines(spark, sf_dir).write.text(listed)
    return folder, listed


@query
def generated_result(spark, sf_dir):
    """The whole batch run, from yearly files to the stored result."""
    path = scratch_path(spark, "result")
    generate_result(spark, *yearly_input_files(spark, sf_dir), path, CONFIG)
    return rounded(sources.read_result(spark, path), *MEASURES)


@query
def generated_with_saved_baseline(spark, sf_dir):
    """A second batch run that takes its baseline from the file that the first one saved."""
    files, path = yearly_input_files(spark, sf_dir), scratch_path(spark, "result")
    baseline = scratch_path(spark, "baseline")
    generate_result(spark, *files, path, CONFIG, baseline_path=baseline)
    generate_result(
        spark, *files, path, CONFIG, baseline_path=baseline, reuse_baseline=True
    )
    return rounded(sources.read_result(spark, path), *MEASURES)


@query
def rerun_replaces_result(spark, sf_dir):
    """A run over fewer years into the result of an earlier one leaves none of its years."""
    files, path = yearly_input_files(spark, sf_dir), scratch_path(spark, "result")
    generate_result(spark, *files, path, CONFIG)
    shorter = dataclasses.replace(CONFIG, year_end_data=CONFIG.year_end_data - 2)
    generate_result(spark, *files, path, shorter)
    return rounded(sources.read_result(spark, path), *MEASURES)


@query
def streamed_increments(spark, sf_dir):
    """The wide table kept up to date while the yearly files arrive as a stream."""
    incoming = _write_yearly_csv(spark, sf_dir, "incoming", F.col("Date"))
    store, result = scratch_path(spark, "store"), scratch_path(spark, "result")
    increments = YearlyIncrements(
        spark, tiled_stations(spark, sf_dir), climate(spark, sf_dir).baseline, store, result,
        CONFIG,
    )
    stream = increments.start(
        f"{incoming}/*", scratch_path(spark, "progress"), files_per_batch=4
    )
    stream.awaitTermination()
    return rounded(sources.read_result(spark, result), *MEASURES)


def increments(spark, sf_dir, baseline, config=CONFIG) -> YearlyIncrements:
    return YearlyIncrements(
        spark, tiled_stations(spark, sf_dir), baseline, scratch_path(spark, "store"),
        scratch_path(spark, "result"), config,
    )


@query
def corrected_increment(spark, sf_dir):
    """A year that is delivered with wrong values first, and again with the right ones."""
    incoming, progress = scratch_path(spark, "incoming"), scratch_path(spark, "progress")
    rows = inputs.observations(spark, sf_dir)
    wrong = F.when(F.col("Year") == 1999, F.col("Value") + 100).otherwise(F.col("Value"))
    held = increments(spark, sf_dir, climate(spark, sf_dir).baseline)
    for n, delivery in enumerate((rows.withColumn("Value", wrong), rows.where("Year = 1999"))):
        _write_by_year_csv(delivery, f"{incoming}/{n}", F.col("Date"))
        held.start(f"{incoming}/*/*", progress, files_per_batch=100).awaitTermination()
    return rounded(sources.read_result(spark, held.result), *MEASURES)


@query
def late_baseline_year(spark, sf_dir):
    """A year of the baseline span that comes last: baseline and considered tiles follow it."""
    held = increments(spark, sf_dir, None, STRICT_CONFIG)
    rows = inputs.observations(spark, sf_dir)
    late = F.col("Year") == STRICT_CONFIG.year_start_baseline + 1
    for n, condition in enumerate((~late, late)):
        held.update(rows.where(condition).drop("Year"), n)
    return rounded(sources.read_result(spark, held.result), *MEASURES)


@query
def exported_table(spark, sf_dir):
    """The wide table as CSV export, read back."""
    wide = climate(spark, sf_dir).wide
    path = scratch_path(spark, "export")
    sinks.export_csv(wide.select(*MEASURES, "Lat", "Long", "Year"), path)
    return rounded(sources.read_result_csv(spark, path), *MEASURES)


# Series


@query
def co2_series(spark, sf_dir):
    return rounded(co2(spark, sf_dir), "Total_in_mega_tons", digits=3)


@query
def co2_file(spark, sf_dir):
    """The emission lines written as CSV with a header and read back."""
    path = scratch_path(spark, "co2")
    sinks.export_csv(inputs.co2_lines(spark, sf_dir), path)
    return rounded(
        sources.co2_series(sources.read_co2(spark, path)), "Total_in_mega_tons", digits=3
    )


@query
def global_series(spark, sf_dir):
    series = rounded(global_table(spark, sf_dir), *MEASURES)
    return rounded(series, "Total_in_mega_tons", digits=3).orderBy("Year")


@query
def series_long(spark, sf_dir):
    long = op.series_long(
        global_table(spark, sf_dir), CONFIG.year_start_baseline, CONFIG.year_end_baseline
    )
    return rounded(long, "value", digits=4)


@query
def local_trend(spark, sf_dir):
    long = op.series_long(global_table(spark, sf_dir)).select("Year", "series", "value")
    trend = op.local_trend(long, ["series"], "Year", "value")
    return rounded(trend, "value", "trend", digits=4)


@query
def trend_error(spark, sf_dir):
    """The trend with its standard error."""
    long = op.series_long(global_table(spark, sf_dir)).select("Year", "series", "value")
    trend = op.local_trend(long, ["series"], "Year", "value", se=True)
    return rounded(trend, "value", "trend", "trend_se", digits=4)


@query
def daily_trend(spark, sf_dir):
    """The trend over days, which are many, with its standard error; a day is a mean of tiles."""
    day = F.datediff(F.to_date("Date", "yyyyMMdd"), F.lit("1990-01-01").cast("date"))
    daily = op.daily_tile_values(tiled(spark, sf_dir)).groupBy(
        F.col("Element").alias("series"), day.alias("Day")
    )
    trend = op.long_trend(
        daily.agg(F.avg("Value").alias("value")), ["series"], "Day", "value", se=True
    )
    return rounded(trend, "value", "trend", "trend_se", digits=4)


@query
def tile_trend(spark, sf_dir):
    """A trend for every tile and measure."""
    long = climate(spark, sf_dir).wide.unpivot(
        ["Tile_Id", "Year"], list(MEASURES), "series", "value"
    )
    trend = op.local_trend(long, ["Tile_Id", "series"], "Year", "value")
    return rounded(trend, "value", "trend", digits=4)


# Map


@query
def year_lookup(spark, sf_dir):
    shown = op.year_lookup(stored_result(spark, sf_dir), 1999, "summer")
    return rounded(shown, "TMAX", "PRCP", "WTXX")


@query
def tile_polygons(spark, sf_dir):
    polygons = op.tile_polygons(stored_result(spark, sf_dir), SIZE)
    return polygons.select("Lat", "Long", "Year", ring_text())


@query
def feature_ids(spark, sf_dir):
    polygons = op.tile_polygons(stored_result(spark, sf_dir), SIZE)
    return op.feature_ids(polygons).select("id", "Lat", "Long", "Year")


@query
def feature_collections(spark, sf_dir):
    polygons = op.tile_polygons(stored_result(spark, sf_dir), SIZE)
    return op.feature_collections(op.feature_ids(polygons))


@query
def geojson_rows(spark, sf_dir):
    """The polygons published as files, one per year, and read back into rows."""
    path = scratch_path(spark, "geojson")
    publish_polygons(stored_result(spark, sf_dir), path, SIZE)
    features = sources.explode_features(sources.read_feature_collections(spark, path))
    return features.select("id", "Lat", "Long", "Year", ring_text())


@query
def point_features(spark, sf_dir):
    """Point features, taken apart again to compare their numbers."""
    points = op.point_features(stored_result(spark, sf_dir))
    properties = ", ".join([f"{m}: DOUBLE" for m in MEASURES])
    schema = (
        f"type STRING, properties STRUCT<Tile_Id: STRING, {properties}>,"
        " geometry STRUCT<type: STRING, coordinates: ARRAY<INT>>"
    )
    parsed = points.withColumn("f", F.from_json("json", schema))
    return parsed.select(
        "Year", "Lat", "Long",
        F.col("f.type").alias("type"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates")[0].alias("x"),
        F.col("f.geometry.coordinates")[1].alias("y"),
        F.col("f.properties.Tile_Id").alias("Tile_Id"),
        *[round_half_up(F.col(f"f.properties.{m}"), 6).alias(m) for m in MEASURES],
    )


@query
def map_layer(spark, sf_dir):
    """Layers of one year and segment, matched to that year's published polygons."""
    wide = stored_result(spark, sf_dir)
    path = scratch_path(spark, "geojson")
    publish_polygons(wide, path, SIZE)
    published = sources.explode_features(sources.read_feature_collections(spark, path, 1999))
    return rounded(op.map_layer(wide, published, 1999, "year"), "value", digits=5)


@query
def color_scale(spark, sf_dir):
    wide = stored_result(spark, sf_dir)
    layer = op.map_layer(wide, op.tile_polygons(wide, SIZE), 2000, "winter")
    colored = op.with_color(layer).select(
        "Lat", "Long", "layer", "value", "scale_position", "color_class"
    )
    return rounded(colored, "value", "scale_position", digits=5)


def _write_yearly_csv(spark, sf_dir, name, filed_under) -> str:
    """The observations as headerless CSV in one folder per year."""
    path = scratch_path(spark, name)
    _write_by_year_csv(inputs.observations(spark, sf_dir), path, filed_under)
    return path


def _write_by_year_csv(rows: DataFrame, path: str, filed_under: Column) -> None:
    (
        rows.withColumn("Year", year_of(filed_under))
        .hint("rebalance", F.col("Year"))
        .write.partitionBy("Year")
        .csv(path)
    )
