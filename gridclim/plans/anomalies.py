"""From raw observations to the wide table of yearly anomalies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ClimateConfig
from ..operators.anomaly import anomalies
from ..operators.baseline import baseline_tiles, baseline_year
from ..operators.coverage import initial_tiles, restrict_to_tiles
from ..operators.daily import daily_from_facts, facts_on_tiles, observation_facts
from ..operators.lookups import BroadcastLimit, fits_broadcast
from ..operators.observe import accepted_observations
from ..operators.stations import tile_stations
from ..operators.wide import wide_table, with_centres
from ..session import scratch_path
from .stages import keep_stage


@dataclass(frozen=True)
class ClimateTables:
    """The tables from the stored daily values to the result, all lazy."""

    daily: DataFrame
    tiles: DataFrame
    baseline: DataFrame
    anomalies: DataFrame
    wide: DataFrame


def daily_values(
    observations: DataFrame,
    tiled_stations: DataFrame,
    config: ClimateConfig,
    limit: BroadcastLimit = BroadcastLimit(),
    with_baseline: bool = True,
) -> DataFrame:
    """Daily tile values of all years that the result needs, and the baseline unless there is one
    already, by one scan."""
    needed = F.col("Year").between(config.year_start_data, config.year_end_data)
    if with_baseline:
        needed |= F.col("Year").between(config.year_start_baseline, config.year_end_baseline)
    accepted = accepted_observations(observations).where(needed)
    facts = observation_facts(accepted)
    broadcast = fits_broadcast(tiled_stations, limit)
    return daily_from_facts(facts_on_tiles(facts, tiled_stations, broadcast))


def climate_tables(
    daily: DataFrame, config: ClimateConfig, baseline: DataFrame | None = None
) -> ClimateTables:
    """What follows from the daily tile values, which are small beside the raw data. Coverage
    needs no raw data either: a day with any record has a daily value. An existing ``baseline``
    takes the place of the one that would be computed, and its tiles those of the coverage."""
    if baseline is None:
        tiles = initial_tiles(daily, config)
        # Restricted after the mean over the years, when one row per calendar day is left. The
        # grid bounds the list of tiles.
        baseline = restrict_to_tiles(baseline_year(daily, config), tiles, broadcast=True)
    else:
        tiles = baseline_tiles(baseline)
    in_data = F.col("Year").between(config.year_start_data, config.year_end_data)
    # The join with the baseline keeps only its tiles, so they need no filter of their own.
    differences = anomalies(daily.where(in_data), baseline)
    wide = with_centres(wide_table(differences), config.tile_size)
    return ClimateTables(daily, tiles, baseline, differences, wide)


def build_yearly_anomalies(
    spark: SparkSession,
    observations: DataFrame,
    stations: DataFrame,
    config: ClimateConfig = ClimateConfig(),
    stage_path: str | None = None,
    limit: BroadcastLimit = BroadcastLimit(),
    baseline: DataFrame | None = None,
    inputs: str | None = None,
) -> ClimateTables:
    """Raw observations (``read_observations``) and stations (``read_stations``) to yearly
    anomalies per tile. Scans the raw data once, into a table of daily values stored by Year
    under ``stage_path`` (default: a new path in the scratch folder).

    ``inputs`` names the content of observations and stations, as ``files_label`` does for files.
    Run again with the same path, configuration and inputs, it starts from that table; without
    ``inputs`` nothing is reused."""
    tiled = tile_stations(stations, config.tile_size)
    label = f"{config!r} {baseline is None} {inputs}" if stage_path and inputs else None
    daily = keep_stage(
        spark,
        lambda: daily_values(observations, tiled, config, limit, baseline is None),
        stage_path or scratch_path(spark, "daily"),
        label=label,
        by_year=True,
    )
    return climate_tables(daily, config, baseline)
