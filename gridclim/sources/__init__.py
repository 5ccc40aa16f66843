"""Readers. Every reader takes the session and a path and returns a lazy DataFrame."""

from .emissions import co2_series, read_co2
from .observations import (
    OBSERVATION_SCHEMA, TooManyRejects, check_rejects, read_checked_observations,
    read_observations, rejected_observations, rejects_per_file, sound_observations, with_year,
    year_mismatch_audit, yearly_files,
)
from .polygons import explode_features, read_feature_collections
from .stations import parse_station_lines, read_stations
from .tables import read_daily_values, read_result, read_result_csv, read_tiles

__all__ = [
    "OBSERVATION_SCHEMA", "TooManyRejects", "check_rejects", "co2_series", "explode_features", "parse_station_lines", "read_checked_observations",
    "read_co2", "read_daily_values", "read_feature_collections", "read_observations", "read_result",
    "read_result_csv", "read_stations", "read_tiles", "rejected_observations", "rejects_per_file",
    "sound_observations", "with_year", "year_mismatch_audit", "yearly_files",
]
