"""The steps of the computation: DataFrames in, one lazy DataFrame out."""

from .anomaly import anomalies
from .baseline import baseline_tiles, baseline_year, stored_baseline
from .bitmaps import (
    day_bitmaps, days_counted, merged_bitmaps, numbered_stations, station_bitmaps,
    stations_counted,
)
from .coverage import (
    active_days_per_year, active_tiles, active_tiles_per_year, initial_tiles, restrict_to_tiles,
    tiles_active_in, tiles_of_active_days,
)
from .daily import (
    daily_from_facts, daily_from_sums, daily_storm_rate, daily_tile_mean, daily_tile_values,
    facts_on_tiles, observation_facts, station_counts, station_tiles, summed_facts,
    with_station_count,
)
from .layers import map_layer, with_color, year_lookup
from .long_trend import long_trend
from .lookups import BroadcastLimit, fits_broadcast, full_join_list, lookup_join
from .maintained import baseline_of_state, baseline_state, changed_tiles, merged_states
from .observe import accepted_observations, tiled_observations, unknown_station_audit
from .polygons import feature_collections, feature_ids, point_features, tile_polygons
from .segments import segment_means, with_segments
from .series import SERIES, global_series, series_long
from .stations import tile_centres, tile_stations
from .trend import local_trend
from .wide import attach_centres, spread_segment, wide_from_segments, wide_table, with_centres

__all__ = [
    "BroadcastLimit", "SERIES", "accepted_observations", "active_days_per_year", "active_tiles",
    "active_tiles_per_year", "anomalies", "attach_centres", "baseline_of_state", "baseline_state", "baseline_tiles",
    "baseline_year", "changed_tiles", "day_bitmaps", "days_counted", "merged_bitmaps",
    "numbered_stations", "station_bitmaps", "stations_counted",
    "daily_from_facts", "daily_from_sums", "daily_storm_rate", "daily_tile_mean",
    "daily_tile_values",
    "facts_on_tiles", "feature_collections", "feature_ids", "fits_broadcast", "full_join_list",
    "global_series", "initial_tiles", "local_trend", "long_trend", "lookup_join", "map_layer", "merged_states",
    "observation_facts", "point_features", "restrict_to_tiles", "segment_means", "series_long",
    "spread_segment", "station_counts", "station_tiles", "stored_baseline", "summed_facts",
    "tile_centres",
    "tile_polygons", "tile_stations", "tiled_observations", "tiles_active_in",
    "tiles_of_active_days", "unknown_station_audit", "wide_from_segments", "wide_table", "with_centres", "with_color",
    "with_segments", "with_station_count", "year_lookup",
]
