"""Which tiles have enough measurements to take part.

Every function accepts any table with the columns it names: row-level tiled observations or the
far smaller daily tile values, which hold the same (Date, Tile_Id) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClimateConfig
from .lookups import BroadcastLimit, fits_broadcast, lookup_join


def active_days_per_year(days: DataFrame) -> DataFrame:
    """Number of days with any record, per tile and year."""
    return (
        days.select("Tile_Id", "Year", "Date")
        .distinct()
        .groupBy("Tile_Id", "Year")
        .agg(F.count(F.lit(1)).alias("Count"))
    )


def active_tiles_per_year(days: DataFrame, divisor: int, threshold: float) -> DataFrame:
    """Tile-years whose active days, divided by ``divisor``, reach the threshold."""
    return (
        active_days_per_year(days)
        .where(F.col("Count") / F.lit(divisor) >= F.lit(threshold))
        .select("Tile_Id", "Year")
    )


def tiles_active_in(tile_years: DataFrame, year: int) -> DataFrame:
    """All tile-years of those tiles that are active in one year."""
    chosen = tile_years.where(F.col("Year") == year).select("Tile_Id")
    return tile_years.join(chosen, "Tile_Id", "left_semi")


def active_tiles(tile_years: DataFrame, span: int, threshold: float) -> DataFrame:
    """Tiles whose active years, divided by ``span``, reach the threshold."""
    return (
        tile_years.groupBy("Tile_Id")
        .agg(F.count(F.lit(1)).alias("Count"))
        .where(F.col("Count") / F.lit(span) >= F.lit(threshold))
        .select("Tile_Id")
    )


def initial_tiles(days: DataFrame, config: ClimateConfig) -> DataFrame:
    """Tiles that are active in the first baseline year and in enough baseline years.

    The first-year condition rides along in the count, which spares the self-join of
    ``tiles_active_in``."""
    first, last = config.year_start_baseline, config.year_end_baseline
    return tiles_of_active_days(
        active_days_per_year(days.where(F.col("Year").between(first, last))), config
    )


def tiles_of_active_days(active_days: DataFrame, config: ClimateConfig) -> DataFrame:
    """``initial_tiles`` from the number of active days per tile and year of the baseline."""
    first = config.year_start_baseline
    reached = F.col("Count") / F.lit(config.coverage_days) >= F.lit(config.coverage_threshold)
    share = F.col("Count") / F.lit(config.year_span_baseline)
    return (
        active_days.where(reached)
        .groupBy("Tile_Id")
        .agg(
            F.count(F.lit(1)).alias("Count"),
            F.bool_or(F.col("Year") == first).alias("Since_first"),
        )
        .where(F.col("Since_first") & (share >= F.lit(config.coverage_threshold)))
        .select("Tile_Id")
    )


def restrict_to_tiles(
    df: DataFrame, tiles: DataFrame, broadcast: bool | None = None,
    limit: BroadcastLimit = BroadcastLimit(),
) -> DataFrame:
    """Rows of the considered tiles. ``broadcast`` None measures the list of tiles: one that fits
    is broadcast, which spares a shuffle by tile, as tiles differ in size; a longer one is joined
    with salted keys. A caller that knows the list to be small (or ``df`` to hold few rows a tile)
    says so and spares the measuring."""
    chosen = tiles.select("Tile_Id").distinct()
    if broadcast is None:
        broadcast = fits_broadcast(chosen, limit)
    spread = [c for c in ("Date", "MonthDay", "Element", "Year") if c in df.columns]
    joined = lookup_join(df, chosen, ["Tile_Id"], spread, broadcast, salts=32 if spread else 1)
    return joined.select(*df.columns)
