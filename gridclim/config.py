"""Parameters and fixed values of the climate computation."""

from __future__ import annotations

from dataclasses import dataclass

# The measurement codes that enter the computation.
MEAN_ELEMENTS = ("PRCP", "TMAX")
STORM_ELEMENTS = (
    "WT02", "WT03", "WT04", "WT05", "WT07",
    "WT10", "WT11", "WT16", "WT17", "WT18",
)
ELEMENTS = MEAN_ELEMENTS + STORM_ELEMENTS

# All storm codes are folded into this one pseudo-element.
STORM = "WTXX"
TILE_ELEMENTS = MEAN_ELEMENTS + (STORM,)

# The summer half-year starts on the first and ends before the second month-day.
SUMMER_START = "0504"
WINTER_START = "1103"
SEGMENTS = ("year", "summer", "winter")

# The nine columns of the wide table, in their published order.
MEASURES = tuple(f"{element}_{segment}" for segment in SEGMENTS for element in TILE_ELEMENTS)

# Fixed value: megatons of carbon to megatons of carbon dioxide.
CARBON_TO_CO2 = 3.667


@dataclass(frozen=True)
class ClimateConfig:
    """What to compute. The defaults are fixed values. ``days_divisor`` is the number of days that
    daily coverage is measured against; left out, it is the length of the baseline in years."""

    year_start_data: int = 1917
    year_end_data: int = 2016
    year_start_baseline: int = 1917
    year_span_baseline: int = 30
    coverage_threshold: float = 0.8
    tile_size: int = 10
    days_divisor: int | None = None

    def __post_init__(self) -> None:
        check_tile_size(self.tile_size)
        if self.year_end_data < self.year_start_data:
            raise ValueError("year_end_data lies before year_start_data")
        if self.year_span_baseline < 1:
            raise ValueError("year_span_baseline must be at least 1")
        if not 0 <= self.coverage_threshold <= 1:
            raise ValueError("coverage_threshold must lie in [0, 1]")
        if self.days_divisor is not None and self.days_divisor < 1:
            raise ValueError("days_divisor must be at least 1")

    @property
    def year_end_baseline(self) -> int:
        return self.year_start_baseline + self.year_span_baseline - 1

    def years_read(self, with_baseline: bool = True) -> list[int]:
        """The years that the result needs, and the baseline unless there is one already. Years
        between the two are left out."""
        years = set(range(self.year_start_data, self.year_end_data + 1))
        if with_baseline:
            years |= set(range(self.year_start_baseline, self.year_end_baseline + 1))
        return sorted(years)

    @property
    def coverage_days(self) -> int:
        return self.days_divisor or self.year_span_baseline


def check_tile_size(tile_size: int) -> None:
    """A tile size must be even (whole-number centres) and divide 90 (one grid for both axes)."""
    if tile_size <= 0 or tile_size % 2 or 90 % tile_size:
        raise ValueError(f"tile_size must be an even divisor of 90, not {tile_size}")


def max_tiles(tile_size: int) -> int:
    """Upper bound of the number of tiles; the poles and the date line may open one extra row."""
    return (180 // tile_size + 1) * (360 // tile_size + 1)
