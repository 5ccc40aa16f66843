import pytest

from gridclim import ClimateConfig
from gridclim.config import ELEMENTS, MEASURES, max_tiles


def test_defaults():
    config = ClimateConfig()
    assert (config.year_start_data, config.year_end_data) == (1917, 2016)
    assert config.year_end_baseline == 1946
    assert config.coverage_days == 30
    assert ClimateConfig(days_divisor=365).coverage_days == 365


@pytest.mark.parametrize("tile_size", [7, 5, 0, -10, 4, 8])
def test_tile_sizes_without_one_grid_are_rejected(tile_size):
    with pytest.raises(ValueError):
        ClimateConfig(tile_size=tile_size)


@pytest.mark.parametrize(
    "wrong",
    [{"year_end_data": 1900}, {"year_span_baseline": 0}, {"coverage_threshold": 1.1},
     {"days_divisor": 0}],
)
def test_wrong_parameters_are_rejected(wrong):
    with pytest.raises(ValueError):
        ClimateConfig(**wrong)


def test_only_needed_years_are_read():
    config = ClimateConfig(1990, 1992, 1917, 3)
    assert config.years_read() == [1917, 1918, 1919, 1990, 1991, 1992]
    assert config.years_read(with_baseline=False) == [1990, 1991, 1992]


def test_fixed_values():
    assert len(ELEMENTS) == 12
    assert MEASURES[:3] == ("PRCP_year", "TMAX_year", "WTXX_year")
    assert max_tiles(10) == 19 * 37
