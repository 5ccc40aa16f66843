"""A baseline that is kept up to date: sums from which years can be taken back exactly, and what a
change of it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClimateConfig
from ..functions.calendar import month_day_of

KEYS = ["MonthDay", "Element", "Tile_Id"]
#: Daily values are added as decimals, so that a year that is taken back leaves nothing behind and
#: the order of additions does not matter.
TOTAL = "DECIMAL(38,12)"
STATE_SCHEMA = (
    f"MonthDay STRING, Element STRING, Tile_Id STRING, n BIGINT, n_value BIGINT, total {TOTAL}"
)


def baseline_state(daily: DataFrame, config: ClimateConfig, sign: int = 1) -> DataFrame:
    """Number of days, of values, and sum of the daily tile values in the baseline years, per
    calendar day, element and tile. With ``sign`` -1 the table takes these years back."""
    in_span = F.col("Year").between(config.year_start_baseline, config.year_end_baseline)
    total = F.coalesce(F.sum(F.col("Value").cast(TOTAL)), F.lit(0)).cast(TOTAL)
    return (
        daily.where(in_span)
        .groupBy(month_day_of(F.col("Date")).alias("MonthDay"), "Element", "Tile_Id")
        .agg(
            (F.count(F.lit(1)) * sign).alias("n"),
            (F.count("Value") * sign).alias("n_value"),
            # A product of decimals would have fewer digits.
            (total if sign > 0 else -total).alias("total"),
        )
    )


def merged_states(*states: DataFrame) -> DataFrame:
    """States added up; days that no year is left of drop out."""
    together = states[0]
    for state in states[1:]:
        together = together.unionByName(state)
    return (
        together.groupBy(*KEYS)
        .agg(
            F.sum("n").alias("n"), F.sum("n_value").alias("n_value"),
            F.sum("total").cast(TOTAL).alias("total"),
        )
        .where(F.col("n") > 0)
    )


def baseline_of_state(state: DataFrame) -> DataFrame:
    """The baseline year, as ``baseline_year`` has it."""
    mean = F.try_divide(F.col("total").cast("double"), F.col("n_value"))
    return state.select(*KEYS, mean.alias("Value_baseline"))


def changed_tiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tiles whose rows of the result change with the baseline: those that come, those that go,
    and those with another value on any day."""
    old, new = (
        side.select(*KEYS, F.col("Value_baseline").alias(name), F.lit(True).alias(f"in_{name}"))
        for side, name in ((before, "old"), (after, "new"))
    )
    same = (
        F.col("in_old").eqNullSafe(F.col("in_new")) & F.col("old").eqNullSafe(F.col("new"))
    )
    return old.join(new, KEYS, "full").where(~same).select("Tile_Id").distinct()
