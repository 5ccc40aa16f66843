"""Colour scales and labels of the map layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The anchors of the two palettes, from high to low values.
RED_BLUE = (
    "#67001f", "#b2182b", "#d6604d", "#f4a582", "#fddbc7", "#f7f7f7",
    "#d1e5f0", "#92c5de", "#4393c3", "#2166ac", "#053061",
)
PURPLE_GREEN = (
    "#40004b", "#762a83", "#9970ab", "#c2a5cf", "#e7d4e8", "#f7f7f7",
    "#d9f0d3", "#a6dba0", "#5aae61", "#1b7837", "#00441b",
)

# Layer -> (element, multiplier, divisor, half domain, palette, label suffix). Labels
# of the first two share a format with two significant digits, the third one is not rounded.
LAYERS = {
    "temp": ("TMAX", 1, 10, 12.0, RED_BLUE, " &#176;C"),
    "prec": ("PRCP", 1, 10, 20.0, RED_BLUE, "  mm"),
    "storm": ("WTXX", 100, 1, 20.0, PURPLE_GREEN, " Unwetter"),
}


def scale_position(value: Column, half_domain: float) -> Column:
    """0 at the low end of the symmetric domain, 1 at the high end, NULL outside."""
    position = (value + F.lit(half_domain)) / F.lit(2 * half_domain)
    return F.when(value.between(-half_domain, half_domain), position)


def color_class(position: Column, palette: tuple[str, ...]) -> Column:
    """The palette anchor nearest to a scale position; low values take the last anchor."""
    anchors = F.array(*[F.lit(color) for color in reversed(palette)])
    step = F.floor(position * F.lit(len(palette) - 1) + F.lit(0.5)).cast("int")
    return F.get(anchors, step)


def decimals_needed(value: Column) -> Column:
    """Decimals that show two significant digits of a value, without a closing zero."""
    size = F.abs(F.round(value, 9))
    power = F.floor(F.log10(F.when(size > 0, size)))
    tenths = F.round(size / F.pow(F.lit(10.0), power) * F.lit(10))
    # Two digits, as 99.6 becomes 100, or one if the second is zero.
    power = F.when(tenths >= 100, power + 1).otherwise(power)
    digits = F.when(tenths % 10 == 0, 1).otherwise(2)
    return F.greatest(F.coalesce(digits - 1 - power, F.lit(0)), F.lit(0)).cast("int")


def common_format(value: Column, decimals: Column) -> Column:
    """Value with a number of decimals that all values of a layer share. A value halfway between
    two, once noise of the summation is gone, goes away from zero."""
    pattern = F.concat(F.lit("%."), decimals, F.lit("f"))
    text = F.call_function("format_string", pattern, F.round(value, 9))
    return F.when(value.isNotNull(), F.regexp_replace(text, "^-(0(?:[.]0*)?)$", "$1"))


def plain_number(value: Column) -> Column:
    """Value as it is, up to the ninth decimal, where noise of the summation begins."""
    text = F.round(value, 9).cast("decimal(28,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")


ROUNDED_LAYERS = ("temp", "prec")
