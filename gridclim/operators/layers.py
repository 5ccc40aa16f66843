"""Map layers: what is shown for one year and time segment."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEGMENTS
from ..functions.geojson import point
from ..functions.scales import (
    LAYERS, ROUNDED_LAYERS, color_class, common_format, decimals_needed, plain_number,
    scale_position,
)


def year_lookup(wide: DataFrame, year: int, segment: str) -> DataFrame:
    """The tiles of one year with the three measures of one time segment."""
    _check_segment(segment)
    return wide.where(F.col("Year") == year).select(
        "Year", "Lat", "Long",
        *[F.col(f"{element}_{segment}").alias(element) for element, *_ in LAYERS.values()],
    )


def map_layer(wide: DataFrame, polygons: DataFrame, year: int, segment: str) -> DataFrame:
    """One row per tile and layer with value in display units, label and geometry. Labels of
    temperature and rain have the decimals that show two significant digits of every value, and one
    width; a missing value has none. Temperatures
    are matched to their polygon by (Year, Lat, Long), and a tile without a polygon keeps its
    values; the other layers are drawn at the centre."""
    tiles = year_lookup(wide, year, segment)
    squares = polygons.where(F.col("Year") == year).select(
        "Year", "Lat", "Long", F.to_json("geometry").alias("square")
    )
    long = tiles.unpivot(
        ["Year", "Lat", "Long"], [element for element, *_ in LAYERS.values()], "element", "raw"
    )
    shown = long.join(squares, ["Year", "Lat", "Long"], "left").select(
        "Year", "Lat", "Long",
        _by_element({spec[0]: F.lit(name) for name, spec in LAYERS.items()}).alias("layer"),
        _by_element(
            {e: F.col("raw") * F.lit(mul) / F.lit(div) for e, mul, div, *_ in LAYERS.values()}
        ).alias("value"),
        F.when(F.col("element") == LAYERS["temp"][0], F.col("square"))
        .otherwise(F.to_json(point(F.col("Lat"), F.col("Long"))))
        .alias("geometry"),
    )
    # A layer holds at most one row per tile of the grid.
    of_layer = Window.partitionBy("layer")
    value = F.col("value")
    shown = shown.withColumn("_text", F.when(
        F.col("layer").isin(*ROUNDED_LAYERS),
        common_format(value, F.max(decimals_needed(value)).over(of_layer)),
    ).otherwise(plain_number(value)))
    width = F.when(
        F.col("layer").isin(*ROUNDED_LAYERS), F.max(F.length("_text")).over(of_layer)
    ).otherwise(F.length("_text"))
    suffix = _by_layer({name: F.lit(spec[5]) for name, spec in LAYERS.items()})
    label = F.concat(F.lpad("_text", width, F.lit(" ")), suffix)
    return shown.withColumn("label", label).drop("_text")


def with_color(layer: DataFrame) -> DataFrame:
    """Position on the layer's colour scale (NULL outside its domain) and the nearest anchor."""
    position = _by_layer(
        {name: scale_position(F.col("value"), spec[3]) for name, spec in LAYERS.items()}
    )
    color = _by_layer(
        {name: color_class(F.col("scale_position"), spec[4]) for name, spec in LAYERS.items()}
    )
    return layer.withColumn("scale_position", position).withColumn("color_class", color)


def _by_element(cases: dict):
    return _case("element", cases)


def _by_layer(cases: dict):
    return _case("layer", cases)


def _case(column: str, cases: dict):
    return functools.reduce(
        lambda chain, case: chain.when(F.col(column) == case[0], case[1]), cases.items(), F
    )


def _check_segment(segment: str) -> None:
    if segment not in SEGMENTS:
        raise ValueError(f"segment must be one of {SEGMENTS}, not {segment!r}")
