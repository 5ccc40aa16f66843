"""Global yearly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MEASURES, STORM

# Texts of the plots.
SEGMENT_TEXT = {
    "year": "Jahr",
    "summer": "Sommerliches Halbjahr (4. Mai - 3. Nov.)",
    "winter": "Winterliches Halbjahr (3. Nov. - 4. Mai)",
}
MEASURE_TEXT = {
    "TMAX": "Differenz der maximalen Tagestemperaturen (°C)",
    "PRCP": "Niederschlagsdifferenz (mm)",
    "WTXX": "Differenz der normierten Unwetteranzahl",
}
STORM_DETAIL = "(Anz. Unwetter / Anz. Stationen)"
CO2 = "Total_in_mega_tons"
CO2_TITLE = "Entwicklung des globalen, geschätzten CO2-Ausstoßes (Mt)"
CO2_UNIT = "CO2-Ausstoß (Mt)"
TITLE = (
    "Entwicklung der globalen {measure}{detail} pro {segment}\n"
    "im Vergleich zur Baseline (Durchschnittswerte der Jahre {first}-{last})"
)

SERIES = MEASURES + (CO2,)


def global_series(wide: DataFrame, co2: DataFrame | None = None) -> DataFrame:
    """Mean over all tiles per year, in display units, with emissions where there are any."""
    means = wide.groupBy("Year").agg(
        *[
            (F.avg(m) if m.startswith(STORM) else F.avg(m) / F.lit(10)).alias(m)
            for m in MEASURES
        ]
    )
    return means if co2 is None else means.join(co2, "Year", "left")


def plot_title(series: str, first_year: int, last_year: int) -> str:
    if series == CO2:
        return CO2_TITLE
    element, segment = series.split("_")
    return TITLE.format(
        measure=MEASURE_TEXT[element],
        detail=f" {STORM_DETAIL}" if element == STORM else "",
        segment=SEGMENT_TEXT[segment],
        first=first_year,
        last=last_year,
    )


def plot_unit(series: str) -> str:
    return CO2_UNIT if series == CO2 else MEASURE_TEXT[series.split("_")[0]]


def series_long(series: DataFrame, first_year: int = 1917, last_year: int = 1946) -> DataFrame:
    """One row per year and series, with the title and the axis text of its plot. Emissions are
    left out if ``series`` has none."""
    texts = F.create_map(
        *[
            F.lit(part) if isinstance(part, str) else F.struct(*map(F.lit, part))
            for name in SERIES
            for part in (name, (plot_title(name, first_year, last_year), plot_unit(name)))
        ]
    )
    present = [name for name in SERIES if name in series.columns]
    long = series.unpivot("Year", present, "series", "value")
    text = texts[F.col("series")]
    return long.select("Year", "series", "value", text["col1"].alias("title"),
                       text["col2"].alias("unit"))
