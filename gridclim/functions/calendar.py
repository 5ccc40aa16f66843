"""Dates are kept as ``YYYYMMDD`` text; years and month-days are cut out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SUMMER_START, WINTER_START


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def month_day_of(date: Column) -> Column:
    return F.substring(date, 5, 4)


def in_summer(month_day: Column) -> Column:
    return (month_day >= F.lit(SUMMER_START)) & (month_day < F.lit(WINTER_START))


def in_winter(month_day: Column) -> Column:
    """The rest of the same calendar year."""
    return (month_day < F.lit(SUMMER_START)) | (month_day >= F.lit(WINTER_START))


def in_segment(month_day: Column, segment: str) -> Column:
    if segment == "year":
        return F.lit(True)
    return {"summer": in_summer, "winter": in_winter}[segment](month_day)


def segments_of(month_day: Column) -> Column:
    """Array of the overlapping time segments a day belongs to."""
    half = F.when(in_summer(month_day), "summer").when(in_winter(month_day), "winter")
    return F.array_compact(F.array(F.lit("year"), half))
