"""Measurement codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ELEMENTS, MEAN_ELEMENTS, STORM


def is_accepted(element: Column, quality_flag: Column) -> Column:
    """A wanted element whose quality check raised no flag."""
    return quality_flag.isNull() & element.isin(*ELEMENTS)


def fold_storms(element: Column) -> Column:
    """Every code that is no mean element counts as the storm pseudo-element."""
    return F.when(element.isin(*MEAN_ELEMENTS), element).otherwise(F.lit(STORM))
