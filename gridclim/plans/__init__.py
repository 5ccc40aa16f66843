"""Whole computations, composed from the operators."""

from .anomalies import ClimateTables, build_yearly_anomalies, climate_tables, daily_values
from .generate import BaselineMismatch, generate_result
from .publish import publish_polygons
from .stages import keep_stage

__all__ = [
    "BaselineMismatch", "ClimateTables", "build_yearly_anomalies", "climate_tables", "daily_values",
    "generate_result", "keep_stage", "publish_polygons",
]
