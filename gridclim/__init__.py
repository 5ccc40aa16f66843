"""Climate anomalies from station observations, on Spark DataFrames."""

from .config import ClimateConfig
from .plans import ClimateTables, build_yearly_anomalies, generate_result, publish_polygons

__all__ = [
    "ClimateConfig", "ClimateTables", "build_yearly_anomalies", "generate_result",
    "publish_polygons",
]
