"""Writers."""

from .tables import (
    export_baseline, export_csv, read_about, write_by_year, write_feature_collections,
)

__all__ = [
    "export_baseline", "export_csv", "read_about", "write_by_year", "write_feature_collections",
]
