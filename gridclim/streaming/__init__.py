"""Incremental processing of newly arriving yearly files."""

from .increments import YearlyIncrements

__all__ = ["YearlyIncrements"]
