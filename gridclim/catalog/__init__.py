"""Every operator as a runnable query over the given tables, each with SQL to check it against."""

from .oracle import oracle_sql
from .queries import QUERIES

__all__ = ["QUERIES", "oracle_sql"]
