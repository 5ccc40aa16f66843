"""Joins against lookup tables whose size is not known beforehand."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BroadcastLimit:
    """The largest lookup table that is sent to every executor."""

    rows: int = 500_000
    text_bytes: int = 32 * 1024 * 1024


def fits_broadcast(lookup: DataFrame, limit: BroadcastLimit = BroadcastLimit()) -> bool:
    """Measures the lookup table (one aggregate over it) against the limit."""
    text_columns = [name for name, kind in lookup.dtypes if kind == "string"]
    width = functools.reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in text_columns],
        F.lit(0),
    )
    size = lookup.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("width")
    ).first()
    return size["n"] <= limit.rows and size["width"] <= limit.text_bytes


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    broadcast: bool,
    salts: int = 32,
) -> DataFrame:
    """Inner join on ``keys``, which are unique in ``lookup``.

    A lookup that fits is broadcast. Beyond that both sides are shuffled, and every key of the
    fact table is spread over ``salts`` partitions by a hash of its ``spread_by`` columns, with
    the lookup rows repeated once per salt: one key may hold a large share of all rows. The
    hash makes a repeated task send its rows to the same place as the first attempt. Adaptive
    execution splits what is still too large for one task."""
    keys = list(keys)
    if broadcast:
        return fact.join(F.broadcast(lookup), keys)
    if salts == 1:
        return fact.join(lookup.hint("shuffle_merge"), keys)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        fact.withColumn("_salt", salt)
        .join(salted.hint("shuffle_merge"), [*keys, "_salt"])
        .drop("_salt")
    )


def full_join_list(tables: Sequence[DataFrame], on: str | list[str]) -> DataFrame:
    """Full outer join of all tables; a key that any table holds appears once."""
    if not tables:
        raise ValueError("nothing to join")
    return functools.reduce(lambda left, right: left.join(right, on, "full"), tables)
