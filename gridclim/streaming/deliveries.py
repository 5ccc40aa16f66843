"""Which deliveries of yearly files count.

A delivery is a file, or a folder of part files as Spark writes them. Its name tells what it is a
delivery of (``1918.csv``, ``Year=1918``), whatever folder it comes in; a later delivery of the same
name takes the place of the earlier one. Each delivery's sums are stored apart by number, so that
they can be left out again."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def delivery_of(file: Column) -> Column:
    """Path of the delivery that a file belongs to."""
    return F.regexp_extract(file, r"^(.*?)(?:/part-[^/]*)?$", 1)


def new_number() -> int:
    """A number of its own for each attempt to store sums, so that what an attempt that died has
    left behind never counts."""
    return uuid.uuid4().int >> 66


def received(
    entries: dict[str, dict], delivered: Iterable[str]
) -> tuple[dict[str, dict], dict[str, int]]:
    """The entries after some deliveries, oldest first, and the number for the sums of each one that
    counts. An entry holds the delivery that counts under its name, the numbers of its sums (it may
    arrive in several batches) with their years, and the deliveries that it has replaced; what is
    late of those does not count."""
    entries, numbers = dict(entries), {}
    for delivery in delivered:
        name = delivery.rstrip("/").rpartition("/")[2]
        entry = entries.get(name, {"delivery": delivery, "sums": {}, "replaced": []})
        if delivery in entry["replaced"]:
            continue
        if delivery != entry["delivery"]:
            numbers.pop(entry["delivery"], None)
            entry = {
                "delivery": delivery, "sums": {},
                "replaced": [*entry["replaced"], entry["delivery"]],
            }
        numbers[delivery] = new_number()
        entries[name] = entry | {"sums": entry["sums"] | {str(numbers[delivery]): []}}
    return entries, numbers


def with_years(entries: dict[str, dict], years: dict[str, list[int]]) -> dict[str, dict]:
    """The entries with the years that new sums were stored for."""
    return {
        name: entry | {"sums": {n: years.get(n, old) for n, old in entry["sums"].items()}}
        for name, entry in entries.items()
    }


def sums_that_count(entries: dict[str, dict]) -> dict[str, list[int]]:
    """Numbers of stored sums and their years."""
    return {n: years for entry in entries.values() for n, years in entry["sums"].items()}
