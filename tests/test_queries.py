"""Every query against its SQL on the smallest tables, and the shape of its plan."""

import dataclasses
import re

import pytest

import __spark_entry__ as entry
from check import database, difference

from gridclim import catalog
from gridclim.catalog import queries
from gridclim.catalog.inputs import STRICT_CONFIG
from gridclim.config import MEASURES

from helpers import plan

SF_DIR = "/root/testdata/sf0.001"
# A day count that some tiles of the smallest tables reach and some do not.
STRICT_DAYS = 16
QUERIES, ORACLE = catalog.QUERIES, catalog.oracle_sql(STRICT_DAYS)


@pytest.fixture(scope="module")
def tables():
    return database(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, monkeypatch, name):
    strict = dataclasses.replace(STRICT_CONFIG, days_divisor=STRICT_DAYS)
    monkeypatch.setattr(queries, "STRICT_CONFIG", strict)
    result = QUERIES[name](spark, SF_DIR)
    text = plan(result)
    assert not re.search("EvalPython|MapInPandas|FlatMapGroups", text)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    # A window always has a partitioning.
    assert not re.search(r"Window \[.*?\], \[\](,|\n|$)", text)
    found = result.toPandas()
    assert len(found)
    assert difference(found, tables.execute(ORACLE[name]).df()) is None


def test_strict_coverage_keeps_some_tiles_and_drops_some(tables):
    kept = len(tables.execute(ORACLE["initial_tiles"]).df())
    assert 0 < kept < len(tables.execute(ORACLE["tile_centres"]).df())


def test_entry(spark):
    result = entry.entry(spark)
    assert set(MEASURES) <= set(result.columns)
    assert result.count() == 116
