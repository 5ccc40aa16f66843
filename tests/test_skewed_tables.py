"""Queries on tables with a hot station, a large group of copies and missing values."""

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from check import database, difference

from gridclim import catalog
from gridclim.catalog import queries
from gridclim.catalog.inputs import STRICT_CONFIG

# A day count that some tiles of these tables reach and some do not.
STRICT_DAYS = 14
QUERIES, ORACLE = catalog.QUERIES, catalog.oracle_sql(STRICT_DAYS)
SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    rng = np.random.default_rng(1)
    table = pq.read_table(f"{SOURCE}/lineitem.parquet")
    items = table.to_pandas()
    n = len(items)
    items.loc[rng.random(n) < 0.35, "l_partkey"] = 11
    items.loc[rng.random(n) < 0.03, "l_partkey"] = 10**7
    items["l_quantity"] = items["l_quantity"].where(rng.random(n) > 0.1)
    items["l_returnflag"] = items["l_returnflag"].where(rng.random(n) > 0.1, None)
    items = pd.concat([items] + [items.iloc[[5]]] * (n // 3))
    pq.write_table(
        pa.Table.from_pandas(items, schema=table.schema, preserve_index=False),
        folder / "lineitem.parquet", row_group_size=1000,
    )
    table = pq.read_table(f"{SOURCE}/part.parquet")
    parts = table.to_pandas()
    parts = parts[rng.random(len(parts)) > 0.1]
    pq.write_table(
        pa.Table.from_pandas(parts, schema=table.schema, preserve_index=False),
        folder / "part.parquet",
    )
    return str(folder)


@pytest.mark.parametrize("name", [
    "tiled_observations", "unknown_station_audit", "active_days_per_year", "initial_tiles",
    "station_count", "daily_tile_values", "daily_anomaly", "yearly_anomalies", "global_series",
    "active_tiles", "restrict_to_tiles", "baseline_year", "yearly_anomalies_strict",
    "streamed_increments",
])
def test_skewed(spark, skewed, monkeypatch, name):
    strict = dataclasses.replace(STRICT_CONFIG, days_divisor=STRICT_DAYS)
    monkeypatch.setattr(queries, "STRICT_CONFIG", strict)
    result = QUERIES[name](spark, skewed).toPandas()
    assert len(result)
    assert difference(result, database(skewed).execute(ORACLE[name]).df()) is None
