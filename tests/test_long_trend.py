"""Trends of long series against the short operator, which is held to least squares."""

import numpy as np
import pandas as pd
import pytest

from gridclim.operators import local_trend, long_trend
from gridclim.operators.long_trend import _edges

SCHEMA = "g STRING, x DOUBLE, v DOUBLE, _n INT, value INT"


def table(spark, series):
    made = [(g, float(a), None if b is None else float(b), 1, 2)
            for g, points in series.items() for a, b in points]
    return spark.createDataFrame(made, SCHEMA)


def series():
    rng = np.random.default_rng(3)
    noisy = lambda x: list(zip(x, 50 * np.sin(x / 40) + rng.normal(0, 2, len(x))))
    lone = np.concatenate([np.arange(200.0), [1e5, 2e5]])
    dense = np.sort(np.concatenate([rng.uniform(0, 1, 150), rng.uniform(0, 1000, 60)]))
    hot = np.concatenate([np.arange(120.0), np.full(400, 57.0), np.full(30, 80.0)])
    return {
        "even": noisy(np.arange(400.0)),
        "uneven": noisy(np.cumsum(rng.exponential(3, 300))),
        "far": noisy(1e7 + np.arange(0, 90, 0.25)),
        "lone": noisy(lone),
        "dense": noisy(dense),
        "hot": noisy(hot),
        "few": [(1, 2), (2, 3), (4, 4)],
        "nulls": [(n, None if n % 3 else n) for n in range(90)],
        None: noisy(np.arange(70.0)),
    }


@pytest.mark.parametrize("span", [0.75, 0.2, 0.04, 1.0, 1.5])
def test_like_the_short_operator(spark, span):
    df = table(spark, series())
    wanted = {(r["g"], r["x"]): r for r in local_trend(df, ["g"], "x", "v", span, se=True).collect()}
    got = long_trend(df, ["g"], "x", "v", span, se=True, block=8)
    assert got.columns == ["g", "x", "v", "trend", "trend_se"]
    found = {(r["g"], r["x"]): r for r in got.collect()}
    assert set(found) == set(wanted)
    for key, row in wanted.items():
        # Two lone points far away have all their neighbours in one spot, which hardly determines a
        # quadratic: their fits, and the error of their series, are rounding in both operators.
        names = ["v", "trend", "trend_se"]
        if key[0] == "lone":
            names = names[: 2 if key[1] < 200 else 1]
        close = 1e-5 if key[0] == "dense" else 1e-6
        for name in names:
            if row[name] is None:
                assert found[key][name] is None, (key, name)
            else:
                assert found[key][name] == pytest.approx(row[name], rel=close, abs=close), (key, name)


def test_types_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(1, n, 0.5 * n * n) for n in range(1900, 1990)], "a INT, Year INT, v DOUBLE"
    )
    trend = long_trend(df, ["a"], "Year", "v", block=8)
    assert trend.schema == local_trend(df, ["a"], "Year", "v").schema
    assert all(abs(r["trend"] - r["v"]) < 1e-4 for r in trend.collect())
    assert long_trend(df.limit(0), ["a"], "Year", "v").count() == 0


def test_edges_hold_all_windows():
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(0, 100, 200))
    first, last, count = x[::10], x[9::10], np.full(20, 10)
    for near in (1, 7, 60, 150, 200):
        left, right = _edges(first, last, count, near, x[70], x[79])
        for at in x[70:80]:
            reach = np.sort(np.abs(x - at))[near - 1]
            assert left[0] <= at - reach <= left[1] and right[0] <= at + reach <= right[1]


def test_a_hundred_thousand_positions(spark):
    """The fits of some places, from all points."""
    rng = np.random.default_rng(5)
    y = rng.normal(0, 3, 100_000)
    df = spark.createDataFrame(
        pd.DataFrame({"g": "g", "x": np.arange(100_000), "v": y})
    )
    trend = long_trend(df, ["g"], "x", "v")
    found = {r["x"]: r["trend"] for r in trend.collect()}
    assert len(found) == 100_000
    x = np.arange(100_000.0)
    for at in (0, 511, 512, 33_333, 50_000, 99_999):
        distance = np.abs(x - at)
        width = np.sort(distance)[74_999]
        u = (x - at) / width
        root = np.clip(1 - np.abs(u) ** 3, 0, None) ** 1.5
        design = np.stack([np.ones_like(u), u, u * u], axis=1)
        fit = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0][0]
        assert found[at] == pytest.approx(fit, rel=1e-7, abs=1e-8)
