import random

import numpy as np
import pytest

from gridclim.operators import local_trend

from helpers import plan


def expected_trend(x, y, span=0.75):
    """Each point by a weighted least-squares fit of its own."""
    x, y = np.array(x, float), np.array(y, float)
    near = int(np.floor(len(x) * span + 1e-5))
    fitted = []
    for at in x:
        distance = np.abs(x - at)
        width = np.sort(distance)[near - 1] if near else 0
        weight = np.clip(1 - (distance / width) ** 3, 0, None) ** 3 if width else distance * 0
        if len(set(x[weight > 0])) < 3:
            fitted.append(None)
            continue
        root = np.sqrt(weight)
        design = np.stack([np.ones_like(x), x - at, (x - at) ** 2], axis=1)
        fitted.append(np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0][0])
    return fitted


def check(spark, series):
    made = [(g, int(x), y) for g, points in series.items() for x, y in points]
    df = spark.createDataFrame(made, "g STRING, Year INT, v DOUBLE")
    found = {(r["g"], r["Year"]): r for r in local_trend(df, ["g"], "Year", "v").collect()}
    for g, points in series.items():
        points = [(x, y) for x, y in points if y is not None]
        fitted = expected_trend([p[0] for p in points], [p[1] for p in points])
        for (x, _), value in zip(points, fitted):
            trend = found[g, x]["trend"]
            if value is None:
                assert trend is None
            else:
                assert trend == pytest.approx(value, rel=1e-8, abs=1e-8)
    return found


def test_trend_equals_least_squares(spark):
    random.seed(1)
    series = {
        "long": [(y, random.gauss(0, 5)) for y in range(1917, 1977)],
        "large": [(y, 1e6 + y * 3.5 + random.gauss(0, 50)) for y in range(1950, 1980)],
        "gaps": [(y, random.gauss(0, 1) if y % 3 else None) for y in range(1917, 1950)],
        "repeated": [(1900 + i // 3, random.gauss(0, 1)) for i in range(36)],
    }
    found = check(spark, series)
    assert ("gaps", 1920) not in found


def test_fractional_positions(spark):
    """Positions in steps of 0.25 stay apart and keep their type."""
    rng = np.random.default_rng(4)
    x, y = np.arange(0, 9, 0.25), rng.normal(0, 3, 36)
    df = spark.createDataFrame(
        [("g", float(a), float(b)) for a, b in zip(x, y)], "g STRING, x DOUBLE, v DOUBLE"
    )
    found = {r["x"]: r["trend"] for r in local_trend(df, ["g"], "x", "v").collect()}
    assert sorted(found) == x.tolist()
    for at, value in zip(x, expected_trend(x, y)):
        assert found[at] == pytest.approx(value, rel=1e-8, abs=1e-8)


def test_fits_of_one_group_run_on_many_tasks(spark):
    df = spark.range(1500).selectExpr("'g' AS g", "id AS x", "CAST(id % 7 AS DOUBLE) AS v")
    trend = local_trend(df, ["g"], "x", "v")
    parts = trend.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(parts) >= 6 and sum(r["count"] for r in parts) == 1500


def test_a_parabola_is_its_own_trend(spark):
    points = [(y, 2.0 + 0.5 * (y - 1950) ** 2) for y in range(1940, 1961)]
    found = check(spark, {"p": points})
    assert all(abs(r["trend"] - r["v"]) < 1e-6 for r in found.values())


def test_too_few_points_have_no_trend(spark):
    found = check(spark, {"one": [(1917, 1.0)], "two": [(1917, 1.0), (1918, 2.0)],
                          "three": [(1917, 1.0), (1918, 2.0), (1919, 4.0)]})
    assert all(r["trend"] is None for r in found.values())
    assert found["one", 1917]["v"] == 1.0


def test_a_large_group_is_gathered_by_year_only(spark):
    """One group holds nearly all rows; they are combined per year before they move."""
    rng = np.random.default_rng(2)
    year = 1917 + rng.integers(0, 30, 20000)
    value = rng.integers(-50, 50, 20000).astype(float)
    df = spark.createDataFrame(
        [("hot", int(x), float(y)) for x, y in zip(year, value)], "g STRING, Year INT, v DOUBLE"
    )
    trend = local_trend(df, ["g"], "Year", "v")
    assert "Join" not in plan(trend)
    found = {r["Year"]: r["trend"] for r in trend.collect()}
    assert len(found) == 30
    distinct = sorted(found)
    at = distinct[10]
    near = int(np.floor(20000 * 0.75 + 1e-5))
    distance = np.abs(year - at)
    width = np.sort(distance)[near - 1]
    weight = np.clip(1 - (distance / width) ** 3, 0, None) ** 3
    fit = np.polyfit(year - at, value, 2, w=np.sqrt(weight))
    assert found[at] == pytest.approx(fit[2], abs=1e-8)


def expected_error(x, y, span=0.75):
    """From the whole smoothing operator: rows of weights, residuals, trace of (I - L)(I - L)'."""
    x, y = np.array(x, float), np.array(y, float)
    near, operator = int(np.floor(len(x) * span + 1e-5)), []
    for at in x:
        distance = np.abs(x - at)
        width = np.sort(distance)[near - 1]
        weight = np.clip(1 - (distance / width) ** 3, 0, None) ** 3
        root = np.sqrt(weight)
        design = np.stack([np.ones_like(x), x - at, (x - at) ** 2], axis=1)
        operator.append(np.linalg.pinv(design * root[:, None])[0] * root)
    smoother = np.array(operator)
    rest = np.eye(len(x)) - smoother
    variance = ((rest @ y) ** 2).sum() / np.trace(rest @ rest.T)
    return np.sqrt(variance * (smoother**2).sum(axis=1))


def test_standard_error(spark):
    rng = np.random.default_rng(7)
    series = {
        "years": (np.arange(1917.0, 1977), rng.normal(0, 5, 60)),
        "large": (np.arange(1950.0, 1980), 1e6 + rng.normal(0, 50, 30)),
        "repeated": (np.repeat(np.arange(12.0), 3), rng.normal(0, 1, 36)),
        "short": (np.arange(8.0), rng.normal(0, 1, 8)),
    }
    made = [(g, float(a), float(b)) for g, (x, y) in series.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(made, "g STRING, x DOUBLE, v DOUBLE")
    plain = {(r["g"], r["x"]): r["trend"] for r in local_trend(df, ["g"], "x", "v").collect()}
    found = {(r["g"], r["x"]): r for r in local_trend(df, ["g"], "x", "v", se=True).collect()}
    assert {k: r["trend"] for k, r in found.items()} == plain
    for g, (x, y) in series.items():
        for at, error in zip(x, expected_error(x, y)):
            assert found[g, at]["trend_se"] == pytest.approx(error, rel=1e-6)


def test_no_error_without_a_trend_or_freedom(spark):
    rows = [("few", float(x), 1.0 * x) for x in range(4)]
    rows += [("flat", float(x), 3.0) for x in range(20)]
    rows += [("null", float(x), None if x else 1.0) for x in range(9)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE, v DOUBLE")
    found = {}
    for row in local_trend(df, ["g"], "x", "v", se=True).collect():
        found.setdefault(row["g"], []).append(row["trend_se"])
    assert set(found["few"]) == set(found["null"]) == {None}
    assert max(found["flat"]) < 1e-9
