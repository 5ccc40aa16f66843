"""Smooth trend of a yearly series: local quadratic regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 0.75
# Fits of a group that are made in one row.
FITS = 16


def local_trend(
    df: DataFrame, groups: Sequence[str], x: str, y: str, span: float = SPAN, se: bool = False
) -> DataFrame:
    """Per group and ``x``, of any numeric type: the mean of ``y`` and its locally fitted
    ``trend``.

    Each fit is a quadratic over the nearest ``span`` share of the points with tricube weights.
    Rows without ``y`` take no part. Fits depend on the points only through the count and the sum
    per ``x``, so these are combined first, whatever the size of a group; what is gathered per
    group is one entry per distinct ``x``. The fits of a group, some at a time, are spread over
    many tasks. Fewer than three points with weight give NULL.

    ``se`` adds ``trend_se``, the standard error of the trend. A fit is a weighted sum of all ``y``
    of its group, by one row of the smoothing operator L; the error is the root of that row's sum of
    squares times the residual variance, which is the sum of squared residuals divided by the trace
    of (I - L)(I - L)'. It is NULL where a point of the group has no trend, and where no freedom is
    left for the residuals."""
    value = F.col(y).cast("double")
    # How far the values of one x lie apart is of no matter to the fits.
    within = [(F.var_pop(value) * F.count(F.lit(1))).alias("_within")] if se else []
    points = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*groups, x)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"), *within)
    )
    entry = F.struct(
        F.col(x).cast("double").alias("x"), F.col(x).alias("at"), F.col("_n").alias("n"),
        F.col("_sum").alias("sum"), *([F.col("_within").alias("within")] if se else []),
    )
    gathered = points.groupBy(*groups).agg(
        F.sort_array(F.collect_list(entry)).alias("_points"),
        F.floor(F.sum("_n") * F.lit(span) + F.lit(1e-5)).alias("_near"),
    )
    starts = F.sequence(F.lit(1), F.size("_points"), F.lit(FITS))
    # A given number of partitions keeps the fits, long work on small data, on many tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = gathered.withColumn("_start", F.explode(starts)).repartition(tasks, *groups, "_start")
    fits = F.transform(
        F.slice("_points", F.col("_start"), F.lit(FITS)),
        lambda at: F.struct(
            at["at"].alias("x"),
            (at["sum"] / at["n"]).alias("y"),
            _fit(F.col("_points"), at["x"], F.col("_near"), se).alias("trend"),
            *([at["n"].alias("n"), at["within"].alias("within")] if se else []),
        ),
    )
    if se:
        return _with_error(parts.select(*groups, F.explode(fits).alias("_fit")), groups, x, y)
    return parts.select(*groups, F.explode(fits).alias("_fit")).select(
        *groups,
        F.col("_fit.x").alias(x),
        F.col("_fit.y").alias(y),
        F.col("_fit.trend").alias("trend"),
    )


def _with_error(fits: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """The fits with their standard error; ``trend`` is a struct of value, own weight and norm."""
    whole = Window.partitionBy(*groups)
    n, fit = F.col("_fit.n"), F.col("_fit.trend")
    residual = F.col("_fit.y") - fit["value"]
    squares = F.sum(F.col("_fit.within") + n * residual * residual).over(whole)
    freedom = F.sum(n * (F.lit(1) - 2 * fit["own"] + fit["norm"])).over(whole)
    missing = F.max(fit["value"].isNull()).over(whole)
    error = F.when(~missing & (freedom > 1e-9), F.sqrt(squares / freedom * fit["norm"]))
    return fits.select(
        *groups,
        F.col("_fit.x").alias(x),
        F.col("_fit.y").alias(y),
        fit["value"].alias("trend"),
        error.alias("trend_se"),
    )


def _fit(points: Column, at: Column, near: Column, se: bool) -> Column:
    """Value of the local quadratic at ``at``; with ``se`` a struct of the value, the weight that a
    ``y`` at ``at`` itself has in it, and the sum of squares of all such weights."""
    # A one-element array holds the width, so that it is computed once and not per point.
    return F.get(
        F.transform(
            F.array(_reach(points, at, near)), lambda width: _solve(points, at, width, se)
        ), 0
    )


def _solve(points: Column, at: Column, width: Column, se: bool) -> Column:
    """The quadratic over the points closer than ``width``, with tricube weights."""
    close = F.filter(points, lambda p: F.abs(p["x"] - at) < width)
    offsets = F.transform(
        close,
        lambda p: F.struct(
            ((p["x"] - at) / width).alias("u"), p["n"].alias("n"), p["sum"].alias("sum")
        ),
    )
    weighted = F.transform(
        offsets,
        lambda p: F.struct(
            p["u"].alias("u"),
            (_tricube(p["u"]) * p["n"]).alias("w"),
            (_tricube(p["u"]) * p["sum"]).alias("wy"),
            *([(F.pow(_tricube(p["u"]), F.lit(2)) * p["n"]).alias("ww")] if se else []),
        ),
    )
    zero = F.lit(0.0)
    start = F.struct(
        F.lit(0).alias("k"),
        *[zero.alias(f"s{i}") for i in range(5)],
        *[zero.alias(f"t{i}") for i in range(3)],
        *([zero.alias(f"q{i}") for i in range(5)] if se else []),
    )
    finish = _intercept_and_weights if se else _intercept
    return F.when(
        width > 0, F.aggregate(weighted, start, lambda m, p: _add(m, p, se), finish)
    )


def _tricube(u: Column) -> Column:
    return F.pow(F.lit(1.0) - F.abs(u * u * u), F.lit(3.0))


def _reach(points: Column, at: Column, near: Column) -> Column:
    """Distance to the ``near``-th nearest point."""
    distances = F.sort_array(
        F.transform(
            points, lambda p: F.struct(F.abs(p["x"] - at).alias("d"), p["n"].alias("n"))
        )
    )
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("d"))
    return F.aggregate(
        distances,
        start,
        lambda m, p: F.struct(
            (m["seen"] + p["n"]).alias("seen"),
            F.coalesce(m["d"], F.when(m["seen"] + p["n"] >= near, p["d"])).alias("d"),
        ),
        lambda m: m["d"],
    )


def _add(m: Column, p: Column, se: bool) -> Column:
    """Adds one point to the weighted moments."""
    u = p["u"]
    powers = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u]
    return F.struct(
        (m["k"] + F.lit(1)).alias("k"),
        *[(m[f"s{i}"] + p["w"] * powers[i]).alias(f"s{i}") for i in range(5)],
        *[(m[f"t{i}"] + p["wy"] * powers[i]).alias(f"t{i}") for i in range(3)],
        *([(m[f"q{i}"] + p["ww"] * powers[i]).alias(f"q{i}") for i in range(5)] if se else []),
    )


def _intercept(m: Column) -> Column:
    """Constant term of the weighted quadratic, by Cramer's rule."""
    s0, s1, s2, s3, s4 = (m[f"s{i}"] for i in range(5))
    t0, t1, t2 = (m[f"t{i}"] for i in range(3))
    minor = s2 * s4 - s3 * s3
    determinant = s0 * minor - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    numerator = t0 * minor - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
    return F.when(m["k"] >= 3, F.try_divide(numerator, determinant))


def _intercept_and_weights(m: Column) -> Column:
    """The constant term is the sum of w (a + b u + c u**2) y; with it a, which is the weight at
    u = 0, and the sum of the squared weights."""
    s0, s1, s2, s3, s4 = (m[f"s{i}"] for i in range(5))
    q = [m[f"q{i}"] for i in range(5)]
    minor = s2 * s4 - s3 * s3
    determinant = s0 * minor - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a, b, c = (
        F.try_divide(cofactor, determinant)
        for cofactor in (minor, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2)
    )
    norm = (
        a * a * q[0] + 2 * a * b * q[1] + (b * b + 2 * a * c) * q[2] + 2 * b * c * q[3]
        + c * c * q[4]
    )
    enough = m["k"] >= 3
    return F.struct(
        _intercept(m).alias("value"),
        F.when(enough, a).alias("own"),
        F.when(enough, norm).alias("norm"),
    )
