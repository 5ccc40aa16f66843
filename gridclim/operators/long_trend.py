"""The local quadratic trend of long series, whose points no task holds as a whole.

The sorted points of a series are cut into blocks. The nearest share of the points is one contiguous
window, which slides along with the fits: blocks wholly within the windows of some neighbouring fits
enter by their moments, since tricube weights are polynomials of the distance on either side; the few
blocks in which the windows begin and end, and the fits' own, enter point by point."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .trend import SPAN

#: Points of a block; longer series have blocks of the root of their length.
BLOCK = 512
#: Blocks that fits made together may need point by point; more are met by fewer fits at a time.
NEEDED = 12
#: Fits whose distances are held at a time.
FITS = 64

# Powers of the distance in the moments of counts, sums of values, and squared weights.
COUNTS, SUMS, SQUARES = 13, 11, 22


def long_trend(
    df: DataFrame, groups: Sequence[str], x: str, y: str, span: float = SPAN, se: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """``local_trend`` with the same result, for series of any number of distinct ``x``.

    A task holds blocks of some points and one summary of each block of a series. Both grow with the
    root of the number of distinct ``x``. Rows are combined per ``x`` first; an ``x`` with a large
    share of the rows is a block of its own. Sorted points, blocks and fits are stored in the
    scratch folder when this is called; numpy makes the fits within Spark's tasks. Where nearly all
    weight of a fit lies in one spot, so that a quadratic is hardly determined, both operators round
    in their own ways."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_points = _stored(_points(df, groups, x, y, tasks), "trend-points")
    keys = sorted_points.groupBy("_group").agg(*[F.first(g).alias(g) for g in groups])
    blocks = _stored(_blocks(sorted_points, span, block), "trend-blocks")
    top = SQUARES if se else COUNTS
    summaries = blocks.select("_group", "_block", "_x", "_n", "_sum").mapInPandas(
        lambda frames: _summaries(frames, top), "_group string, _block long, first double,"
        " last double, count long, points long, moments array<double>, sums array<double>",
    ).groupBy("_group").agg(F.sort_array(F.collect_list(F.struct(
        "_block", "first", "last", "count", "points", "moments", "sums"
    ))).alias("_all"))
    sides = summaries.select(
        "_group", F.col("_all._block").alias("blocks"),
        *[F.col(f"_all.{c}").alias(c) for c in ("first", "last", "count", "points")],
        F.flatten("_all.moments").alias("moments"), F.flatten("_all.sums").alias("sums"),
    )
    asked = blocks.select("_group", "_block", "_x", "_near").join(sides, "_group").repartition(
        tasks, "_group", "_block"
    )
    chunks = _stored(
        asked.mapInPandas(
            lambda frames: _chunks(frames, top), "_group string, _block long, low int, high int,"
            " near long, points long, scale double, centre double, needed array<long>,"
            " moments array<double>, sums array<double>",
        ), "trend-chunks",
    )
    met = (
        chunks.select("_group", "_block", "low", F.explode("needed").alias("_other"))
        .join(blocks.select(
            "_group", F.col("_block").alias("_other"), F.col("_x").alias("xs"),
            F.col("_n").alias("ns"), F.col("_sum").alias("ys"),
        ), ["_group", "_other"])
        .groupBy("_group", "_block", "low")
        .agg(F.sort_array(F.collect_list(F.struct("_other", "xs", "ns", "ys"))).alias("_met"))
        .select("_group", "_block", "low",
                *[F.flatten(f"_met.{c}").alias(c) for c in ("xs", "ns", "ys")])
    )
    own = blocks.select("_group", "_block", F.col("_x").alias("own"))
    # Stored, as the error of a series takes the fits a second time.
    fitted = _stored(
        chunks.drop("needed").join(met, ["_group", "_block", "low"]).join(own, ["_group", "_block"])
        .repartition(tasks, "_group", "_block", "low")
        .mapInPandas(
            lambda frames: _fitted(frames, top, se), "_group string, _block long, low int,"
            " high int, value array<double>, weight array<double>, norm array<double>",
        ),
        "trend-fits",
    )
    part = lambda c: F.slice(c, F.col("low") + 1, F.col("high") - F.col("low")).alias(c)
    fits = (
        fitted.join(blocks.drop("_near"), ["_group", "_block"])
        .select("_group", F.explode(F.arrays_zip(
            *[part(c) for c in ("_at", "_n", "_sum", "_within")], "value", "weight", "norm"
        )).alias("_fit"))
        .select("_group", "_fit.*")
        .withColumn("_mean", F.col("_sum") / F.col("_n"))
    )
    shown = [F.col("_at").alias(x), F.col("_mean").alias(y), F.col("value").alias("trend")]
    if se:
        residual = F.col("_mean") - F.col("value")
        whole = fits.groupBy("_group").agg(
            F.sum(F.col("_within") + F.col("_n") * residual * residual).alias("_squares"),
            F.sum(F.col("_n") * (1 - 2 * F.col("weight") + F.col("norm"))).alias("_freedom"),
            F.max(F.col("value").isNull()).alias("_missing"),
        )
        fits = fits.join(whole, "_group")
        shown.append(F.when(
            ~F.col("_missing") & (F.col("_freedom") > 1e-9),
            F.sqrt(F.col("_squares") / F.col("_freedom") * F.col("norm")),
        ).alias("trend_se"))
    fits = fits.select("_group", *shown)
    return fits.join(keys, "_group").select(*groups, x, y, *[c for c in fits.columns if "trend" in c])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _points(
    df: DataFrame, groups: Sequence[str], x: str, y: str, tasks: int
) -> DataFrame:
    """One row per distinct ``x``, dealt to sorted ranges that the column ``_part`` numbers."""
    value = F.col(y).cast("double")
    points = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*groups, F.col(x).alias("_at"))
        .agg(
            F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"),
            (F.var_pop(value) * F.count(F.lit(1))).alias("_within"),
        )
        .withColumn("_group", F.to_json(F.struct(*groups)))
        .withColumn("_x", F.col("_at").cast("double"))
    )
    return points.repartitionByRange(tasks, "_group", "_at").withColumn(
        "_part", F.spark_partition_id()
    )


def _blocks(points: DataFrame, span: float, block: int) -> DataFrame:
    """Arrays of neighbouring points. A block has a bounded number of points and of rows, but for
    one point with many rows; its number is the rank of its first point."""
    parts = points.groupBy("_group", "_part").agg(
        F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_rows")
    )
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy("_group")
    points_all, rows_all = F.sum("_d").over(whole), F.sum("_rows").over(whole)
    parts = parts.select(
        "_group", "_part",
        F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
        F.greatest(F.lit(block), F.ceil(F.sqrt(points_all))).cast("long").alias("_size"),
        points_all.alias("_points"), rows_all.alias("_all_rows"),
        F.floor(rows_all * F.lit(span) + F.lit(1e-5)).alias("_near"),
    ).withColumn(
        "_share", F.ceil(F.col("_all_rows") / F.ceil(F.col("_points") / F.col("_size")))
    )
    here = Window.partitionBy("_group", "_part").orderBy("_at")
    ranked = points.join(parts, ["_group", "_part"]).select(
        "_group", "_at", "_x", "_n", "_sum", "_within", "_size", "_share", "_near",
        (F.row_number().over(here) + F.col("_d0")).alias("_rank"),
        (F.sum("_n").over(here) + F.col("_rows0")).alias("_to"),
    )
    entry = F.struct("_rank", "_at", "_x", "_n", "_sum", "_within")
    return (
        ranked.groupBy(
            "_group", "_near",
            F.floor((F.col("_rank") - 1) / F.col("_size")).alias("_a"),
            F.floor((F.col("_to") - F.col("_n")) / F.col("_share")).alias("_b"),
            F.floor((F.col("_to") - 1) / F.col("_share")).alias("_c"),
        )
        .agg(F.min("_rank").cast("long").alias("_block"),
             F.sort_array(F.collect_list(entry)).alias("_p"))
        .select("_group", "_block", "_near",
                *[F.col(f"_p.{c}").alias(c) for c in ("_at", "_x", "_n", "_sum", "_within")])
    )


def _powers(d: np.ndarray, top: int) -> np.ndarray:
    return d[:, None] ** np.arange(top + 1)


def _moved(moments: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Moments about a point that lies ``shift`` before the one they are about, per shift."""
    top = len(moments) - 1
    shifted = _powers(shift, top)
    return np.stack([
        sum(comb(m, i) * shifted[:, m - i] * moments[i] for i in range(m + 1))
        for m in range(top + 1)
    ], axis=1)


def _summaries(frames: Iterator[pd.DataFrame], top: int) -> Iterator[pd.DataFrame]:
    """First and last point, rows and points of each block, and its moments about its middle, in
    units of the block's own width."""
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            xs, n, ys = row[2], np.asarray(row[3], float), row[4]
            width = (xs[-1] - xs[0]) / 2 or 1.0
            powers = _powers((xs - (xs[0] + xs[-1]) / 2) / width, top)
            rows.append((
                row[0], row[1], xs[0], xs[-1], int(n.sum()), len(xs), n @ powers,
                ys @ powers[:, : SUMS + 1],
            ))
        yield pd.DataFrame(rows, columns=[
            "_group", "_block", "first", "last", "count", "points", "moments", "sums"
        ])


def _together(moments, middle, half, centre, scale):
    """Moments of some blocks about one centre, in units of ``scale``."""
    top = moments.shape[1] - 1
    own = moments * (half / scale)[:, None] ** np.arange(top + 1)
    mixed = _powers((middle - centre) / scale, top).T @ own
    return np.array([
        sum(comb(m, i) * mixed[m - i, i] for i in range(m + 1)) for m in range(top + 1)
    ])


def _edges(first, last, count, near, low, high):
    """Where windows of ``near`` rows around points from ``low`` to ``high`` may begin and end, as
    far as the blocks tell: ((from, to), (from, to))."""
    bounds = []
    for at in (low, high):
        close = np.maximum(0, np.maximum(first - at, at - last))
        far = np.maximum(at - first, last - at)
        found = []
        for distance in (close, far):
            order = np.argsort(distance, kind="stable")
            found.append(distance[order[np.searchsorted(np.cumsum(count[order]), near)]])
        bounds.append(found)
    (least0, most0), (least1, most1) = bounds
    return (low - most0, high - least1), (low + least0, high + most1)


def _chunks(frames: Iterator[pd.DataFrame], top: int) -> Iterator[pd.DataFrame]:
    """The fits of a block, some at a time: which blocks they need point by point, and the moments
    of those that lie within all of their windows, to the left and to the right."""
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            group, block, xs, near, blocks, first, last, count, points, moments, sums = row
            moments, sums = moments.reshape(len(first), -1), sums.reshape(len(first), -1)
            middle, half = (first + last) / 2, (last - first) / 2
            half = np.where(half > 0, half, 1.0)
            scale = (last[-1] - first[0]) or 1.0
            here = int(np.searchsorted(blocks, block))
            todo = [(0, len(xs))]
            if not 0 < near <= count.sum():
                # Windows of no rows, or of more than there are, have no fits.
                rows.append((group, block, 0, len(xs), 0, 0, 1.0, 0.0, [block],
                             np.zeros(2 * top + 2), np.zeros(2 * SUMS + 2)))
                continue
            while todo:
                low, high = todo.pop()
                left, right = _edges(first, last, count, near, xs[low], xs[high - 1])
                needed = (last >= left[0]) & (first <= left[1])
                needed |= (last >= right[0]) & (first <= right[1])
                needed[here] = True
                inside = ~needed & (first > left[1]) & (last < right[0])
                # Moments are moved from one centre to all fits, which loses digits if these lie
                # far apart in comparison with their windows.
                apart = 2 * (xs[high - 1] - xs[low]) > min(
                    xs[high - 1] - left[1], right[0] - xs[low]
                )
                if (needed.sum() > NEEDED or inside.any() and apart) and high - low > 1:
                    half_way = (low + high) // 2
                    todo += [(low, half_way), (half_way, high)]
                    continue
                centre = (xs[low] + xs[high - 1]) / 2
                sides = [inside & (np.arange(len(first)) < here)]
                sides.append(inside & ~sides[0])
                rows.append((
                    group, block, low, high, near - int(count[inside].sum()),
                    int(points[inside].sum()), scale, centre, blocks[needed],
                    *[np.concatenate([
                        _together(m[s], middle[s], half[s], centre, scale) for s in sides
                    ]) for m in (moments, sums)],
                ))
        yield pd.DataFrame(rows, columns=[
            "_group", "_block", "low", "high", "near", "points", "scale", "centre", "needed",
            "moments", "sums",
        ])


def _inside(moments, shift, width, powers, exponent):
    """Sums of (1 - |u|**3)**exponent * u**j over both sides, from moments, for j below ``powers``."""
    total = np.zeros((len(width), powers))
    for side, sign in zip(moments.reshape(2, -1), (-1, 1)):
        about = _moved(side[: 3 * exponent + powers], shift)
        about = about / width[:, None] ** np.arange(about.shape[1])
        for k in range(exponent + 1):
            total += comb(exponent, k) * (-sign) ** k * about[:, 3 * k : 3 * k + powers]
    return total


def _fitted(frames: Iterator[pd.DataFrame], top: int, se: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            at = row.own[row.low : row.high]
            found = [
                _fit(row, at[n : n + FITS], se) for n in range(0, len(at), FITS)
            ]
            columns = [np.concatenate(c) for c in zip(*found)]
            rows.append((row[0], row[1], row.low, row.high, *[
                [v if np.isfinite(v) else None for v in c.tolist()] for c in columns
            ]))
        yield pd.DataFrame(rows, columns=[
            "_group", "_block", "low", "high", "value", "weight", "norm"
        ])


def _fit(row, at: np.ndarray, se: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each fit, the weight of its own point in it, and the sum of all squared weights;
    not a number where there is none."""
    if not row.near:
        return (np.full(len(at), np.nan),) * 3
    n = np.asarray(row.ns, float)
    away = row.xs[None, :] - at[:, None]
    distance = np.abs(away)
    if (n == 1).all():
        width = np.partition(distance, row.near - 1, axis=1)[:, row.near - 1]
    else:
        order = np.argsort(distance, axis=1, kind="stable")
        enough = np.cumsum(n[order], axis=1) >= row.near
        nearest = order[np.arange(len(at)), enough.argmax(axis=1)]
        width = distance[np.arange(len(at)), nearest]
    flat = width <= 0
    width = np.where(flat, 1.0, width)
    u = away / width[:, None]
    tricube = np.clip(1 - np.abs(u) ** 3, 0, None) ** 3
    points = row.points + (distance < width[:, None]).sum(axis=1)
    shift, unit = (row.centre - at) / row.scale, width / row.scale
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        s, t = (
            _inside(np.asarray(m), shift, unit, p, 3)
            for m, p in ((row.moments, 5), (row.sums, 3))
        )
        s += np.stack([(tricube * u**j) @ n for j in range(5)], axis=1)
        t += np.stack([(tricube * u**j) @ row.ys for j in range(3)], axis=1)
        minor = s[:, 2] * s[:, 4] - s[:, 3] ** 2
        second = s[:, 2] * s[:, 3] - s[:, 1] * s[:, 4]
        third = s[:, 1] * s[:, 3] - s[:, 2] ** 2
        determinant = s[:, 0] * minor + s[:, 1] * second + s[:, 2] * third
        bad = flat | (points < 3) | (determinant == 0)
        a, b, c = (np.where(bad, np.nan, v / determinant) for v in (minor, second, third))
        value = a * t[:, 0] + b * t[:, 1] + c * t[:, 2]
        norm = np.full(len(at), np.nan)
        if se:
            q = _inside(np.asarray(row.moments), shift, unit, 5, 6)
            q += np.stack([(tricube**2 * u**j) @ n for j in range(5)], axis=1)
            norm = (
                a * a * q[:, 0] + 2 * a * b * q[:, 1] + (b * b + 2 * a * c) * q[:, 2]
                + 2 * b * c * q[:, 3] + c * c * q[:, 4]
            )
    return value, a, norm
