"""Calendar series: resample, moving average, period change, AR(1)
(W1-W3, A4, M20).

Series operators run on already aggregated (key, period) rows.  With
``keys`` every window is partitioned by key; without keys the series is one
row per day or month of the whole table (bounded by the calendar, not by the
data), so a single ordered window over it is cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import exact_mean


def resample_daily(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (),
                   out: str | None = None) -> DataFrame:
    """Sum per calendar day with every day between first and last present;
    an empty day is 0 (W1).  Exact decimal sums for money values."""
    keys = list(keys)
    out = out or value
    day = F.to_date(F.col(ts)).alias("date")
    sums = df.groupBy(*keys, day).agg(F.sum(F.col(value).cast("decimal(38,6)")).alias(out))
    bounds = sums.groupBy(*keys).agg(F.min("date").alias("_mn"), F.max("date").alias("_mx"))
    spine = bounds.select(*keys, F.explode(F.sequence("_mn", "_mx", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return spine.join(sums, [*keys, "date"], "left").select(
        *keys, "date", F.coalesce(F.col(out), F.lit(0)).cast("double").alias(out))


def moving_avg(df: DataFrame, order: str, value: str, n: int = 7, keys: Sequence[str] = (),
               min_periods: int | None = None, out: str | None = None) -> DataFrame:
    """Trailing ``n``-row mean; NULL until ``min_periods`` rows (default n)."""
    mp = n if min_periods is None else min_periods
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order) \
        .rowsBetween(-(n - 1), Window.currentRow)
    return df.withColumn(out or f"{value}_ma{n}",
                         F.when(F.count(value).over(w) >= mp, F.avg(value).over(w)))


def pct_change(df: DataFrame, order: str, value: str, keys: Sequence[str] = (),
               out: str | None = None) -> DataFrame:
    """v / previous v - 1 along ``order``; first row NULL, zero base NULL."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order)
    return df.withColumn(out or f"{value}_pct_change",
                         F.try_divide(F.col(value), F.lag(value).over(w)) - 1)


def period_agg(df: DataFrame, keys: Sequence[str], ts: str, value: str, period: str = "month",
               how: str = "avg") -> DataFrame:
    """Aggregate per (keys, period) labelled by the period's last day (A4)."""
    d = F.to_date(F.col(ts))
    label = {"month": F.last_day(d), "day": d,
             "year": F.make_date(F.year(d), F.lit(12), F.lit(31))}[period]
    fn = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
          "exact_mean": exact_mean}[how]
    name = "avg" if how == "exact_mean" else how
    return df.groupBy(*keys, label.alias("period_end")).agg(fn(value).alias(f"{name}_{value}"))


def ar1_forecast(df: DataFrame, key: str, order: str, value: str, steps: int = 1) -> DataFrame:
    """AR(1) without constant per key by conditional least squares.

    phi = sum(y_t * y_{t-1}) / sum(y_{t-1}^2); forecast h steps ahead from
    the last observation y_T: phi^h * y_T.  One lag window (partitioned by
    key) and one aggregate; the last value comes from ``max_by``.
    """
    w = Window.partitionBy(key).orderBy(order)
    lagged = df.select(key, order, F.col(value).cast("double").alias("y"),
                       F.lag(F.col(value).cast("double")).over(w).alias("y1"))
    agg = lagged.groupBy(key).agg(
        F.sum(F.col("y") * F.col("y1")).alias("_sxy"), F.sum(F.col("y1") * F.col("y1")).alias("_sxx"),
        F.count("y1").alias("n_pairs"), F.max_by("y", order).alias("last_value"),
        F.max(order).alias("last_" + order))
    phi = F.try_divide(F.col("_sxy"), F.col("_sxx"))
    return agg.select(key, "n_pairs", "last_" + order, "last_value", phi.alias("phi"),
                      (F.pow(phi, F.lit(float(steps))) * F.col("last_value")).alias("forecast"))
