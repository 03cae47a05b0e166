"""Calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar_features(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """year, month, day, ISO week and day_of_week with Monday = 0."""
    t = F.col(ts)
    return df.withColumns({
        f"{prefix}year": F.year(t),
        f"{prefix}month": F.month(t),
        f"{prefix}day": F.dayofmonth(t),
        f"{prefix}week": F.weekofyear(t),
        f"{prefix}day_of_week": F.weekday(t),
    })


def month_start(df: DataFrame, ts: str, out: str = "month_start") -> DataFrame:
    """First day of the month as a DATE (P10); the source column is kept."""
    return df.withColumn(out, F.trunc(F.to_date(F.col(ts)), "MM"))


def start_date(df: DataFrame, year: str, month: str, out: str = "start_date") -> DataFrame:
    """DATE from year and month columns, day 1 (P11); NULL if either is NULL."""
    return df.withColumn(out, F.make_date(F.col(year), F.col(month), F.lit(1)))
