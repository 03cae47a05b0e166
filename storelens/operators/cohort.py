"""Cohort retention, revenue per active customer and lifetime value
(A5, A6, A9-A13, W4, J3, J4).

Lines are first reduced to one row per (customer, month) - the hot
"unknown customer" key shrinks to at most one row per month before anything
keyed by customer alone.  The first month per customer is then a window
``min`` over that reduced table (no join back to raw lines), and all cohort
cells are one more group-by.  Output is long form; pivot only at the sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import money, py_round


def customer_months(df: DataFrame, customer: str = "customer_id", ts: str = "invoice_date",
                    amount: str = "total_amount", by: Sequence[str] = ()) -> DataFrame:
    """(by, customer, order_month, revenue, cohort_month, cohort_index)."""
    cm = df.groupBy(*by, F.col(customer).alias("customer_id"),
                    F.trunc(F.to_date(F.col(ts)), "MM").alias("order_month")).agg(
        F.sum(money(amount)).alias("revenue"))
    first = F.min("order_month").over(Window.partitionBy(*by, "customer_id"))
    cm = cm.withColumn("cohort_month", first)
    idx = ((F.year("order_month") - F.year("cohort_month")) * 12
           + F.month("order_month") - F.month("cohort_month"))
    return cm.withColumn("cohort_index", idx.cast("int"))


def cohorts(df: DataFrame, customer: str = "customer_id", ts: str = "invoice_date",
            amount: str = "total_amount", by: Sequence[str] = ()) -> DataFrame:
    """Long cohort table (A10, A12, W4), for each group of ``by`` on its own (P7:
    the reference's one-country tables for every country at once).

    cohort_month, cohort_index, active (distinct customers), cohort_size,
    retention_pct = active / size * 100, revenue, rev_per_active = revenue /
    active (of that cell, not the cohort size), clv = running sum of
    rev_per_active along cohort_index within the cohort.
    """
    cm = customer_months(df, customer, ts, amount, by)
    cells = cm.groupBy(*by, "cohort_month", "cohort_index").agg(
        F.count(F.lit(1)).alias("active"), F.sum("revenue").alias("revenue"))
    # the size is the cohort's own cell at index 0: a window over the few cells
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("active"))).over(Window.partitionBy(*by, "cohort_month"))
    out = cells.withColumn("cohort_size", size)
    rpa = F.col("revenue").cast("double") / F.col("active")
    w = Window.partitionBy(*by, "cohort_month").orderBy("cohort_index").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return out.select(
        *by, "cohort_month", "cohort_index", "active", "cohort_size",
        py_round(F.col("active") / F.col("cohort_size") * 100, 6).alias("retention_pct"),
        F.col("revenue").cast("double").alias("revenue"),
        py_round(rpa, 6).alias("rev_per_active"),
        py_round(F.sum(rpa).over(w), 6).alias("clv"))


def retention_curve(cohort_table: DataFrame) -> DataFrame:
    """Mean retention % per cohort index over the cohorts that have the cell."""
    return cohort_table.groupBy("cohort_index").agg(
        py_round(F.avg("retention_pct"), 4).alias("avg_retention_pct"),
        F.count(F.lit(1)).alias("cohorts"))


def clv_curve(cohort_table: DataFrame) -> DataFrame:
    """Mean cumulative value per active customer per cohort index."""
    return cohort_table.groupBy("cohort_index").agg(
        py_round(F.avg("clv"), 4).alias("avg_clv"), F.count(F.lit(1)).alias("cohorts"))


def to_wide(long: DataFrame, row: str, column: str, value: str, values: list | None = None) -> DataFrame:
    """Pivot without aggregation (A9): unique (row, column) pairs -> matrix.

    Pass ``values`` to skip the distinct-values pass Spark otherwise runs.
    """
    g = long.groupBy(row)
    p = g.pivot(column, values) if values is not None else g.pivot(column)
    return p.agg(F.first(value))
