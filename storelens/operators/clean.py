"""Projections, filters and cleaning.

Global statistics a fill or filter needs (median, max, quantile bounds) are
one-row aggregates.  They are fetched (one row, bounded) and applied as
literals: the statistic's plan is not nested into the data's plan again -
which would double the lineage at every step of a chained filter - and a
literal range filter can be pushed into the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import map_lookup
from storelens.functions.quantile import exact_quantiles
from storelens.operators.calendar import calendar_features


def fill_defaults(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a constant per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in values.items()})


def _one_row(df: DataFrame, stat) -> DataFrame:
    return df.agg(stat.alias("_fill"))


def _fill_literal(df: DataFrame, column: str, value) -> DataFrame:
    typ = df.schema[column].dataType
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value).cast(typ)))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """NULL -> exact median of the column."""
    row = exact_quantiles(df, column, [0.5], names=["_fill"]).first()
    return _fill_literal(df, column, None if row is None else row["_fill"])


def fill_max_plus(df: DataFrame, column: str, plus: int = 1) -> DataFrame:
    """NULL -> column max + ``plus``."""
    return _fill_literal(df, column, _one_row(df, F.max(column) + plus).first()["_fill"])


def presence_flag(df: DataFrame, column: str, out: str) -> DataFrame:
    """1 where ``column`` is not NULL; must run before the fill."""
    return df.withColumn(out, F.col(column).isNotNull().cast("int"))


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Type normalisation (P8); ``try_cast`` gives NULL for bad values."""
    return df.withColumns({c: (F.col(c).cast(t) if strict else F.col(c).try_cast(t))
                           for c, t in types.items()})


def dedupe(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Full-row DISTINCT (U3).  Partial aggregation collapses copies on the
    map side, so even a hot group of copies is reduced before the shuffle."""
    return df.dropDuplicates(list(subset)) if subset else df.distinct()


def drop_unknown(df: DataFrame, column: str, sentinel: object = -1) -> DataFrame:
    """Drop rows holding the 'unknown' sentinel."""
    return df.where(F.col(column) != F.lit(sentinel))


def map_labels(df: DataFrame, column: str, mapping: Mapping, out: str, default: object = None) -> DataFrame:
    """Value -> label map."""
    return df.withColumn(out, map_lookup(column, mapping, default))


def iqr_bounds(df: DataFrame, column: str, lo: float = 0.25, hi: float = 0.75,
               k: float = 1.5) -> tuple[float | None, float | None]:
    """(lower, upper) = (q_lo - k*IQR, q_hi + k*IQR) for ``column``."""
    q = exact_quantiles(df, column, [lo, hi], names=["q_lo", "q_hi"])
    iqr = F.col("q_hi") - F.col("q_lo")
    row = q.select((F.col("q_lo") - k * iqr).alias("lower"), (F.col("q_hi") + k * iqr).alias("upper")).first()
    return (None, None) if row is None else (row["lower"], row["upper"])


def iqr_filter(df: DataFrame, columns: Sequence[str], lo: float = 0.25, hi: float = 0.75,
               k: float = 1.5, sequential: bool = True) -> DataFrame:
    """Keep rows inside ``[q_lo - k*IQR, q_hi + k*IQR]`` (inclusive).

    ``sequential=True``: each column's quantiles come from the rows the
    previous column left (the reference service's loop).  Otherwise all
    bounds come from the input.
    """
    base = df
    out = df
    for i, c in enumerate(columns):
        if sequential and i > 0:
            # the filtered table feeds both the next quantiles and the next
            # filter; keep it instead of recomputing the whole lineage
            out = out.persist()
        lower, upper = iqr_bounds(out if sequential else base, c, lo, hi, k)
        if lower is None:           # no values at all: nothing survives
            return out.where(F.lit(False))
        out = out.where(F.col(c).between(F.lit(lower), F.lit(upper)))
    return out


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Deterministic sample of up to ``n`` rows.

    Rows are ranked by the MD5 digest of seed and key; the top-n is a bounded
    TakeOrderedAndProject (each partition keeps n, then one merge of n rows
    per partition).  Rows with a null key come last.  It cannot reproduce pandas'
    random draw.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(h.asc_nulls_last(), F.col(key)).limit(n)


# The reference's fills for the retail and store tables.
RETAIL_FILLS = {"description": "Unknown Item", "customer_id": -1}
STORE_FILLS = {"promo_interval": "None", "promo2_since_week": 0, "promo2_since_year": 0,
               "competition_open_since_month": 1}


def clean_retail(df: DataFrame, ts: str = "invoice_date") -> DataFrame:
    """Reference cleaning of invoice lines.

    Description -> 'Unknown Item', customer -> -1, keep quantity > 0 then
    price > 0, a full-row DISTINCT, then the calendar features and
    total_amount = quantity * price: functions of the source columns, so only
    those are shuffled.
    """
    out = fill_defaults(df, RETAIL_FILLS)
    out = dedupe(out.where(F.col("quantity") > 0).where(F.col("price") > 0))
    out = calendar_features(out, ts)
    return out.withColumn("total_amount", F.col("quantity") * F.col("price"))


def clean_store(df: DataFrame) -> DataFrame:
    """Reference cleaning of the store table.

    has_competition flag (before any fill), competition_distance -> median,
    competition_open_since_year -> max + 1, month -> 1, promo fields -> 0 / 'None'.
    """
    out = presence_flag(df, "competition_open_since_month", "has_competition")
    out = fill_median(out, "competition_distance")
    out = fill_max_plus(out, "competition_open_since_year", 1)
    return fill_defaults(out, STORE_FILLS)
