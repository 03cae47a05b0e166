"""Store-sales operators.

The store table is a dimension (one row per store); every join against it
goes through :func:`broadcast_if_bounded`, so it is broadcast only while its
row count is provably small and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import any_substring, exact_mean, ordered_when, py_round
from storelens.functions.sizing import broadcast_if_bounded


def enrich_sales(sales: DataFrame, store: DataFrame, key: str = "store") -> DataFrame:
    """Left join of daily sales rows to the store table."""
    return sales.join(broadcast_if_bounded(store), key, "left")


def store_averages(sales: DataFrame, store: DataFrame, key: str = "store",
                   digits: int = 6) -> DataFrame:
    """Store table + avg_sales and avg_customers from one aggregate."""
    avgs = sales.groupBy(key).agg(py_round(exact_mean("sales"), digits).alias("avg_sales"),
                                  py_round(F.avg("customers"), digits).alias("avg_customers"))
    return store.join(avgs, key, "left")


def risk_return(sales: DataFrame, key: str = "store", metric: str = "sales") -> DataFrame:
    """Expected value (mean) and risk (sample std) per key (A3)."""
    return sales.groupBy(key).agg(exact_mean(metric).alias("expected_sales"),
                                  F.stddev_samp(metric).alias("risk"))


def competition_start(store: DataFrame) -> DataFrame:
    """Competition start date = first day of (year, month)."""
    return store.withColumn("competition_start_date", F.make_date(
        F.col("competition_open_since_year"), F.col("competition_open_since_month"), F.lit(1)))


def event_impact(sales: DataFrame, store: DataFrame, key: str = "store", date: str = "date",
                 metric: str = "sales", flag: str = "has_competition",
                 start: str = "competition_start_date", min_periods: int = 6) -> DataFrame:
    """Mean monthly metric before vs. from an event month, per store.

    Months are labelled by their last day, the start is the first day of a
    month, so the start month counts as "after".  Stores need at least
    ``min_periods`` observed months and both sides non-empty;
    percent_change = (after - before) / before * 100 (NULL on a zero base).
    One aggregate to (store, month), one join to the small store table and
    one more aggregate - instead of the reference's per-store loop.
    """
    monthly = sales.groupBy(key, F.last_day(F.col(date)).alias("month_end")).agg(
        exact_mean(metric).alias("m"))
    # a derived dimension: AQE broadcasts it at runtime when its stage is
    # small, without an extra pass to measure it
    st = store.where(F.col(flag) == 1).select(key, start)
    j = monthly.join(st, key)
    before = F.col("month_end") < F.col(start)
    agg = j.groupBy(key, start).agg(
        F.count(F.lit(1)).alias("months"),
        F.avg(F.when(before, F.col("m"))).alias("avg_sales_before"),
        F.avg(F.when(~before, F.col("m"))).alias("avg_sales_after"))
    agg = agg.where((F.col("months") >= min_periods) & F.col("avg_sales_before").isNotNull()
                    & F.col("avg_sales_after").isNotNull())
    pct = F.try_divide(F.col("avg_sales_after") - F.col("avg_sales_before"),
                       F.col("avg_sales_before")) * 100
    return agg.select(key, start, "months", "avg_sales_before", "avg_sales_after", pct.alias("percent_change"))


# ---------------------------------------------------------------------------
# Free-text store requests and rule estimates
# ---------------------------------------------------------------------------

# Multiplicative factors of the reference's rule estimator.
TYPE_FACTORS = {"a": 1.0, "b": 1.1, "c": 0.9, "d": 1.2}
ASSORTMENT_FACTORS = {"a": 1.0, "b": 1.1, "c": 1.2}
WEEKDAY_FACTORS = [1.0, 0.95, 0.9, 0.95, 1.1, 1.2, 0.7]          # Monday = 0
MONTH_FACTORS = {12: 1.2, 1: 0.85, 7: 1.1, 8: 1.1}
NEAR_COMPETITION, FAR_COMPETITION = 1000, 10000
FALLBACK_TYPE_AVERAGES = {"a": 4500, "b": 5000, "c": 6000}
FALLBACK_GLOBAL_AVERAGE = 5000

# The second (baseline) estimator.
BASELINE_SALES = 14500
BASELINE_TYPE_FACTORS = {"a": 1.1, "b": 1.0, "c": 0.9, "d": 1.2}
BASELINE_WEEKDAY_FACTORS = [1.0, 0.95, 0.9, 0.85, 1.1, 1.3, 0.5]
PROMO_FACTOR = 1.15

# Date formats tried in order by the baseline parser.
DATE_FORMATS = [(r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
                (r"(\d{2}/\d{2}/\d{4})", "MM/dd/yyyy"),
                (r"(\d{2}\.\d{2}\.\d{4})", "dd.MM.yyyy")]


def _factor(c, table: dict, default: float = 1.0):
    return ordered_when([(c == F.lit(k), float(v)) for k, v in table.items()], default)


def parse_store_request(df: DataFrame, text: str = "text", all_formats: bool = False) -> DataFrame:
    """Features of a free-text store request (R12; R13 with ``all_formats``).

    store_id from 'store <digits>'; store_type = first of a-d whose
    'type x' (or 'type: x' with ``all_formats``) occurs as a substring;
    assortment from 'basic/extended/extra assortment'; competition flag and
    '<n> meters'; promo flag; the first parseable date, month, weekday
    (Monday = 0) and weekend flag.
    """
    low = F.lower(F.col(text))
    sid = F.regexp_extract(low, r"store\s*(\d+)", 1)
    types = []
    for st in "abcd":
        cond = low.contains(f"type {st}")
        if all_formats:
            cond = cond | low.contains(f"type: {st}")
        types.append((cond, st))
    stype = ordered_when(types, F.lit(None).cast("string"))
    assort = ordered_when([(low.contains("basic assortment"), "a"),
                           (low.contains("extended assortment"), "b"),
                           (low.contains("extra assortment"), "c")], F.lit(None).cast("string"))
    comp = low.contains("competition")
    dist = F.regexp_extract(low, r"(\d+)\s*meters", 1)
    fmts = DATE_FORMATS if all_formats else DATE_FORMATS[:1]
    date = F.coalesce(*[F.try_to_date(F.nullif(F.regexp_extract(F.col(text), p, 1), F.lit("")), f)
                        for p, f in fmts])
    out = df.withColumns({
        "store_id": F.when(sid != "", sid.try_cast("bigint")),
        "store_type": stype,
        "assortment": assort,
        "has_competition": comp,
        "competition_distance": F.when(comp & (dist != ""), dist.try_cast("bigint")),
        "has_promo": any_substring(low, ["promotion", "promo"]),
        "date": date,
    })
    return out.withColumns({"month": F.month("date"), "day_of_week": F.weekday("date"),
                            "is_weekend": F.weekday("date") >= 5})


def baseline_lookup(requests: DataFrame, store_avgs: DataFrame, key: str = "store") -> DataFrame:
    """Base sales: store average -> type average -> global average.

    ``store_avgs`` has (store, store_type, avg_sales).  Per-store and per-type
    tables are dimensions joined with a size check; the global mean is a
    one-row broadcast.
    """
    # per-store / per-type tables are derived: AQE decides broadcast from
    # their runtime size; the global mean is one row and always broadcast
    per_store = store_avgs.groupBy(key).agg(F.avg("avg_sales").alias("_store_avg"))
    per_type = (store_avgs.groupBy("store_type").agg(F.avg("avg_sales").alias("_type_avg"))
                .withColumnRenamed("store_type", "_st"))
    glob = F.broadcast(store_avgs.agg(F.avg("avg_sales").alias("_global_avg")))
    j = (requests.join(per_store, requests["store_id"] == per_store[key], "left").drop(key)
                 .join(per_type, F.col("store_type") == F.col("_st"), "left").drop("_st")
                 .crossJoin(glob))
    return j.withColumn("base", F.coalesce("_store_avg", "_type_avg", "_global_avg")).drop(
        "_store_avg", "_type_avg", "_global_avg")


def estimate_sales(parsed: DataFrame, store_avgs: DataFrame, jitter_seed: int | None = None) -> DataFrame:
    """Multiplicative rule estimate of one day's sales.

    base (J10) x type (only when both an id and a type were given) x
    assortment x competition (near 0.9 / far 1.05 / unknown distance 0.95 /
    none 1.05) x promo 1.15 x weekday x month.  The reference adds uniform
    +-2 % noise; off by default, seeded ``rand`` if ``jitter_seed`` is set.
    """
    j = baseline_lookup(parsed, store_avgs)
    typef = F.when(F.col("store_id").isNotNull() & F.col("store_type").isNotNull(),
                   _factor(F.col("store_type"), TYPE_FACTORS)).otherwise(1.0)
    d = F.col("competition_distance")
    compf = F.when(~F.col("has_competition"), 1.05).when(d.isNull(), 0.95) \
             .when(d < NEAR_COMPETITION, 0.9).when(d > FAR_COMPETITION, 1.05).otherwise(1.0)
    # (element_at on a literal array with a NULL index is not NULL-safe in
    # every Spark version, so the lookup is an explicit CASE.)
    dowf = _factor(F.col("day_of_week"), dict(enumerate(WEEKDAY_FACTORS)))
    monthf = F.coalesce(_factor(F.col("month"), MONTH_FACTORS), F.lit(1.0))
    est = (F.col("base") * typef * _factor(F.col("assortment"), ASSORTMENT_FACTORS) * compf
           * F.when(F.col("has_promo"), PROMO_FACTOR).otherwise(1.0) * dowf * monthf)
    if jitter_seed is not None:
        est = est * (F.lit(0.98) + F.rand(jitter_seed) * 0.04)
    return j.withColumn("estimate", est)


def estimate_sales_baseline(parsed: DataFrame, store_avgs: DataFrame | None = None,
                            key: str = "store") -> DataFrame:
    """Second rule estimator.

    With a store id: that store's average, else the global baseline
    (mean of store averages, or 14500 without a store table), unadjusted.
    Without an id: baseline x type x promo x weekday factors.
    """
    if store_avgs is None:
        j = parsed.withColumn("_store_avg", F.lit(None).cast("double")).withColumn(
            "_global_avg", F.lit(float(BASELINE_SALES)))
    else:
        per_store = store_avgs.groupBy(key).agg(F.avg("avg_sales").alias("_store_avg"))
        glob = F.broadcast(store_avgs.agg(F.avg("avg_sales").alias("_global_avg")))
        j = parsed.join(per_store, parsed["store_id"] == per_store[key], "left").drop(key).crossJoin(glob)
    dowf = _factor(F.col("day_of_week"), dict(enumerate(BASELINE_WEEKDAY_FACTORS)))
    no_id = (F.col("_global_avg") * _factor(F.col("store_type"), BASELINE_TYPE_FACTORS)
             * F.when(F.col("has_promo"), PROMO_FACTOR).otherwise(1.0) * dowf)
    est = F.when(F.col("store_id").isNotNull(), F.coalesce(F.col("_store_avg"), F.col("_global_avg"))) \
           .otherwise(no_id)
    return j.withColumn("estimate", est).drop("_store_avg", "_global_avg")
