"""Store-sales queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.exprs import exact_mean, py_round
from storelens.operators import clean as C
from storelens.operators import stores as S
from storelens.operators import timeseries as TS
from storelens.plans.catalog import register
from storelens.sources.fixtures import VIEWS

STORE_CLEAN_SQL = """
store_c AS (
  SELECT store, store_type, assortment, coalesce(competition_distance, m.med) AS competition_distance,
         coalesce(competition_open_since_month, 1) AS competition_open_since_month,
         CAST(coalesce(competition_open_since_year, m.ymax) AS INTEGER) AS competition_open_since_year,
         promo2, coalesce(promo2_since_week, 0) AS promo2_since_week, coalesce(promo2_since_year, 0) AS promo2_since_year,
         coalesce(promo_interval, 'None') AS promo_interval,
         CAST(competition_open_since_month IS NOT NULL AS INTEGER) AS has_competition
  FROM store CROSS JOIN (SELECT quantile_cont(competition_distance, 0.5) AS med,
                                max(competition_open_since_year) + 1 AS ymax FROM store) m)
"""

AVGS_SQL = """
avgs AS (SELECT store, round(CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales), 6) AS avg_sales, round(avg(customers), 6) AS avg_customers
         FROM store_sales GROUP BY 1)
"""


def _sales(spark, sf):
    return VIEWS["store_sales"](spark, sf)


def _store(spark, sf):
    return C.clean_store(VIEWS["store"](spark, sf))


@register("store_enriched", "SELECT x.*, s.* EXCLUDE (store) FROM store_sales x LEFT JOIN store s ON x.store = s.store",
          views=("store_sales", "store"))
def q_enriched(spark, sf):
    """Daily sales rows left-joined to the store table."""
    return S.enrich_sales(_sales(spark, sf), VIEWS["store"](spark, sf))


@register("store_averages", f"WITH {STORE_CLEAN_SQL.strip()}, {AVGS_SQL.strip()} "
          "SELECT s.*, a.avg_sales, a.avg_customers FROM store_c s LEFT JOIN avgs a ON s.store = a.store",
          views=("store_sales", "store"))
def q_store_averages(spark, sf):
    """Cleaned store table with per-store average sales and customers."""
    return S.store_averages(_sales(spark, sf), _store(spark, sf))


@register("risk_return", "SELECT store, round(CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales), 4) AS expected_sales, round(stddev_samp(sales), 2) AS risk "
          "FROM store_sales GROUP BY 1", views=("store_sales",))
def q_risk(spark, sf):
    """A3: mean and sample std of daily sales per store."""
    r = S.risk_return(_sales(spark, sf))
    return r.select("store", py_round("expected_sales", 4).alias("expected_sales"), py_round("risk", 2).alias("risk"))


@register("competition_impact", f"""
WITH {STORE_CLEAN_SQL.strip()},
st AS (SELECT store, make_date(competition_open_since_year, competition_open_since_month, 1) AS competition_start_date
       FROM store_c WHERE has_competition = 1),
monthly AS (SELECT store, last_day(date) AS month_end, CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales) AS m FROM store_sales GROUP BY 1, 2),
agg AS (SELECT m.store, st.competition_start_date, count(*) AS months,
               avg(m) FILTER (WHERE month_end < competition_start_date) AS b,
               avg(m) FILTER (WHERE month_end >= competition_start_date) AS a
        FROM monthly m JOIN st ON m.store = st.store GROUP BY 1, 2)
SELECT store, competition_start_date, months, round(b, 4) AS avg_sales_before, round(a, 4) AS avg_sales_after,
       round((a - b) / b * 100, 4) AS percent_change
FROM agg WHERE months >= 6 AND a IS NOT NULL AND b IS NOT NULL
""", views=("store_sales", "store"))
def q_competition(spark, sf):
    """Per-store % change of mean monthly sales after competition opened."""
    st = S.competition_start(_store(spark, sf))
    out = S.event_impact(_sales(spark, sf), st)
    return out.select("store", "competition_start_date", "months",
                      py_round("avg_sales_before", 4).alias("avg_sales_before"),
                      py_round("avg_sales_after", 4).alias("avg_sales_after"),
                      py_round("percent_change", 4).alias("percent_change"))


@register("top_competition_losers", f"""
WITH {STORE_CLEAN_SQL.strip()},
st AS (SELECT store, make_date(competition_open_since_year, competition_open_since_month, 1) AS s FROM store_c WHERE has_competition = 1),
monthly AS (SELECT store, last_day(date) AS month_end, CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales) AS m FROM store_sales GROUP BY 1, 2),
agg AS (SELECT m.store, count(*) AS months, avg(m) FILTER (WHERE month_end < s) AS b, avg(m) FILTER (WHERE month_end >= s) AS a
        FROM monthly m JOIN st ON m.store = st.store GROUP BY 1)
SELECT store, round((a - b) / b * 100, 4) AS percent_change FROM agg
WHERE months >= 6 AND a IS NOT NULL AND b IS NOT NULL ORDER BY (a - b) / b * 100, store LIMIT 10
""", views=("store_sales", "store"))
def q_losers(spark, sf):
    """O1: ten stores with the largest drop after competition (top-k report)."""
    st = S.competition_start(_store(spark, sf))
    out = S.event_impact(_sales(spark, sf), st)
    return out.orderBy("percent_change", "store").limit(10).select(
        "store", py_round("percent_change", 4).alias("percent_change"))


@register("top_competition_winners", f"""
WITH {STORE_CLEAN_SQL.strip()},
st AS (SELECT store, make_date(competition_open_since_year, competition_open_since_month, 1) AS s FROM store_c WHERE has_competition = 1),
monthly AS (SELECT store, last_day(date) AS month_end, CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales) AS m FROM store_sales GROUP BY 1, 2),
agg AS (SELECT m.store, count(*) AS months, avg(m) FILTER (WHERE month_end < s) AS b, avg(m) FILTER (WHERE month_end >= s) AS a
        FROM monthly m JOIN st ON m.store = st.store GROUP BY 1)
SELECT store, round((a - b) / b * 100, 4) AS percent_change FROM agg
WHERE months >= 6 AND a IS NOT NULL AND b IS NOT NULL ORDER BY (a - b) / b * 100 DESC, store LIMIT 10
""", views=("store_sales", "store"))
def q_winners(spark, sf):
    """O1: ten stores with the largest rise after competition (top-k report)."""
    st = S.competition_start(_store(spark, sf))
    out = S.event_impact(_sales(spark, sf), st)
    return out.orderBy(F.desc("percent_change"), "store").limit(10).select(
        "store", py_round("percent_change", 4).alias("percent_change"))


@register("monthly_sales", """
WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start,
                  CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) AS total_sales,
                  CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales) AS a
           FROM store_sales GROUP BY 1)
SELECT month_start, total_sales, round(a, 4) AS avg_sales,
       round(total_sales / lag(total_sales) OVER (ORDER BY month_start) - 1, 6) AS total_sales_pct_change
FROM m
""", views=("store_sales",))
def q_monthly(spark, sf):
    """P10 + A1 + A2 + W3: monthly total and mean sales with period change."""
    ss = _sales(spark, sf).withColumn("month_start", F.trunc("date", "MM"))
    m = ss.groupBy("month_start").agg(
        F.sum(F.col("sales").cast("decimal(38,6)")).cast("double").alias("total_sales"),
        py_round(exact_mean("sales"), 4).alias("avg_sales"))
    m = TS.pct_change(m, "month_start", "total_sales")
    return m.withColumn("total_sales_pct_change", py_round("total_sales_pct_change", 6))


@register("daily_sales_ma7", """
WITH d AS (SELECT date, sum(CAST(sales AS DECIMAL(38,6))) AS s FROM store_sales GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
f AS (SELECT sp.date, CAST(coalesce(d.s, 0) AS DOUBLE) AS sales FROM sp LEFT JOIN d ON sp.date = d.date)
SELECT date, sales,
       CASE WHEN count(sales) OVER w >= 7 THEN round(avg(sales) OVER w, 4) END AS sales_ma7
FROM f WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""", views=("store_sales",))
def q_daily(spark, sf):
    """W1 + W2: gap-filled daily totals with a 7-row trailing mean."""
    d = TS.resample_daily(_sales(spark, sf), "date", "sales")
    d = TS.moving_avg(d, "date", "sales", 7)
    return d.withColumn("sales_ma7", py_round("sales_ma7", 4))


@register("store_daily_resample", """
WITH d AS (SELECT store, date, sum(CAST(sales AS DECIMAL(38,6))) AS s FROM store_sales GROUP BY 1, 2),
b AS (SELECT store, min(date) AS mn, max(date) AS mx FROM d GROUP BY 1),
sp AS (SELECT store, CAST(unnest(generate_series(mn, mx, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT sp.store, sp.date, CAST(coalesce(d.s, 0) AS DOUBLE) AS sales
FROM sp LEFT JOIN d ON sp.store = d.store AND sp.date = d.date
""", views=("store_sales",))
def q_store_daily(spark, sf):
    """W1 per store: every day between a store's first and last sale, empty = 0."""
    return TS.resample_daily(_sales(spark, sf), "date", "sales", keys=["store"])


@register("store_monthly_avg", "SELECT store, last_day(date) AS period_end, CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales) AS avg_sales "
          "FROM store_sales GROUP BY 1, 2", views=("store_sales",))
def q_store_monthly(spark, sf):
    """A4: mean daily sales per (store, month) labelled by month end."""
    return TS.period_agg(_sales(spark, sf), ["store"], "date", "sales", "month", "exact_mean")


@register("pivot_day_month", "SELECT day(date) AS day, " + ", ".join(
    f"round(CAST(sum(CAST(sales AS DECIMAL(38,6))) FILTER (WHERE month(date) = {m}) AS DOUBLE) / count(sales) FILTER (WHERE month(date) = {m}), 4) AS m{m}" for m in range(1, 13))
    + " FROM store_sales GROUP BY 1", views=("store_sales",))
def q_pivot(spark, sf):
    """Mean sales, day of month x month (NULL where a cell is empty)."""
    ss = _sales(spark, sf).select(F.dayofmonth("date").alias("day"), F.month("date").alias("month"), "sales")
    p = ss.groupBy("day").pivot("month", list(range(1, 13))).agg(exact_mean("sales"))
    return p.select("day", *[py_round(F.col(str(m)), 4).alias(f"m{m}") for m in range(1, 13)])


PARSE_SQL = r"""
parsed AS (
  SELECT request_id, text,
    CASE WHEN regexp_extract(lower(text), 'store\s*(\d+)', 1) <> '' THEN TRY_CAST(regexp_extract(lower(text), 'store\s*(\d+)', 1) AS BIGINT) END AS store_id,
    CASE WHEN (contains(lower(text), 'type a'){ta}) THEN 'a' WHEN (contains(lower(text), 'type b'){tb}) THEN 'b'
         WHEN (contains(lower(text), 'type c'){tc}) THEN 'c' WHEN (contains(lower(text), 'type d'){td}) THEN 'd' END AS store_type,
    CASE WHEN contains(lower(text), 'basic assortment') THEN 'a' WHEN contains(lower(text), 'extended assortment') THEN 'b'
         WHEN contains(lower(text), 'extra assortment') THEN 'c' END AS assortment,
    contains(lower(text), 'competition') AS has_competition,
    CASE WHEN contains(lower(text), 'competition') AND regexp_extract(lower(text), '(\d+)\s*meters', 1) <> ''
         THEN TRY_CAST(regexp_extract(lower(text), '(\d+)\s*meters', 1) AS BIGINT) END AS competition_distance,
    contains(lower(text), 'promotion') OR contains(lower(text), 'promo') AS has_promo,
    {date} AS date
  FROM store_requests),
p2 AS (SELECT *, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
              isodow(date) - 1 >= 5 AS is_weekend FROM parsed)
"""

DATE1 = r"CAST(try_strptime(nullif(regexp_extract(text, '(\d{4}-\d{2}-\d{2})', 1), ''), '%Y-%m-%d') AS DATE)"
DATE3 = ("coalesce(" + DATE1 + r", CAST(try_strptime(nullif(regexp_extract(text, '(\d{2}/\d{2}/\d{4})', 1), ''), '%m/%d/%Y') AS DATE)"
         r", CAST(try_strptime(nullif(regexp_extract(text, '(\d{2}\.\d{2}\.\d{4})', 1), ''), '%d.%m.%Y') AS DATE))")


def _parse_sql(all_formats: bool) -> str:
    t = {f"t{x}": (f" OR contains(lower(text), 'type: {x}')" if all_formats else "") for x in "abcd"}
    return PARSE_SQL.format(date=DATE3 if all_formats else DATE1, **t).strip()


@register("store_requests_parsed", f"WITH {_parse_sql(False)} SELECT * FROM p2", views=("store_requests",))
def q_parse(spark, sf):
    """Features parsed from free-text store requests."""
    return S.parse_store_request(VIEWS["store_requests"](spark, sf))


EST_SQL = """
SELECT p2.request_id, p2.store_id, p2.store_type, round(base, 4) AS base, round(
  base
  * (CASE WHEN store_id IS NOT NULL AND store_type IS NOT NULL THEN
          (CASE store_type WHEN 'a' THEN 1.0 WHEN 'b' THEN 1.1 WHEN 'c' THEN 0.9 WHEN 'd' THEN 1.2 ELSE 1.0 END) ELSE 1.0 END)
  * (CASE assortment WHEN 'a' THEN 1.0 WHEN 'b' THEN 1.1 WHEN 'c' THEN 1.2 ELSE 1.0 END)
  * (CASE WHEN NOT has_competition THEN 1.05 WHEN competition_distance IS NULL THEN 0.95
          WHEN competition_distance < 1000 THEN 0.9 WHEN competition_distance > 10000 THEN 1.05 ELSE 1.0 END)
  * (CASE WHEN has_promo THEN 1.15 ELSE 1.0 END)
  * coalesce(([1.0, 0.95, 0.9, 0.95, 1.1, 1.2, 0.7])[day_of_week + 1], 1.0)
  * coalesce(CASE month WHEN 12 THEN 1.2 WHEN 1 THEN 0.85 WHEN 7 THEN 1.1 WHEN 8 THEN 1.1 ELSE 1.0 END, 1.0), 4) AS estimate
FROM (SELECT p2.*, coalesce(ps.a, pt.a, g.a) AS base FROM p2
      LEFT JOIN (SELECT store, avg(avg_sales) AS a FROM sa GROUP BY 1) ps ON p2.store_id = ps.store
      LEFT JOIN (SELECT store_type, avg(avg_sales) AS a FROM sa GROUP BY 1) pt ON p2.store_type = pt.store_type
      CROSS JOIN (SELECT avg(avg_sales) AS a FROM sa) g) p2
"""


@register("sales_estimates", f"WITH {STORE_CLEAN_SQL.strip()}, {AVGS_SQL.strip()}, "
          "sa AS (SELECT s.*, a.avg_sales FROM store_c s LEFT JOIN avgs a ON s.store = a.store), "
          f"{_parse_sql(False)} {EST_SQL}", views=("store_sales", "store", "store_requests"))
def q_estimates(spark, sf):
    """R12 + J10 + R14: rule estimate of a day's sales per request (no jitter)."""
    sa = S.store_averages(_sales(spark, sf), _store(spark, sf))
    parsed = S.parse_store_request(VIEWS["store_requests"](spark, sf))
    e = S.estimate_sales(parsed, sa)
    return e.select("request_id", "store_id", "store_type", py_round("base", 4).alias("base"),
                    py_round("estimate", 4).alias("estimate"))


@register("sales_estimates_baseline", f"WITH {STORE_CLEAN_SQL.strip()}, {AVGS_SQL.strip()}, "
          "sa AS (SELECT s.*, a.avg_sales FROM store_c s LEFT JOIN avgs a ON s.store = a.store), "
          f"{_parse_sql(True)}" + """
SELECT p2.request_id, p2.store_id, p2.date, round(CASE WHEN p2.store_id IS NOT NULL THEN coalesce(ps.a, g.a)
  ELSE g.a * (CASE store_type WHEN 'a' THEN 1.1 WHEN 'b' THEN 1.0 WHEN 'c' THEN 0.9 WHEN 'd' THEN 1.2 ELSE 1.0 END)
       * (CASE WHEN has_promo THEN 1.15 ELSE 1.0 END)
       * coalesce(([1.0, 0.95, 0.9, 0.85, 1.1, 1.3, 0.5])[day_of_week + 1], 1.0) END, 4) AS estimate
FROM p2 LEFT JOIN (SELECT store, avg(avg_sales) AS a FROM sa GROUP BY 1) ps ON p2.store_id = ps.store
CROSS JOIN (SELECT avg(avg_sales) AS a FROM sa) g
""", views=("store_sales", "store", "store_requests"))
def q_estimates_baseline(spark, sf):
    """R13 + R15: three date formats, 'type: x', baseline estimator."""
    sa = S.store_averages(_sales(spark, sf), _store(spark, sf))
    parsed = S.parse_store_request(VIEWS["store_requests"](spark, sf), all_formats=True)
    e = S.estimate_sales_baseline(parsed, sa)
    return e.select("request_id", "store_id", "date", py_round("estimate", 4).alias("estimate"))


@register("ar1_forecast", """
WITH l AS (SELECT store, date, sales AS y, lag(sales) OVER (PARTITION BY store ORDER BY date) AS y1 FROM store_sales),
a AS (SELECT store, sum(y * y1) AS sxy, sum(y1 * y1) AS sxx, count(y1) AS n_pairs, arg_max(y, date) AS last_value,
             max(date) AS last_date FROM l GROUP BY 1)
SELECT store, n_pairs, last_date, last_value, round(sxy / sxx, 6) AS phi, round(sxy / sxx * last_value, 2) AS forecast FROM a
""", views=("store_sales",))
def q_ar1(spark, sf):
    """Per-store AR(1) coefficient and one-step forecast."""
    a = TS.ar1_forecast(_sales(spark, sf), "store", "date", "sales", 1)
    return a.select("store", "n_pairs", "last_date", "last_value", py_round("phi", 6).alias("phi"),
                    py_round("forecast", 2).alias("forecast"))
