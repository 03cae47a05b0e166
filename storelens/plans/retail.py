"""Retail queries: cleaning, RFM, scores, segments, cohorts, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import clean as C
from storelens.operators import cohort as CO
from storelens.operators import profile as PR
from storelens.operators import rfm as R
from storelens.plans.catalog import register
from storelens.sources.fixtures import VIEWS

# Cut points for the entry query.  Driver amounts are in the thousands per
# line, so the reference cuts (60 days / 5 lines / 200) put every customer in
# m = 5; these scaled cuts spread the scores over the driver data.
ENTRY_CUTS = dict(r_cut=60, f_cut=12, m_cut=650000)
ENTRY_AS_OF = None


def clean_lines(spark, sf_dir, view="retail_lines_dup"):
    return C.clean_retail(VIEWS[view](spark, sf_dir))


# ---- SQL fragments shared by the oracles --------------------------------

CLEAN_SQL = """
SELECT DISTINCT invoice, stock_code, coalesce(description, 'Unknown Item') AS description,
       quantity, invoice_date, price, amount, coalesce(customer_id, -1) AS customer_id, country,
       CAST(year(invoice_date) AS INTEGER) AS year, CAST(month(invoice_date) AS INTEGER) AS month,
       CAST(day(invoice_date) AS INTEGER) AS day, CAST(weekofyear(invoice_date) AS INTEGER) AS week,
       CAST(isodow(invoice_date) - 1 AS INTEGER) AS day_of_week,
       quantity * price AS total_amount
FROM {src} WHERE quantity > 0 AND price > 0
"""


def rfm_sql(src: str = "clean", as_of: str | None = None) -> str:
    ref = (f"(SELECT max(invoice_date) AS asof FROM {src})" if as_of is None
           else f"(SELECT TIMESTAMP '{as_of}' AS asof)")
    return f"""
SELECT customer_id,
       CAST(floor((epoch(a.asof) - epoch(max(invoice_date))) / 86400) AS INTEGER) AS recency,
       CAST(count(invoice) AS BIGINT) AS frequency,
       CAST(sum(CAST(total_amount AS DECIMAL(38,6))) AS DOUBLE) AS monetary
FROM {src} CROSS JOIN {ref} a
GROUP BY customer_id, a.asof
"""


def scores_sql(src: str, r_cut=60, f_cut=5, m_cut=200, r="recency", f="frequency", m="monetary") -> str:
    return f"""
SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score
FROM (SELECT *,
        5 - least(CAST(trunc({r} / {float(r_cut)}) AS INTEGER) + 1, 5) AS r_score,
        least(CAST(trunc({f} / {float(f_cut)}) AS INTEGER) + 1, 5) AS f_score,
        least(CAST(trunc({m} / {float(m_cut)}) AS INTEGER) + 1, 5) AS m_score
      FROM {src})
"""


NINE_SQL = """
CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
     WHEN r_score >= 4 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers'
     WHEN r_score >= 3 AND f_score >= 1 AND m_score >= 4 THEN 'Big Spenders'
     WHEN r_score >= 4 AND f_score <= 2 AND m_score <= 2 THEN 'New Customers'
     WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'At Risk Champions'
     WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk Customers'
     WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Lost Customers'
     WHEN r_score <= 3 AND f_score <= 3 AND m_score >= 4 THEN 'One-Time Big Spenders'
     ELSE 'Standard Customers' END
"""

EIGHT_SQL = """
CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
     WHEN r_score >= 4 AND f_score >= 3 THEN 'Loyal Customers'
     WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers'
     WHEN r_score <= 2 AND f_score >= 3 THEN 'At-Risk Customers'
     WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Lost Customers'
     WHEN m_score >= 4 AND f_score <= 2 THEN 'Big Spenders'
     WHEN r_score <= 2 AND m_score >= 4 THEN 'At-Risk High Value'
     ELSE 'Regular Customers' END
"""


def _with_clean(body: str, src: str = "retail_lines_dup") -> str:
    return f"WITH clean AS ({CLEAN_SQL.format(src=src)})\n{body}"


# ---- queries -----------------------------------------------------------

def segment_summary(spark, sf_dir):
    """Flagship: clean -> RFM -> scores -> nine-way names -> per-segment totals."""
    lines = clean_lines(spark, sf_dir)
    named = R.name_segments(R.rfm_scores(R.rfm(lines), **ENTRY_CUTS), "nine")
    return named.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("monetary").cast("decimal(38,6)")).cast("double").alias("revenue"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.min("rfm_score").alias("min_rfm_score"),
        F.max("rfm_score").alias("max_rfm_score"))


register("segment_summary", _with_clean(f"""
, rfm AS ({rfm_sql()}), sc AS ({scores_sql('rfm', **ENTRY_CUTS)})
SELECT {NINE_SQL} AS segment, count(*) AS customers,
       CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE) AS revenue,
       avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       min(rfm_score) AS min_rfm_score, max(rfm_score) AS max_rfm_score
FROM sc GROUP BY 1
"""), views=("retail_lines_dup",))(segment_summary)


@register("clean_retail", _with_clean("SELECT * FROM clean"), views=("retail_lines_dup",))
def q_clean_retail(spark, sf_dir):
    """Reference cleaning of duplicated invoice lines."""
    return clean_lines(spark, sf_dir)


@register("rfm_table", _with_clean(f", rfm AS ({rfm_sql()}) SELECT * FROM rfm"),
          views=("retail_lines_dup",))
def q_rfm(spark, sf_dir):
    """RFM per customer over all countries (unknown customer = -1 kept)."""
    return R.rfm(clean_lines(spark, sf_dir))


@register("rfm_by_country", _with_clean("""
, per AS (SELECT country, customer_id, max(invoice_date) AS last_ts, CAST(count(invoice) AS BIGINT) AS frequency,
                 CAST(sum(CAST(total_amount AS DECIMAL(38,6))) AS DOUBLE) AS monetary FROM clean GROUP BY 1, 2),
refs AS (SELECT country, max(last_ts) AS as_of_ts FROM per GROUP BY 1)
SELECT per.country, customer_id, CAST(floor((epoch(as_of_ts) - epoch(last_ts)) / 86400) AS INTEGER) AS recency,
       frequency, monetary
FROM per JOIN refs USING (country)
"""), views=("retail_lines_dup",))
def q_rfm_by_country(spark, sf_dir):
    """A7 + P7: the one-country RFM of the reference for every country, each
    country's latest purchase as its as-of."""
    return R.rfm(clean_lines(spark, sf_dir), by=["country"])


EVENTS_AS_OF = "2024-01-31 06:00:00"


@register("rfm_events_asof", f"""
WITH rfm AS ({rfm_sql('event_purchases', EVENTS_AS_OF).replace('total_amount', 'amount')})
SELECT * FROM rfm""", views=("event_purchases",))
def q_rfm_events(spark, sf_dir):
    """A7 with an explicit mid-day as-of: floor of whole 24 h periods."""
    ev = VIEWS["event_purchases"](spark, sf_dir)
    return R.rfm(ev, amount="amount", as_of=EVENTS_AS_OF)


@register("rfm_scores_eight", _with_clean(
    f", rfm AS ({rfm_sql()}), sc AS ({scores_sql('rfm')}) "
    f"SELECT *, {EIGHT_SQL} AS segment, r_score * 100 + f_score * 10 + m_score AS rfm_rank_key FROM sc"),
    views=("retail_lines_dup",))
def q_rfm_scores(spark, sf_dir):
    """R1 + R3 with the reference cut points (60 / 5 / 200)."""
    return R.name_segments(R.rfm_scores(R.rfm(clean_lines(spark, sf_dir))), "eight")


@register("rfm_segments_nine", _with_clean(
    f", rfm AS ({rfm_sql()}), sc AS ({scores_sql('rfm', **ENTRY_CUTS)}) "
    f"SELECT customer_id, rfm_score, {NINE_SQL} AS segment FROM sc"), views=("retail_lines_dup",))
def q_rfm_nine(spark, sf_dir):
    """R1 + R2 per customer with the entry cut points."""
    named = R.name_segments(R.rfm_scores(R.rfm(clean_lines(spark, sf_dir)), **ENTRY_CUTS), "nine")
    return named.select("customer_id", "rfm_score", "segment")


# ---- cohorts -------------------------------------------------------------

COHORT_SQL = """
, cm AS (SELECT customer_id, CAST(date_trunc('month', invoice_date) AS DATE) AS order_month,
                sum(CAST(total_amount AS DECIMAL(38,6))) AS revenue
         FROM clean GROUP BY 1, 2),
f AS (SELECT *, min(order_month) OVER (PARTITION BY customer_id) AS cohort_month FROM cm),
cells AS (SELECT cohort_month,
                 CAST((year(order_month) - year(cohort_month)) * 12 + month(order_month) - month(cohort_month) AS INTEGER) AS cohort_index,
                 count(*) AS active, sum(revenue) AS revenue
          FROM f GROUP BY 1, 2),
ct AS (SELECT c.cohort_month, c.cohort_index, c.active, s.active AS cohort_size,
              round(c.active / s.active * 100, 6) AS retention_pct,
              CAST(c.revenue AS DOUBLE) AS revenue,
              round(CAST(c.revenue AS DOUBLE) / c.active, 6) AS rev_per_active,
              round(sum(CAST(c.revenue AS DOUBLE) / c.active) OVER (PARTITION BY c.cohort_month ORDER BY c.cohort_index
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS clv
       FROM cells c JOIN cells s ON c.cohort_month = s.cohort_month AND s.cohort_index = 0)
"""


@register("cohort_table", _with_clean(COHORT_SQL + "SELECT * FROM ct"), views=("retail_lines_dup",))
def q_cohorts(spark, sf_dir):
    """Long cohort table with retention and CLV."""
    return CO.cohorts(clean_lines(spark, sf_dir))


_COUNTRY_COHORT_SQL = (COHORT_SQL.replace("SELECT customer_id, CAST(date_trunc", "SELECT country, customer_id, CAST(date_trunc")
                       .replace("FROM clean GROUP BY 1, 2)", "FROM clean GROUP BY 1, 2, 3)")
                       .replace("PARTITION BY customer_id", "PARTITION BY country, customer_id")
                       .replace("cells AS (SELECT cohort_month", "cells AS (SELECT country, cohort_month")
                       .replace("FROM f GROUP BY 1, 2)", "FROM f GROUP BY 1, 2, 3)")
                       .replace("ct AS (SELECT c.cohort_month", "ct AS (SELECT c.country, c.cohort_month")
                       .replace("PARTITION BY c.cohort_month", "PARTITION BY c.country, c.cohort_month")
                       .replace("ON c.cohort_month", "ON c.country = s.country AND c.cohort_month"))


@register("cohorts_by_country", _with_clean(_COUNTRY_COHORT_SQL + "SELECT * FROM ct"), views=("retail_lines_dup",))
def q_country_cohorts(spark, sf_dir):
    """Every country's own cohort table."""
    return CO.cohorts(clean_lines(spark, sf_dir), by=["country"])


@register("retention_curve", _with_clean(
    COHORT_SQL + "SELECT cohort_index, round(avg(retention_pct), 4) AS avg_retention_pct, "
    "count(*) AS cohorts FROM ct GROUP BY 1"), views=("retail_lines_dup",))
def q_retention(spark, sf_dir):
    """Mean retention per cohort index, missing cells skipped."""
    return CO.retention_curve(CO.cohorts(clean_lines(spark, sf_dir)))


# Fixed value: the orders span seven years, so a cohort has at most 84 months.
WIDE_MONTHS = range(84)


@register("retention_wide", _with_clean(
    COHORT_SQL + "SELECT cohort_month, "
    + ", ".join(f"max(CASE WHEN cohort_index = {i} THEN retention_pct END) AS m{i}" for i in WIDE_MONTHS)
    + " FROM ct GROUP BY 1"), views=("retail_lines_dup",))
def q_retention_wide(spark, sf_dir):
    """The heat map's matrix, a row for each cohort and a column for each month of its age."""
    wide = CO.to_wide(CO.cohorts(clean_lines(spark, sf_dir)), "cohort_month", "cohort_index", "retention_pct",
                      list(WIDE_MONTHS))
    return wide.select("cohort_month", *[F.col(str(i)).alias(f"m{i}") for i in WIDE_MONTHS])


@register("clv_curve", _with_clean(
    COHORT_SQL + "SELECT cohort_index, round(avg(clv), 4) AS avg_clv, count(*) AS cohorts FROM ct GROUP BY 1"),
    views=("retail_lines_dup",))
def q_clv(spark, sf_dir):
    """Mean cumulative revenue per active customer by cohort age."""
    return CO.clv_curve(CO.cohorts(clean_lines(spark, sf_dir)))


# ---- top lists -------------------------------------------------------------

@register("top_products", _with_clean(
    "SELECT stock_code, count(*) AS lines FROM clean GROUP BY 1 ORDER BY lines DESC, stock_code LIMIT 10"),
    views=("retail_lines_dup",))
def q_top_products(spark, sf_dir):
    """Ten most frequent stock codes (line counts), key tie-break."""
    return PR.top_counts(clean_lines(spark, sf_dir), "stock_code", 10, name="lines")


@register("top_countries", _with_clean(
    "SELECT country, CAST(sum(CAST(total_amount AS DECIMAL(38,6))) AS DOUBLE) AS revenue FROM clean "
    "GROUP BY 1 ORDER BY revenue DESC, country LIMIT 10"), views=("retail_lines_dup",))
def q_top_countries(spark, sf_dir):
    """Ten countries by revenue."""
    return PR.top_sums(clean_lines(spark, sf_dir), "country", "total_amount", 10, name="revenue")


@register("top_customers_value", _with_clean(
    "SELECT customer_id, count(*) AS lines FROM clean GROUP BY 1 ORDER BY lines DESC, customer_id LIMIT 10"),
    views=("retail_lines_dup",))
def q_top_customers(spark, sf_dir):
    """A14 on customers: the reference's 'top customers' chart counts lines."""
    return PR.top_counts(clean_lines(spark, sf_dir), "customer_id", 10, name="lines")
