"""Segmentation queries with exact oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.exprs import py_round, py_round_sql
from storelens.operators import clean as C
from storelens.operators import features as FE
from storelens.operators import rfm as R
from storelens.operators import segments as SG
from storelens.plans.catalog import ORACLES, register
from storelens.plans.retail import CLEAN_SQL, ENTRY_CUTS, NINE_SQL, clean_lines, rfm_sql, scores_sql

RFM_COLS = ["recency", "frequency", "monetary"]


def seg_base(spark, sf):
    """RFM of known customers with the notebook's 1/99 % monetary outlier cut."""
    # per-customer rows, reused by several passes (quantiles, filter, scale)
    rfm = C.drop_unknown(R.rfm(clean_lines(spark, sf)), "customer_id", -1).persist()
    return C.iqr_filter(rfm, ["monetary"], 0.01, 0.99, 1.5).persist()


def labelled(spark, sf):
    """seg_base + deterministic rule labels: r_score (0-4) and nine-way name."""
    s = R.rfm_scores(seg_base(spark, sf), **ENTRY_CUTS)
    return R.name_segments(s, "nine").withColumnRenamed("r_score", "segment_id")


BASE_SQL = f"""
WITH clean AS ({CLEAN_SQL.format(src='retail_lines_dup')}),
rfm AS ({rfm_sql()}),
known AS (SELECT * FROM rfm WHERE customer_id <> -1),
b AS (SELECT quantile_cont(monetary, 0.01) AS lo, quantile_cont(monetary, 0.99) AS hi FROM known),
base AS (SELECT known.* FROM known CROSS JOIN b WHERE monetary BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)),
sc AS ({scores_sql('base', **ENTRY_CUTS)}),
lab AS (SELECT * EXCLUDE (r_score), r_score AS segment_id, {NINE_SQL} AS segment FROM sc)
"""


def _scale_sql() -> str:
    parts = []
    for c in RFM_COLS:
        parts.append(f"quantile_cont({c}, 0.5) AS {c}_c, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i")
    st = "st AS (SELECT " + ", ".join(parts) + " FROM base)"
    cols = ", ".join(f"({c} - {c}_c) / CASE WHEN {c}_i = 0 THEN 1.0 ELSE {c}_i END AS {c}_scaled" for c in RFM_COLS)
    return f", {st} SELECT customer_id, {', '.join(RFM_COLS)}, {cols} FROM base CROSS JOIN st"


@register("robust_scaled_rfm", BASE_SQL.rstrip() + _scale_sql(), views=("retail_lines_dup",))
def q_scaled(spark, sf):
    """P16 + P14 + M1: known customers, 1/99 % monetary cut, exact robust scaling."""
    out, _ = FE.robust_scale(seg_base(spark, sf), RFM_COLS)
    return out.select("customer_id", *RFM_COLS, *[f"{c}_scaled" for c in RFM_COLS])


def _profile_sql(label: str) -> str:
    r = lambda x: py_round_sql(x, 2)
    return f"""
SELECT {label}, count(recency) AS recency_count,
  {r('avg(recency)')} AS recency_mean, {r('avg(frequency)')} AS frequency_mean,
  {r('CAST(min(frequency) AS DOUBLE)')} AS frequency_min, {r('CAST(max(frequency) AS DOUBLE)')} AS frequency_max,
  {r('CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE) / count(monetary)')} AS monetary_mean,
  {r('CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE)')} AS monetary_sum,
  {r('min(monetary)')} AS monetary_min, {r('max(monetary)')} AS monetary_max,
  {r('quantile_cont(recency, 0.5)')} AS recency_median, {r('quantile_cont(frequency, 0.5)')} AS frequency_median,
  {r('quantile_cont(monetary, 0.5)')} AS monetary_median
FROM lab GROUP BY {label}
"""


@register("cluster_profile", BASE_SQL + _profile_sql("segment"), views=("retail_lines_dup",))
def q_profile(spark, sf):
    """Multi-aggregate profile per segment, numpy-style 2-decimal rounding."""
    return SG.cluster_profile(labelled(spark, sf), "segment")


STATS_SQL = """
, st AS (SELECT segment_id, count(*) AS count, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE) / count(monetary) AS avg_monetary,
       CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE) AS total_monetary,
       stddev_samp(recency) AS std_recency, stddev_samp(frequency) AS std_frequency, stddev_samp(monetary) AS std_monetary,
       CAST(min(recency) AS DOUBLE) AS min_recency, CAST(min(frequency) AS DOUBLE) AS min_frequency, min(monetary) AS min_monetary,
       CAST(max(recency) AS DOUBLE) AS max_recency, CAST(max(frequency) AS DOUBLE) AS max_frequency, max(monetary) AS max_monetary
     FROM lab GROUP BY segment_id),
stp AS (SELECT *, count / sum(count) OVER () * 100 AS percentage FROM st)
"""


@register("segment_stats", BASE_SQL.rstrip() + STATS_SQL + """
SELECT segment_id, count, avg_recency, avg_frequency, avg_monetary, total_monetary,
       round(std_recency, 6) AS std_recency, round(std_frequency, 6) AS std_frequency,
       round(std_monetary, 2) AS std_monetary, min_recency, min_frequency, min_monetary,
       max_recency, max_frequency, max_monetary, percentage FROM stp
""", views=("retail_lines_dup",))
def q_stats(spark, sf):
    """A22 + A24: per-segment statistics and share (segment = recency score)."""
    st = SG.segment_stats(labelled(spark, sf), "segment_id")
    return st.withColumns({"std_recency": py_round("std_recency", 6), "std_frequency": py_round("std_frequency", 6),
                           "std_monetary": py_round("std_monetary", 2)})


@register("radar_profile", BASE_SQL.rstrip() + """
, mx AS (SELECT CAST(max(recency) AS DOUBLE) AS mr, CAST(max(frequency) AS DOUBLE) AS mf, max(monetary) AS mm FROM lab),
a AS (SELECT segment, avg(recency) AS recency, avg(frequency) AS frequency,
             CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE) / count(monetary) AS monetary FROM lab GROUP BY 1)
SELECT segment, recency, frequency, monetary, 1.0 - recency / mr AS recency_norm, frequency / mf AS frequency_norm,
       monetary / mm AS monetary_norm FROM a CROSS JOIN mx
""", views=("retail_lines_dup",))
def q_radar(spark, sf):
    """Normalised per-segment profile against global maxima."""
    return SG.radar_profile(labelled(spark, sf), "segment")


def _interpret_sql() -> str:
    r = lambda x: py_round_sql(x, 2)
    sc = scores_sql("pr", **ENTRY_CUTS, r="recency_mean", f="frequency_mean", m="monetary_mean")
    names = "CASE " + " ".join(
        f"WHEN {cond} THEN {i}" for i, cond in enumerate([
            "r_score >= 4 AND f_score >= 4 AND m_score >= 4", "r_score >= 4 AND f_score >= 3 AND m_score >= 3",
            "r_score >= 3 AND f_score >= 1 AND m_score >= 4", "r_score >= 4 AND f_score <= 2 AND m_score <= 2",
            "r_score <= 2 AND f_score >= 4 AND m_score >= 4", "r_score <= 2 AND f_score >= 3",
            "r_score <= 2 AND f_score <= 2 AND m_score <= 2", "r_score <= 3 AND f_score <= 3 AND m_score >= 4"],
            start=1)) + f" ELSE {len(R.NINE_SEGMENTS)} END"
    lists = {k: "[" + ", ".join("'" + s[k].replace("'", "''") + "'" for s in R.NINE_SEGMENTS) + "]" for k in range(3)}
    return f"""
, pr AS (SELECT segment_id, count(recency) AS recency_count, {r('avg(recency)')} AS recency_mean,
         {r('avg(frequency)')} AS frequency_mean,
         {r('CAST(sum(CAST(monetary AS DECIMAL(38,6))) AS DOUBLE) / count(monetary)')} AS monetary_mean FROM lab GROUP BY 1),
s AS ({sc}), n AS (SELECT *, {names} AS k FROM s)
SELECT segment_id, recency_count AS cluster_size, recency_count / sum(recency_count) OVER () AS size_fraction,
       recency_mean, frequency_mean, monetary_mean, rfm_score,
       {lists[0]}[k] AS segment, {lists[1]}[k] AS description, {lists[2]}[k] AS strategy
FROM n
"""


@register("interpret_clusters", BASE_SQL.rstrip() + _interpret_sql(), views=("retail_lines_dup",))
def q_interpret(spark, sf):
    """R2: nine-way business names per cluster from its rounded means."""
    prof = SG.cluster_profile(labelled(spark, sf), "segment_id")
    return SG.interpret_clusters(prof, "segment_id", **ENTRY_CUTS)


@register("rfm_names_ranked", BASE_SQL.rstrip() + STATS_SQL + f"""
, s AS ({scores_sql('stp', **ENTRY_CUTS, r='avg_recency', f='avg_frequency', m='avg_monetary')})
SELECT segment_id, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
     WHEN r_score >= 4 AND f_score >= 3 THEN 'Loyal Customers' WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers'
     WHEN r_score <= 2 AND f_score >= 3 THEN 'At-Risk Customers' WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Lost Customers'
     WHEN m_score >= 4 AND f_score <= 2 THEN 'Big Spenders' WHEN r_score <= 2 AND m_score >= 4 THEN 'At-Risk High Value'
     ELSE 'Regular Customers' END AS segment_name,
  r_score * 100 + f_score * 10 + m_score AS rfm_rank_key,
  row_number() OVER (ORDER BY r_score * 100 + f_score * 10 + m_score DESC, segment_id) AS name_rank
FROM s
""", views=("retail_lines_dup",))
def q_names(spark, sf):
    """R3 + W6: eight-way names from unrounded averages, ranked by the RFM key."""
    st = SG.segment_stats(labelled(spark, sf), "segment_id")
    return SG.rfm_names(st, "segment_id", **ENTRY_CUTS).select("segment_id", "segment_name", "rfm_rank_key", "name_rank")


def _fmt_sql(x: str, d: int) -> str:
    # prints the exact binary value, as the reference's format does
    return f"printf('%.{d}f', CAST({x} AS DOUBLE))"


@register("segment_insights", BASE_SQL.rstrip() + STATS_SQL + f"""
, b0 AS (SELECT avg_recency AS r0, avg_frequency AS f0 FROM stp WHERE segment_id = 0)
SELECT segment_id,
  'Cluster ' || CAST(segment_id AS VARCHAR) || ': This segment contains ' || CAST(count AS VARCHAR) || ' customers ('
  || {_fmt_sql('percentage', 1)} || '% of total). On average, they made their last purchase ' || {_fmt_sql('avg_recency', 1)}
  || ' days ago, have made ' || {_fmt_sql('avg_frequency', 1)} || ' purchases, and spent $' || {_fmt_sql('avg_monetary', 2)}
  || ' per customer.' AS description,
  CASE WHEN avg_recency < r0 AND avg_frequency > f0 THEN '{SG.STRATEGY_BEST.replace("'", "''")}'
       WHEN avg_recency > r0 AND avg_frequency > f0 THEN '{SG.STRATEGY_WINBACK.replace("'", "''")}'
       WHEN avg_recency < r0 AND avg_frequency < f0 THEN '{SG.STRATEGY_NEW.replace("'", "''")}'
       ELSE '{SG.STRATEGY_DEFAULT.replace("'", "''")}' END AS strategy
FROM stp LEFT JOIN b0 ON true
""", views=("retail_lines_dup",))
def q_insights(spark, sf):
    """Fallback description and strategy against segment 0."""
    st = SG.segment_stats(labelled(spark, sf), "segment_id")
    return SG.segment_insights(st, "segment_id", 0).select("segment_id", "description", "strategy")


@register("report_prompts", "SELECT segment_id, description, strategy, 2 AS n_messages FROM (" + ORACLES["segment_insights"] + ")")
def q_report_prompts(spark, sf):
    """The report's messages, read back: every segment's texts from the JSON in them."""
    st = SG.segment_insights(SG.segment_stats(labelled(spark, sf), "segment_id"), "segment_id", 0)
    m = SG.report_prompts(st.select("segment_id", "count", "percentage", "avg_recency", "avg_frequency", "avg_monetary",
                                    "description", "strategy"))
    user = F.col("messages")[1]["content"]
    texts = F.from_json(F.substring_index(F.substring_index(user, "\n\nDescriptions:\n", -1), "\n\nStrategies:\n", 1),
                        "map<string,string>")
    plans = F.from_json(F.substring_index(user, "\n\nStrategies:\n", -1), "map<string,string>")
    read = m.select(F.size("messages").alias("n_messages"), F.explode(texts).alias("k", "description"), plans.alias("plans"))
    return read.select(F.col("k").cast("int").alias("segment_id"), "description", F.col("plans")[F.col("k")].alias("strategy"),
                       "n_messages")
