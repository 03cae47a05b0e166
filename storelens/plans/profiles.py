"""Profile and chart-data queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from storelens.functions.exprs import exact_mean, py_round

from storelens.operators import clean as C
from storelens.operators import profile as PR
from storelens.operators import rfm as R
from storelens.plans.catalog import register
from storelens.plans.retail import CLEAN_SQL, clean_lines, rfm_sql
from storelens.sources.fixtures import VIEWS, table
from storelens.sources.io import SYNTH_GROUPS, draw_rfm

RL_COLS = ["invoice", "stock_code", "description", "quantity", "invoice_date", "price",
           "amount", "customer_id", "country"]
RL_DOUBLE = {"price", "amount"}
RFM_SQL_CTE = f"WITH clean AS ({CLEAN_SQL.format(src='retail_lines_dup')}), rfm AS ({rfm_sql()})\n"


def _null_sql() -> str:
    parts = []
    for c in RL_COLS:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in RL_DOUBLE else "")
        parts.append(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {cond}) AS nulls FROM retail_lines")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE nulls > 0"


@register("null_profile", _null_sql(), views=("retail_lines",))
def q_null_profile(spark, sf_dir):
    """NULL count per column of the raw invoice lines, non-zero only."""
    return PR.null_profile(VIEWS["retail_lines"](spark, sf_dir))


def _distinct_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM retail_lines" for c in RL_COLS]
    return " UNION ALL ".join(parts)


@register("distinct_profile", _distinct_sql(), views=("retail_lines",))
def q_distinct_profile(spark, sf_dir):
    """Exact distinct non-NULL values per column."""
    return PR.distinct_profile(VIEWS["retail_lines"](spark, sf_dir))


def _describe_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 2) AS std, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50, "
            f"CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {src}")
    return " UNION ALL ".join(parts)


RFM_COLS = ["recency", "frequency", "monetary"]


@register("describe_rfm", RFM_SQL_CTE + _describe_sql("rfm", RFM_COLS), views=("retail_lines_dup",))
def q_describe(spark, sf_dir):
    """describe() of the RFM table with exact linear quartiles."""
    d = PR.describe(R.rfm(clean_lines(spark, sf_dir)).persist(), RFM_COLS)
    return d.select("column", "count", py_round("mean", 4).alias("mean"), py_round("std", 2).alias("std"),
                    "min", "p25", "p50", "p75", "max")


_TYPE_SQL = ("CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' "
             "WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
             "ELSE lower(typeof({c})) END")


def _schema_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", count({c}) AS non_null, "
             f"(SELECT {_TYPE_SQL.format(c=c)} FROM retail_lines LIMIT 1) AS dtype FROM retail_lines"
             for c in RL_COLS]
    return " UNION ALL ".join(parts)


@register("schema_profile", _schema_sql(), views=("retail_lines",))
def q_schema_profile(spark, sf_dir):
    """Type and non-null count per column (info())."""
    return PR.schema_profile(VIEWS["retail_lines"](spark, sf_dir))


CORR_COLS = ["sales", "customers", "promo"]


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(
                f"SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 "
                f"THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END, 6) AS corr FROM store_sales")
    return " UNION ALL ".join(parts)


@register("corr_matrix", _corr_sql(), views=("store_sales",))
def q_corr(spark, sf_dir):
    """Pearson matrix of store sales features (zero variance -> NULL)."""
    out = PR.corr_matrix(VIEWS["store_sales"](spark, sf_dir), CORR_COLS)
    return out.select("x", "y", py_round("corr", 6).alias("corr"))


def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""
, d AS (SELECT CAST({col} AS DOUBLE) AS v FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
r AS (SELECT min(v) AS mn, max(v) AS mx FROM d),
c AS (SELECT least(CAST(floor(coalesce((v - mn) / nullif(mx - mn, 0), 0.0) * {bins}) AS INTEGER), {bins - 1}) + 1 AS bin,
             count(*) AS count FROM d CROSS JOIN r GROUP BY 1),
s AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1}))
SELECT s.bin, r.mn + (r.mx - r.mn) / {bins} * (s.bin - 1) AS lo, r.mn + (r.mx - r.mn) / {bins} * s.bin AS hi,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin
"""


@register("histogram_monetary", RFM_SQL_CTE.rstrip() + _hist_sql("rfm", "monetary", 30),
          views=("retail_lines_dup",))
def q_hist(spark, sf_dir):
    """30-bin histogram of customer monetary value, empty bins kept."""
    return PR.histogram(R.rfm(clean_lines(spark, sf_dir)).persist(), "monetary", 30)


@register("histogram_log_sales", "WITH x AS (SELECT ln(1 + sales) AS log_sales FROM store_sales)"
          + _hist_sql("x", "log_sales", 50), views=("store_sales",))
def q_hist_log(spark, sf_dir):
    """P12 + A26: 50-bin histogram of log1p(sales)."""
    ss = VIEWS["store_sales"](spark, sf_dir).select(F.log1p("sales").alias("log_sales"))
    return PR.histogram(ss, "log_sales", 50)


@register("scatter_rfm", RFM_SQL_CTE.rstrip() + """
, d AS (SELECT CAST(recency AS DOUBLE) AS x, CAST(monetary AS DOUBLE) AS y FROM rfm WHERE recency IS NOT NULL AND monetary IS NOT NULL),
r AS (SELECT min(x) xmn, max(x) xmx, min(y) ymn, max(y) ymx FROM d)
SELECT least(CAST(floor(coalesce((x - xmn) / nullif(xmx - xmn, 0), 0.0) * 20) AS INTEGER), 19) + 1 AS bx,
       least(CAST(floor(coalesce((y - ymn) / nullif(ymx - ymn, 0), 0.0) * 20) AS INTEGER), 19) + 1 AS "by",
       count(*) AS count
FROM d CROSS JOIN r GROUP BY 1, 2
""", views=("retail_lines_dup",))
def q_scatter(spark, sf_dir):
    """20x20 binned recency x monetary scatter."""
    return PR.scatter_bins(R.rfm(clean_lines(spark, sf_dir)).persist(), "recency", "monetary", 20, 20)


@register("null_patterns", "SELECT " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in RL_COLS) + ", count(*) AS rows FROM retail_lines GROUP BY ALL",
    views=("retail_lines",))
def q_null_patterns(spark, sf_dir):
    """Rows per NULL pattern (bounded form of the null heat map)."""
    return PR.null_patterns(VIEWS["retail_lines"](spark, sf_dir))


@register("group_counts_weekday", f"WITH clean AS ({CLEAN_SQL.format(src='retail_lines_dup')}) "
          "SELECT country, day_of_week, count(*) AS count FROM clean GROUP BY 1, 2", views=("retail_lines_dup",))
def q_group_counts(spark, sf_dir):
    """Line counts by country and weekday (Monday = 0)."""
    return PR.group_counts(clean_lines(spark, sf_dir), ["country", "day_of_week"])


@register("box_sales_by_type", """
WITH j AS (SELECT s.store_type, CAST(x.sales AS DOUBLE) AS v FROM store_sales x JOIN store s ON x.store = s.store),
q AS (SELECT store_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3, count(*) AS n FROM j GROUP BY 1)
SELECT q.store_type, q.q1, q.median, q.q3, q.n,
       min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
       max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (WHERE NOT (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM j JOIN q USING (store_type) GROUP BY q.store_type, q.q1, q.median, q.q3, q.n
""", views=("store_sales", "store"))
def q_box(spark, sf_dir):
    """Box-plot numbers of daily sales per store type."""
    ss = VIEWS["store_sales"](spark, sf_dir)
    st = VIEWS["store"](spark, sf_dir).select("store", "store_type")
    return PR.box_stats(ss.join(st, "store"), "store_type", "sales")


@register("mean_sales_by_promo", "SELECT promo, round(avg(sales), 4) AS mean, count(sales) AS n "
          "FROM store_sales GROUP BY 1", views=("store_sales",))
def q_mean_ci(spark, sf_dir):
    """Mean per group behind the bar charts."""
    out = PR.mean_ci(VIEWS["store_sales"](spark, sf_dir), "promo", "sales")
    return out.select("promo", py_round("mean", 4).alias("mean"), "n")


N_BOOT = 200
_BOOT_KEY = "store * 100000 + CAST(date - DATE '1990-01-01' AS BIGINT)"


def _boot_sql() -> str:
    a, b, c, d = PR.HASH_FACTORS
    u, top = "UBIGINT", 1 << 32
    steps = " + ".join(f"CAST(h >= {t} AS BIGINT)" for t in PR.poisson_thresholds())
    return f"""
WITH rows AS (SELECT promo, CAST(({_BOOT_KEY}) % {top} AS {u}) AS k, CAST(round_even(sales * 1000000.0, 0) AS HUGEINT) AS x FROM store_sales),
reps AS (SELECT CAST(unnest(range(1, {N_BOOT} + 1)) AS {u}) AS r),
h0 AS (SELECT promo, r, x, (k * CAST({a} AS {u}) + r * CAST({b} AS {u})) % {top} AS h FROM rows, reps),
h1 AS (SELECT promo, r, x, CAST(xor(h, h >> 15) * CAST({c} AS {u}) % {top} AS {u}) AS h FROM h0),
h2 AS (SELECT promo, r, x, CAST(xor(h, h >> 13) * CAST({d} AS {u}) % {top} AS {u}) AS h FROM h1),
h3 AS (SELECT promo, r, x, xor(h, h >> 16) AS h FROM h2),
w AS (SELECT promo, r, x, {steps} AS w FROM h3),
m AS (SELECT promo, CAST(sum(w * x) AS DOUBLE) / 1000000.0 / nullif(CAST(sum(w) AS DOUBLE), 0) AS m FROM w GROUP BY promo, r),
ci AS (SELECT promo, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)
SELECT promo, round(avg(sales), 4) AS mean, count(sales) AS n, round(any_value(lo), 6) AS ci_lo, round(any_value(hi), 6) AS ci_hi
FROM store_sales JOIN ci USING (promo) GROUP BY promo
"""


@register("bootstrap_sales_by_promo", _boot_sql(), views=("store_sales",))
def q_bootstrap(spark, sf_dir):
    """Means behind the bar charts with their bootstrap intervals."""
    key = F.col("store") * 100000 + F.datediff(F.col("date"), F.lit("1990-01-01").cast("date"))
    out = PR.mean_ci(VIEWS["store_sales"](spark, sf_dir), "promo", "sales", N_BOOT, key)
    return out.select("promo", py_round("mean", 4).alias("mean"), "n", py_round("ci_lo", 6).alias("ci_lo"),
                      py_round("ci_hi", 6).alias("ci_hi"))


@register("dataset_profile", """
SELECT count(*) AS rows, 3 AS columns, count(price) AS count, min(price) AS min, max(price) AS max,
       round(avg(price), 6) AS mean, quantile_cont(price, 0.5) AS median FROM item_texts
""", views=("item_texts",))
def q_dataset_profile(spark, sf_dir):
    """Global scalars of the item table."""
    st = PR.dataset_profile(VIEWS["item_texts"](spark, sf_dir), "price")["stats"]
    return st.select("rows", F.col("columns").cast("int").alias("columns"), "count", "min", "max",
                     py_round("mean", 6).alias("mean"), "median")


@register("dataset_profile_lines", """
WITH st AS (SELECT count(*) AS rows, 9 AS columns, count(price) AS count, min(price) AS min, max(price) AS max,
                   round(avg(price), 6) AS mean, quantile_cont(price, 0.5) AS median FROM retail_lines_dup),
tx AS (SELECT DISTINCT description AS name FROM retail_lines_dup WHERE description IS NOT NULL)
SELECT 'stats' AS part, unnest(['rows', 'columns', 'count', 'min', 'max', 'mean', 'median']) AS name,
       unnest([CAST(rows AS DOUBLE), CAST(columns AS DOUBLE), CAST(count AS DOUBLE), min, max, mean, median]) AS value FROM st
UNION ALL SELECT 'country', country, CAST(count(*) AS DOUBLE) FROM retail_lines_dup GROUP BY country
UNION ALL SELECT * FROM (SELECT 'sample', name, CAST(NULL AS DOUBLE) FROM tx ORDER BY md5('42:' || name), name LIMIT 5)
""", views=("retail_lines_dup",))
def q_dataset_profile_lines(spark, sf_dir):
    """A33 + P22: the invoice lines' whole profile - price scalars, lines per country and
    five sampled descriptions."""
    lines = VIEWS["retail_lines_dup"](spark, sf_dir)
    got = PR.dataset_profile(lines, "price", "country", "description")
    names = ["rows", "columns", "count", "min", "max", "mean", "median"]
    st = got["stats"].withColumn("mean", py_round("mean", 6)).select(*[F.col(c).cast("double").alias(c) for c in names])
    stats = st.unpivot([], names, "name", "value").select(F.lit("stats").alias("part"), "name", "value")
    country = got["countries"].select(F.lit("country"), F.col("country"), F.col("count").cast("double"))
    sample = got["sample"].select(F.lit("sample"), F.col("description"), F.lit(None).cast("double"))
    return stats.union(country).union(sample)


@register("sampled_lines", """
WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice FROM lineitem)
SELECT k, l_extendedprice FROM k ORDER BY md5('42:' || CAST(k AS VARCHAR)), k LIMIT 10000
""")
def q_sampled_lines(spark, sf_dir):
    """The reference's sample of up to 10,000 rows (the limit is the feature)."""
    k = (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber").cast("long")).alias("k")
    return C.stable_sample(table(spark, sf_dir, "lineitem").select(k, "l_extendedprice"), "k", 10_000, 42)


def _draw_sql(name: str, metric: int) -> str:
    u1, u2 = [f"((CAST('0x' || substr(md5('42:' || CAST(k AS VARCHAR) || ':{name}:{i}'), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496.0e0)"
              for i in (1, 2)]
    z = f"(sqrt(-2.0e0 * ln({u1})) * cos({2 * math.pi!r} * {u2}))"
    cases = " ".join(f"WHEN {i} THEN least({hi}.0e0, greatest({lo}.0e0, {mean}.0e0 + {sd}.0e0 * {z}))"
                     for i, (mean, sd, lo, hi) in enumerate(g[2 + metric] for g in SYNTH_GROUPS))
    return f"round(CASE g {cases} END, 6) AS {name}"


def _synth_sql() -> str:
    sizes = [f"CAST(floor(n * {g[1]!r}e0) AS BIGINT)" for g in SYNTH_GROUPS[:-1]]
    ends = " ".join(f"WHEN k < {' + '.join(sizes[:i + 1])} THEN {i}" for i in range(len(sizes)))
    labels = " ".join(f"WHEN {i} THEN '{g[0]}'" for i, g in enumerate(SYNTH_GROUPS))
    draws = ", ".join(_draw_sql(c, i) for i, c in enumerate(RFM_COLS))
    return f"""
WITH t AS (SELECT c_custkey, CAST(c_custkey - 1 AS BIGINT) AS k, (SELECT count(*) FROM customer) AS n FROM customer),
r AS (SELECT *, CASE {ends} ELSE {len(SYNTH_GROUPS) - 1} END AS g FROM t)
SELECT c_custkey, {draws}, CASE g {labels} END AS true_group FROM r
"""


@register("synth_rfm_customers", _synth_sql())
def q_synth(spark, sf_dir):
    """A synthetic twin of every customer, drawn by a hash of (seed, row, column)."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") - 1).cast("long").alias("k"))
    drawn = draw_rfm(customers, "k", customers.count(), 42)
    return drawn.select("c_custkey", *[py_round(c, 6).alias(c) for c in RFM_COLS], "true_group")


@register("typed_labelled_lines", """
SELECT l_orderkey, l_linenumber, TRY_CAST(l_quantity AS INTEGER) AS l_quantity, CAST(l_shipdate AS VARCHAR)[1:7] AS ship_month,
       CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'open' END AS flag_name
FROM (SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate, l_returnflag FROM lineitem)
""")
def q_typed_labelled(spark, sf_dir):
    """P8 + P18: types of every line normalised, codes mapped to names."""
    lines = C.cast_columns(table(spark, sf_dir, "lineitem"), {"l_quantity": "int", "l_shipdate": "date"})
    named = C.map_labels(lines, "l_returnflag", {"R": "returned", "A": "accepted"}, "flag_name", "open")
    return named.select("l_orderkey", "l_linenumber", "l_quantity",
                        F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"), "flag_name")


@register("iqr_filter_sales", """
WITH b AS (SELECT quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3 FROM store_sales)
SELECT x.* FROM store_sales x CROSS JOIN b
WHERE x.sales BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)
""", views=("store_sales",))
def q_iqr(spark, sf_dir):
    """IQR outlier filter (25/75 %, k = 1.5, inclusive) on daily sales."""
    return C.iqr_filter(VIEWS["store_sales"](spark, sf_dir), ["sales"])


@register("iqr_filter_rfm_sequential", RFM_SQL_CTE.rstrip() + """
, b1 AS (SELECT quantile_cont(recency, 0.01) AS lo, quantile_cont(recency, 0.99) AS hi FROM rfm),
s1 AS (SELECT rfm.* FROM rfm CROSS JOIN b1 WHERE recency BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)),
b2 AS (SELECT quantile_cont(frequency, 0.01) AS lo, quantile_cont(frequency, 0.99) AS hi FROM s1),
s2 AS (SELECT s1.* FROM s1 CROSS JOIN b2 WHERE frequency BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)),
b3 AS (SELECT quantile_cont(monetary, 0.01) AS lo, quantile_cont(monetary, 0.99) AS hi FROM s2)
SELECT s2.* FROM s2 CROSS JOIN b3 WHERE monetary BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)
""", views=("retail_lines_dup",))
def q_iqr_seq(spark, sf_dir):
    """Sequential 1/99 % filter over recency, frequency, monetary."""
    return C.iqr_filter(R.rfm(clean_lines(spark, sf_dir)).persist(), RFM_COLS, 0.01, 0.99, 1.5, sequential=True)


@register("store_clean", """
WITH f AS (SELECT *, CAST(competition_open_since_month IS NOT NULL AS INTEGER) AS has_competition FROM store),
m AS (SELECT quantile_cont(competition_distance, 0.5) AS med, max(competition_open_since_year) + 1 AS ymax FROM store)
SELECT store, store_type, assortment, coalesce(competition_distance, m.med) AS competition_distance,
       coalesce(competition_open_since_month, 1) AS competition_open_since_month,
       CAST(coalesce(competition_open_since_year, m.ymax) AS INTEGER) AS competition_open_since_year,
       promo2, coalesce(promo2_since_week, 0) AS promo2_since_week, coalesce(promo2_since_year, 0) AS promo2_since_year,
       coalesce(promo_interval, 'None') AS promo_interval, has_competition
FROM f CROSS JOIN m
""", views=("store",))
def q_store_clean(spark, sf_dir):
    """Presence flag, median fill, max+1 fill, constant fills."""
    return C.clean_store(VIEWS["store"](spark, sf_dir))


def _summary_sql() -> str:
    parts = []
    for c in RFM_COLS:
        corr = ", ".join(
            f"round(CASE WHEN stddev_samp({c}) > 0 AND stddev_samp({o}) > 0 THEN corr(CAST({c} AS DOUBLE), "
            f"CAST({o} AS DOUBLE)) END, 6) AS corr_with_{o}" for o in RFM_COLS)
        parts.append(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                     f"round(avg({c}), 4) AS mean, quantile_cont({c}, 0.5) AS median, "
                     f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.75) AS p75, {corr} FROM rfm")
    return " UNION ALL ".join(parts)


@register("rfm_summary", RFM_SQL_CTE + _summary_sql(), views=("retail_lines_dup",))
def q_rfm_summary(spark, sf_dir):
    """RFM summary (min, max, mean, median, quartiles) and correlations."""
    s = PR.rfm_summary(R.rfm(clean_lines(spark, sf_dir)).persist(), RFM_COLS)
    return s.select("column", "min", "max", py_round("mean", 4).alias("mean"), "median", "p25", "p75",
                    *[py_round(f"corr_with_{c}", 6).alias(f"corr_with_{c}") for c in RFM_COLS])


@register("kde_recency", RFM_SQL_CTE.rstrip() + """
, d AS (SELECT CAST(recency AS DOUBLE) AS v FROM rfm WHERE recency IS NOT NULL),
st AS (SELECT count(*) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx FROM d),
b AS (SELECT n, sd * pow(n, -0.2) AS h, mn - 3.0 * sd * pow(n, -0.2) AS lo, mx + 3.0 * sd * pow(n, -0.2) AS hi FROM st),
g AS (SELECT CAST(range AS INTEGER) AS point, lo + range * ((hi - lo) / 199) AS x FROM b, range(200)),
vals AS (SELECT v, count(*) AS c FROM d GROUP BY 1)
SELECT point, round(x, 6) AS x, round(sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())), 12) AS density
FROM g, vals, b GROUP BY point, x, n, h
""", views=("retail_lines_dup",))
def q_kde(spark, sf_dir):
    """Gaussian KDE of customer recency on a 200-point grid (Scott bandwidth)."""
    k = PR.kde(R.rfm(clean_lines(spark, sf_dir)).persist(), "recency", 200, 3.0)
    return k.select("point", py_round("x", 6).alias("x"), py_round("density", 12).alias("density"))


@register("kde_distance_sales", """
WITH m AS (SELECT store, CAST(sum(CAST(sales AS DECIMAL(38,6))) AS DOUBLE) / count(sales) AS b FROM store_sales GROUP BY 1),
d AS (SELECT competition_distance AS a, b FROM store JOIN m USING (store) WHERE competition_distance IS NOT NULL),
s AS (SELECT count(*) AS n, var_samp(a) AS xx, var_samp(b) AS yy, covar_samp(a, b) AS xy,
             min(a) AS x0, max(a) AS x1, min(b) AS y0, max(b) AS y1 FROM d),
t AS (SELECT *, xx * yy - xy * xy AS det, pow(n, -1.0 / 6.0) AS f, (x1 - x0) / 100 AS wide, (y1 - y0) / 100 AS tall FROM s),
cells AS (SELECT least(floor((a - x0) / wide), 99) AS p, least(floor((b - y0) / tall), 99) AS q, count(*) AS c FROM d, t GROUP BY 1, 2),
mid AS (SELECT x0 + (p + 0.5) * wide AS a, y0 + (q + 0.5) * tall AS b, c FROM cells, t),
g AS (SELECT CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j,
             x0 - 3 * f * sqrt(xx) + i.range * ((x1 - x0 + 6 * f * sqrt(xx)) / 39) AS x,
             y0 - 3 * f * sqrt(yy) + j.range * ((y1 - y0 + 6 * f * sqrt(yy)) / 39) AS y FROM t, range(40) i, range(40) j),
k AS (SELECT i, j, x, y, sum(c * exp(-0.5 * ((x - a) * (x - a) * yy - 2 * (x - a) * (y - b) * xy + (y - b) * (y - b) * xx)
             / (f * f * det))) AS total FROM g, mid, t GROUP BY 1, 2, 3, 4)
SELECT i, j, round(x, 4) AS x, round(y, 4) AS y,
       round(total / (n * 2 * pi() * f * f * sqrt(det)) * sqrt(xx * yy), 9) AS density_std FROM k, t
""", views=("store_sales", "store"))
def q_kde_2d(spark, sf_dir):
    """Two-dimensional density of competition distance and mean sales of the stores."""
    mean = VIEWS["store_sales"](spark, sf_dir).groupBy("store").agg(exact_mean("sales").alias("avg_sales"))
    both = VIEWS["store"](spark, sf_dir).join(mean, "store")
    k = PR.kde_2d(both, "competition_distance", "avg_sales", 40, 100)
    return k.select("i", "j", py_round("x", 4).alias("x"), py_round("y", 4).alias("y"),
                    py_round("density_std", 9).alias("density_std"))
