"""Table profiles and the data behind the reference's charts.

Wide per-column statistics are computed by unpivoting to (column, value)
once and grouping by column, so one distributed pass serves every column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.quantile import exact_quantiles


def unpivot(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value",
            cast: str = "double") -> DataFrame:
    """Long form (column, value) of ``cols`` (values cast to one type)."""
    return df.select(*[F.col(c).cast(cast).alias(c) for c in cols]).unpivot(
        [], list(cols), name, value)


def top_counts(df: DataFrame, column: str, n: int | None = 10, name: str = "count") -> DataFrame:
    """Frequency table, most frequent first, key as tie-break."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    out = out.orderBy(F.desc(name), F.asc(column))
    return out.limit(n) if n else out


def top_sums(df: DataFrame, group: str, value: str, n: int | None = 10, name: str = "total") -> DataFrame:
    """Total per group, largest first, key tie-break (A30, O2); exact money sum."""
    out = df.groupBy(group).agg(F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias(name))
    out = out.orderBy(F.desc(name), F.asc(group))
    return out.limit(n) if n else out


def group_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Category counts over one or two keys."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def null_profile(df: DataFrame, only_nonzero: bool = True) -> DataFrame:
    """NULL (and NaN) count per column in one pass."""
    def is_missing(c):
        f = df.schema[c].dataType.typeName()
        m = F.col(c).isNull()
        return (m | F.isnan(c)) if f in ("double", "float") else m

    wide = df.agg(*[F.count_if(is_missing(c)).alias(c) for c in df.columns])
    out = wide.unpivot([], df.columns, "column", "nulls")
    return out.where(F.col("nulls") > 0) if only_nonzero else out


def distinct_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-NULL values per column.

    Exact by default: one group-by over the unpivoted (column, value-as-text)
    pairs - a hot value is combined map-side; ``approx=True`` uses HLL++.
    """
    cols = list(cols or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return wide.unpivot([], cols, "column", "distinct")
    long = unpivot(df, cols, cast="string").where(F.col("value").isNotNull())
    per = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per column.

    Exact linear quantiles as in pandas, all columns in one quantile pass.
    """
    long = unpivot(df, cols)
    base = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"], names=["p25", "p50", "p75"])
    return base.join(q.drop("n"), "column", "left")


def schema_profile(df: DataFrame) -> DataFrame:
    """Column, Spark type and non-null count."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column", "non_null")
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return long.withColumn("dtype", F.element_at(tmap, F.col("column")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair in one aggregate.

    A constant column gives NULL (pandas NaN) instead of an ANSI error.
    """
    aggs = []
    for a in cols:
        aggs.append(F.stddev_samp(a).alias(f"_sd_{a}"))
    for a in cols:
        for b in cols:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c_{a}__{b}"))
    wide = df.agg(*aggs)
    rows = []
    for a in cols:
        for b in cols:
            ok = (F.col(f"_sd_{a}") > 0) & (F.col(f"_sd_{b}") > 0)
            rows.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                                 F.when(ok, F.col(f"_c_{a}__{b}")).alias("corr")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max].

    Bin b (1-based) holds min + (b-1)*w <= v < min + b*w; the top edge falls
    in the last bin.  Empty bins are present with count 0.
    """
    v = F.col(column).cast("double")
    data = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    r = data.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    rng = df.sparkSession.range(1).select(F.lit(r["mn"]).cast("double").alias("mn"),
                                          F.lit(r["mx"]).cast("double").alias("mx"))
    frac = F.coalesce(F.try_divide(F.col("v") - F.col("mn"), F.col("mx") - F.col("mn")), F.lit(0.0))
    b = F.least(F.floor(frac * bins).cast("int"), F.lit(bins - 1)) + 1
    counts = data.crossJoin(F.broadcast(rng)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(rng)
    width = (F.col("mx") - F.col("mn")) / bins
    return spine.join(counts, "bin", "left").select(
        "bin", (F.col("mn") + width * (F.col("bin") - 1)).alias("lo"),
        (F.col("mn") + width * F.col("bin")).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def scatter_bins(df: DataFrame, x: str, y: str, nx: int = 20, ny: int = 20) -> DataFrame:
    """2-D equal-width counts: the bounded form of a scatter plot."""
    data = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    r = data.agg(F.min("x").alias("xmn"), F.max("x").alias("xmx"),
                 F.min("y").alias("ymn"), F.max("y").alias("ymx")).first()
    rng = F.broadcast(df.sparkSession.range(1).select(
        *[F.lit(r[c]).cast("double").alias(c) for c in ("xmn", "xmx", "ymn", "ymx")]))

    def bucket(c, mn, mx, n):
        frac = F.coalesce(F.try_divide(F.col(c) - F.col(mn), F.col(mx) - F.col(mn)), F.lit(0.0))
        return F.least(F.floor(frac * n).cast("int"), F.lit(n - 1)) + 1

    return data.crossJoin(rng).groupBy(
        bucket("x", "xmn", "xmx", nx).alias("bx"), bucket("y", "ymn", "ymx", ny).alias("by")).agg(
        F.count(F.lit(1)).alias("count"))


def null_patterns(df: DataFrame) -> DataFrame:
    """Rows per pattern of NULL flags (bounded form of the null heat map)."""
    flags = [F.col(c).isNull().cast("int").alias(c) for c in df.columns]
    return df.select(*flags).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("rows"))


def box_stats(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    """Box-plot numbers per group (A25): q1, median, q3, whiskers (most extreme
    values inside k*IQR of the box), outlier count, n.

    The per-group quartile table (one row per group) is joined back to the
    values; AQE turns that into a broadcast join from the measured size.
    """
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], [group], names=["q1", "median", "q3"])
    qb = q   # one row per group; AQE broadcasts it from its runtime size
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - k * iqr, F.col("q3") + k * iqr
    v = F.col(value).cast("double")
    j = df.select(group, v.alias("_v")).where(F.col("_v").isNotNull()).join(qb, group)
    inside = F.col("_v").between(lo, hi)
    return j.groupBy(group, "q1", "median", "q3", "n").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


#: Odd factors of the weights' 32-bit hash.
HASH_FACTORS = (2654435761, 97654321, 2246822519, 3266489917)
#: Fixed-point places of the summed values.
PLACES = 6


def poisson_thresholds(most: int = 12) -> list[int]:
    """32-bit thresholds: a uniform hash that reaches the first n of them has weight n,
    with the probabilities of Poisson(1)."""
    total, out = 0.0, []
    for n in range(most):
        total += math.exp(-1.0) / math.factorial(n)
        out.append(math.floor(total * 2 ** 32))
    return out


def poisson_weights(keys: np.ndarray, rep: int) -> np.ndarray:
    """The Poisson(1) weights of rows (64-bit keys) in replicate ``rep``: a hash of both."""
    a, b, c, d = (np.uint64(x) for x in HASH_FACTORS)
    low = np.uint64(0xFFFFFFFF)
    h = (keys.astype(np.int64).view(np.uint64) & low) * a + np.uint64(rep + 1) * b & low
    h = (h ^ (h >> np.uint64(15))) * c & low
    h = (h ^ (h >> np.uint64(13))) * d & low
    h ^= h >> np.uint64(16)
    return np.searchsorted(np.array(poisson_thresholds(), np.uint64), h, side="right")


def mean_ci(df: DataFrame, group: str, value: str, n_boot: int = 0, key: str | Column | None = None,
            level: float = 0.95) -> DataFrame:
    """Bar-chart numbers: mean per group (A29), optional bootstrap interval.

    The interval uses Poisson(1) weights from a hash of (row ``key``, replicate), so
    no row is resampled or copied and any partitioning gives the same weights.  A task
    keeps, per group, one array over the replicates of weights and of weighted
    values (in whole multiples of 10^-6, as two exact integers); the arrays are added
    up per (group, replicate) and the replicate means give exact percentiles.
    """
    v = F.col(value).cast("double")
    base = df.groupBy(group).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))
    if n_boot <= 0:
        return base
    if key is None:
        raise ValueError("the interval's weights need a row key")
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), (F.col(key) if isinstance(key, str) else key).cast("long").alias("k"),
                     F.rint(v * 10 ** PLACES).cast("long").alias("x")).where(F.col("x").isNotNull())

    def replicate(batches):
        sums: dict = {}
        for pdf in batches:
            for g, own in pdf.groupby("g", dropna=False):
                total = sums.setdefault(None if pd.isna(g) else g, np.zeros((3, n_boot), np.int64))
                keys, x = own["k"].to_numpy(np.int64), own["x"].to_numpy(np.int64)
                high, low = x >> 24, x & 0xFFFFFF
                for r in range(n_boot):
                    w = poisson_weights(keys, r)
                    total[:, r] += (w.sum(), (w * high).sum(), (w * low).sum())
        if sums:
            yield pd.DataFrame({"g": list(sums), **{c: [t[i] for t in sums.values()] for i, c in enumerate(("w", "high", "low"))}})

    parts = rows.mapInPandas(replicate, f"g {kind}, w array<long>, high array<long>, low array<long>")
    each = parts.select("g", F.posexplode(F.arrays_zip("w", "high", "low")).alias("rep", "s"))
    wide = "decimal(38,0)"
    total = F.sum(F.col("s.high").cast(wide)) * F.lit(1 << 24).cast("decimal(10,0)") + F.sum(F.col("s.low").cast(wide))
    means = each.groupBy("g", "rep").agg(F.sum("s.w").alias("w"), total.cast("double").alias("x")).select(
        F.col("g").alias(group), F.try_divide(F.col("x") / F.lit(float(10 ** PLACES)), F.col("w")).alias("m"))
    a = (1 - level) / 2
    ci = exact_quantiles(means, "m", [a, 1 - a], [group], names=["ci_lo", "ci_hi"]).drop("n")
    return base.join(ci.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def dataset_profile(df: DataFrame, price: str, country: str | None = None, text: str | None = None,
                    sample: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """Global scalars of a table (A33): rows, columns, price count/min/max/mean/median,
    country counts, and a stable sample of different texts."""
    med = exact_quantiles(df, price, [0.5], names=["median"]).drop("n")
    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                   F.count(price).alias("count"), F.min(price).alias("min"),
                   F.max(price).alias("max"), F.avg(price).alias("mean")).crossJoin(med)
    out = {"stats": stats}
    if country:
        out["countries"] = top_counts(df, country, None)
    if text:
        from storelens.operators.clean import stable_sample

        out["sample"] = stable_sample(df.select(text).where(F.col(text).isNotNull()).distinct(), text, sample, seed)
    return out


def rfm_summary(df: DataFrame, cols: Sequence[str] = ("recency", "frequency", "monetary")) -> DataFrame:
    """Per metric: min, max, mean, median, p25, p75 and its correlation with
    every metric (A20).  One aggregate plus one grouped-quantile pass."""
    cols = list(cols)
    long = unpivot(df, cols)
    base = long.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                      F.avg("value").alias("mean"))
    q = exact_quantiles(long, "value", [0.5, 0.25, 0.75], ["column"], names=["median", "p25", "p75"]).drop("n")
    cm = corr_matrix(df, cols)
    corr = cm.groupBy(F.col("x").alias("column")).agg(
        *[F.max(F.when(F.col("y") == c, F.col("corr"))).alias(f"corr_with_{c}") for c in cols])
    return base.join(q, "column").join(corr, "column")


def kde(df: DataFrame, column: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid (A27), Scott's bandwidth
    h = sample std * n^(-1/5), grid over [min - cut*h, max + cut*h].

    Rows are first reduced to (value, count); the grid (``grid`` points,
    fixed) is broadcast, so the work is distinct values x grid points.
    """
    v = F.col(column).cast("double")
    data = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    st = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                  F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    n, sd, mn, mx = st["n"], st["sd"], st["mn"], st["mx"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "point int, x double, density double")
    h = sd * n ** (-0.2)
    lo, hi = mn - cut * h, mx + cut * h
    pts = spark.range(grid).select(F.col("id").cast("int").alias("point"),
                                   (F.lit(lo) + F.col("id") * F.lit((hi - lo) / (grid - 1))).alias("x"))
    vals = data.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    z = (F.col("x") - F.col("v")) / F.lit(h)
    dens = F.sum(F.col("c") * F.exp(F.lit(-0.5) * z * z)) / F.lit(n * h * (2 * 3.141592653589793) ** 0.5)
    return vals.crossJoin(F.broadcast(pts)).groupBy("point", "x").agg(dens.alias("density"))


def kde_2d(df: DataFrame, x: str, y: str, grid: int = 60, bins: int = 100, cut: float = 3.0) -> DataFrame:
    """Bivariate Gaussian kernel density on a grid (A27): the bandwidth matrix is the
    sample covariance times n^(-1/3) (Scott), the grid spans ``cut`` bandwidths
    beyond the data.  Rows are first counted in ``bins`` x ``bins`` cells and stand at
    their cell's middle, so the work is cells x grid points whatever the rows.

    i, j, x, y, density, and density_std (per product of the standard deviations).
    Fewer than two points, or points on a line, have no density: no rows.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    data = df.select(a.alias("a"), b.alias("b")).dropna().where(~F.isnan("a") & ~F.isnan("b"))
    st = data.agg(F.count("*").alias("n"), F.var_samp("a").alias("xx"), F.var_samp("b").alias("yy"),
                  F.covar_samp("a", "b").alias("xy"), F.min("a").alias("x0"), F.max("a").alias("x1"),
                  F.min("b").alias("y0"), F.max("b").alias("y1")).first()
    spark, n = df.sparkSession, st["n"]
    det = 0.0 if n < 2 else st["xx"] * st["yy"] - st["xy"] * st["xy"]
    if n < 2 or det <= 1e-12 * st["xx"] * st["yy"]:
        return spark.createDataFrame([], "i int, j int, x double, y double, density double, density_std double")
    factor = n ** (-1 / 6)
    wide, tall = (st["x1"] - st["x0"]) / bins, (st["y1"] - st["y0"]) / bins
    cell = lambda v, low, size: F.least(F.floor((F.col(v) - F.lit(low)) / F.lit(size)), F.lit(bins - 1))
    middle = lambda v, low, size: F.lit(low) + (F.col(v) + 0.5) * F.lit(size)
    cells = data.groupBy(cell("a", st["x0"], wide).alias("p"), cell("b", st["y0"], tall).alias("q")).agg(
        F.count("*").alias("c")).select(middle("p", st["x0"], wide).alias("a"), middle("q", st["y0"], tall).alias("b"), "c")
    step = lambda k, low, high: F.lit(low) + F.col(k) * F.lit((high - low) / (grid - 1))
    dx, dy = cut * factor * st["xx"] ** 0.5, cut * factor * st["yy"] ** 0.5
    points = spark.range(grid * grid).select((F.col("id") % grid).cast("int").alias("i"),
                                             F.floor(F.col("id") / grid).cast("int").alias("j"))
    points = points.select("i", "j", step("i", st["x0"] - dx, st["x1"] + dx).alias("x"),
                           step("j", st["y0"] - dy, st["y1"] + dy).alias("y"))
    u, v = F.col("x") - F.col("a"), F.col("y") - F.col("b")
    scale = factor * factor * det
    q = (u * u * F.lit(st["yy"]) - F.lit(2.0) * u * v * F.lit(st["xy"]) + v * v * F.lit(st["xx"])) / F.lit(scale)
    total = F.sum(F.col("c") * F.exp(F.lit(-0.5) * q))
    density = total / F.lit(n * 2 * math.pi * factor * factor * det ** 0.5)
    # grid * grid points and at most bins * bins cells: both bounded
    out = cells.crossJoin(F.broadcast(points)).groupBy("i", "j", "x", "y").agg(density.alias("density"))
    return out.withColumn("density_std", F.col("density") * F.lit((st["xx"] * st["yy"]) ** 0.5))
