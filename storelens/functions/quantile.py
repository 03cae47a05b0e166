"""Exact, linearly interpolated quantiles that never gather a group in one task.

``percentile`` is exact but its final merge holds every distinct value of a
group in one task; with one hot group (a third of all rows) that is one task
holding a third of the distinct values.  Here the order statistic is found
by splitting every group into value buckets instead:

1. pre-aggregate ``(group, value) -> count`` (map-side combine; copies of a
   value collapse before the shuffle);
2. range-partition those rows by (group, value) and keep them in a table, so that a
   partition's number stays with its rows: a group spans as many partitions as its
   rows need, in the order of their values;
3. a small ``(group, partition) -> rows`` table, whose prefix sums say which
   partitions hold the wanted ranks (at most two per quantile and group);
4. a running count over the rows of those chunks only, whose interval holds a
   wanted rank or not, and interpolation.

The interpolation is the linear rule of pandas / numpy: position
``p * (n - 1)``, written as Spark's exact ``percentile`` writes it,
``(ceil(pos) - pos) * lo + (pos - floor(pos)) * hi`` - so the small-input
fast path (the built-in aggregate, used when the distinct (group, value)
table is provably small) and the partitioned path give identical bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage

_C, _B, _CUM = "_q_cnt", "_q_bucket", "_q_cum"
# Above this many distinct (group, value) rows the partitioned path is used; at or
# below it the built-in exact ``percentile`` holds at most this many entries (16
# bytes each) in one task.
FAST_PATH_ROWS = 1 << 18


def _counted(df: DataFrame, value_col: str, group_cols: list[str]) -> DataFrame:
    v = F.col(value_col).cast("double")
    clean = df.select(*group_cols, v.alias(value_col)).where(
        F.col(value_col).isNotNull() & ~F.isnan(value_col))
    # The distinct-value table feeds the size check / bucket sample and the
    # main plan; keeping it (memory, spilling to disk) reads the input once.
    return clean.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias(_C)) \
                .persist(StorageLevel.MEMORY_AND_DISK)


def _order_stats(df: DataFrame, value_col: str, group_cols: list[str], targets_fn,
                 num_partitions: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Rows (groups..., n, i, vlo, vhi, frac) for the wanted ranks.

    ``targets_fn(n)`` returns a list of (lo_rank, hi_rank, frac) Column
    triples (0-based ranks) for a group of ``n`` non-null values.
    """
    if counted is None:
        counted = _counted(df, value_col, group_cols)
    keys = [*group_cols, value_col]
    ranged = counted.repartitionByRange(num_partitions, *keys) if num_partitions else counted.repartitionByRange(*keys)
    placed = cut_lineage(ranged.withColumn(_B, F.spark_partition_id()))

    # (group, partition) chunk sizes -> global offsets: one row per partition
    # that a group touches, each group's in the order of its values.
    wg = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    chunks = placed.groupBy(*group_cols, _B).agg(F.sum(_C).alias("_q_chunk"))
    chunks = chunks.select(
        *group_cols, _B, "_q_chunk",
        F.coalesce(F.sum("_q_chunk").over(
            wg.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_q_off"),
        F.sum("_q_chunk").over(wg).alias("n"))
    targets = [F.struct(F.lit(i).alias("i"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"),
                        frac.cast("double").alias("frac"))
               for i, (lo, hi, frac) in enumerate(targets_fn(F.col("n")))]
    inside = lambda r: (r >= F.col("_q_off")) & (r < F.col("_q_off") + F.col("_q_chunk"))
    chunks = chunks.withColumn("_q_t", F.filter(F.array(*targets), lambda t: inside(t["lo"]) | inside(t["hi"])))
    wanted = chunks.where(F.size("_q_t") > 0).select(*[F.col(c).alias(f"_q_g{i}") for i, c in enumerate(group_cols)],
                                                     F.col(_B).alias("_q_part"), "_q_off", "n", "_q_t")
    same = F.col(_B) == F.col("_q_part")
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_q_g{i}"))
    joined = placed.join(wanted, same)
    # Running count inside one (group, partition) chunk.
    wc = Window.partitionBy(*group_cols, _B).orderBy(value_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumn(_CUM, F.sum(_C).over(wc))
    start = F.col("_q_off") + F.col(_CUM) - F.col(_C)
    end = F.col("_q_off") + F.col(_CUM) - 1
    hits = joined.select(*group_cols, "n", value_col, start.alias("_s"), end.alias("_e"),
                         F.explode("_q_t").alias("t")).where(
        F.col("t.lo").between(F.col("_s"), F.col("_e")) |
        F.col("t.hi").between(F.col("_s"), F.col("_e")))
    hits = hits.select(
        *group_cols, "n", F.col("t.i").alias("i"), F.col("t.frac").alias("frac"),
        F.when(F.col("t.lo").between(F.col("_s"), F.col("_e")), F.col(value_col)).alias("vlo"),
        F.when(F.col("t.hi").between(F.col("_s"), F.col("_e")), F.col(value_col)).alias("vhi"))
    return hits.groupBy(*group_cols, "n", "i").agg(
        F.max("vlo").alias("vlo"), F.max("vhi").alias("vhi"), F.max("frac").alias("frac"))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), names: Sequence[str] | None = None,
                    num_partitions: int | None = None, fast_path_rows: int = FAST_PATH_ROWS) -> DataFrame:
    """Exact linear quantiles of ``value_col`` per group (NULL / NaN skipped).

    Returns one row per group with ``group_cols`` followed by one DOUBLE
    column per probability (``names`` or ``q0, q1, ...``) and ``n`` (the
    number of non-null values).
    """
    group_cols = list(group_cols)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    counted = _counted(df, value_col, group_cols)
    if counted.count() <= fast_path_rows:
        return counted.groupBy(*group_cols).agg(
            *[F.percentile(F.col(value_col), F.lit(float(p)), F.col(_C)).alias(nm)
              for p, nm in zip(probs, names)],
            F.sum(_C).alias("n")).select(*group_cols, *names, "n")

    def targets(n):
        out = []
        for p in probs:
            pos = F.lit(float(p)) * (n - 1).cast("double")
            lo = F.floor(pos)
            out.append((lo, F.ceil(pos), pos))
        return out

    per_q = _order_stats(df, value_col, group_cols, targets, num_partitions, counted)
    pos = F.col("frac")   # carries the position itself
    q = F.when((F.floor(pos) == F.ceil(pos)) | (F.col("vlo") == F.col("vhi")), F.col("vlo")).otherwise(
        (F.ceil(pos).cast("double") - pos) * F.col("vlo") + (pos - F.floor(pos).cast("double")) * F.col("vhi"))
    per_q = per_q.withColumn("q", q)
    out = per_q.groupBy(*group_cols).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(nm) for i, nm in enumerate(names)])
    return out.select(*group_cols, *names, "n")


def order_statistic(df: DataFrame, value_col: str, rank_fn, group_cols: Sequence[str] = (),
                    name: str = "value", num_partitions: int | None = None) -> DataFrame:
    """The value at 0-based rank ``rank_fn(n)`` of the sorted non-null values
    (e.g. ``lambda n: n / 2`` floored gives the upper median)."""
    group_cols = list(group_cols)

    def targets(n):
        r = F.floor(rank_fn(n))
        return [(r, r, F.lit(0.0))]

    st = _order_stats(df, value_col, group_cols, targets, num_partitions)
    return st.select(*group_cols, "n", F.col("vlo").alias(name))
