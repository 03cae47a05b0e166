"""Row numbers over whole tables or hot groups, without a window over them.

Rows are range-partitioned and sorted by (group, order) and kept in a table; a
row's place in its partition comes with it, and a small table of (partition,
group) row counts gives, by prefix sums, how many rows of the group lie in
earlier partitions.  A group may span any number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.sizing import broadcast_if_bounded, cut_lineage

_PLACES = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "order") -> DataFrame:
    """``df`` with ``out``: 1, 2, ... by ``order`` within each group of ``by`` (or
    overall).  ``order`` should tell the rows of a group apart; rows that it
    doesn't are numbered in any order.  Nulls come first and are a group."""
    keys = [*by, *order]
    # partition * 2^33 + place in it, as the rows are written
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftrightunsigned("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_PLACES))})
    parts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # one row per partition that a group touches
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
    shift = broadcast_if_bounded(cut_lineage(shift.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by],
                                                          "_shift")))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(shift, same).withColumn(out, (F.col("_at") + F.col("_shift"))).select(*df.columns, out)
