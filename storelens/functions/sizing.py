"""Size-checked broadcast and lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when the optimizer's size of it is at most this.
DEFAULT_BROADCAST_BYTES = 64 << 20


def broadcast_if_bounded(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if its plan's size statistic (bytes, no
    job) is within ``max_bytes``.  Above it the DataFrame is returned unchanged
    and the planner, with the runtime statistics, picks the join.
    """
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:  # joins of joins multiply their sizes, to more digits than Python reads
        return df
    return F.broadcast(df) if size <= max_bytes else df


# Bytes of a table's files that one partition of a join holds.
PARTITION_BYTES = 2 << 20


def partitions_by_size(df: DataFrame, part_bytes: int = PARTITION_BYTES) -> int:
    """Partitions for a shuffle of ``df``, in proportion to its plan's size statistic
    (no job): a task's rows and memory stay the same however large the table is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))


# Short rows that one file of a checkpoint holds, where their number is known.
FILE_ROWS = 50_000


def cut_lineage(df: DataFrame, eager: bool = True, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``.

    Used by iterative operators (label propagation, EM, restarts) so a lost
    executor recomputes from the last checkpoint, not from the first scan.
    ``rows``: how many short rows there are at most; the files then follow their
    number (as many as the cluster's cores at least), not the shuffle partitions.
    """
    from storelens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when ``df`` has fewer partitions than the
    cluster's parallelism (a single large file or row group is read as one
    partition).  On inputs with many splits - any large table - it is a no-op."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
