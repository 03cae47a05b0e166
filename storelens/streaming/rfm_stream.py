"""Streaming per-customer state for RFM (A7 over a feed).

``customer_state_stream`` keeps, per customer, the last purchase time, the
number of lines and the exact spend, as a streaming aggregation in update
mode; each micro-batch's changed rows are merged with the latest whole snapshot
into a new one, ``epoch=<n>`` under the state path (a replayed batch replaces
its own epoch only; the two latest are kept).  ``read_state`` reads the latest
whole snapshot and ``rfm_from_state`` turns it into the batch RFM table for any
as-of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.exprs import money


def customer_state_stream(spark: SparkSession, source_dir: str, schema: T.StructType, state_path: str,
                          checkpoint: str, customer: str = "customer_id", ts: str = "invoice_date",
                          amount: str = "amount", invoice: str = "invoice", watermark: str | None = None):
    """Start the streaming aggregation; returns the ``StreamingQuery``.

    State per customer is three numbers and is kept for every customer (it
    *is* the RFM state).  With ``watermark`` rows later than that behind the
    newest event time are dropped (the event time is read as a session-zone
    timestamp for this).
    """
    src = spark.readStream.schema(schema).parquet(source_dir)
    if watermark:
        src = src.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", watermark)
    agg = (src.groupBy(customer)
              .agg(F.max(ts).alias("last_purchase"), F.count(invoice).alias("frequency"),
                   F.sum(money(amount)).alias("monetary")))

    def merge(batch: DataFrame, epoch: int) -> None:
        sp = batch.sparkSession
        # a batch that is run again replaces its own epoch; an older one is only read
        old = read_state(sp, state_path, before=epoch)
        changed = batch.select(customer, "last_purchase", "frequency", "monetary")
        merged = changed if old is None else (
            old.join(changed.select(customer), customer, "left_anti").unionByName(changed))
        merged.write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
        _drop_epochs(sp, state_path, before=epoch - 1)

    return (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
               .foreachBatch(merge).start())


def _epochs(spark: SparkSession, state_path: str) -> list[int]:
    """Epochs whose folder was written whole (its success mark is there)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [f.getPath() for f in store.listStatus(path) if f.getPath().getName().startswith("epoch=")]
    whole = [p.getName() for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


def read_state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The state of the latest whole epoch (below ``before``); None if there is
    none.  Any other read error is raised."""
    epochs = [e for e in _epochs(spark, state_path) if before is None or e < before]
    return spark.read.parquet(f"{state_path}/epoch={epochs[-1]}") if epochs else None


def _drop_epochs(spark: SparkSession, state_path: str, before: int) -> None:
    for e in _epochs(spark, state_path):
        if e < before:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/epoch={e}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def rfm_from_state(state: DataFrame, as_of: str | None = None, customer: str = "customer_id") -> DataFrame:
    """Batch RFM (recency in whole days) from the streamed state table."""
    ref = (state.agg(F.max("last_purchase").alias("_asof")) if as_of is None else
           state.sparkSession.range(1).select(F.lit(as_of).cast(state.schema["last_purchase"].dataType)
                                              .alias("_asof")))
    return state.crossJoin(F.broadcast(ref)).select(
        customer,
        F.timestamp_diff("DAY", F.col("last_purchase"), F.col("_asof")).cast("int").alias("recency"),
        F.col("frequency").cast("long").alias("frequency"),
        F.col("monetary").cast("double").alias("monetary"))
