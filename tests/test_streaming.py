"""The streamed per-customer state equals the batch RFM."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

from storelens.operators import rfm as R
from storelens.streaming import customer_state_stream, read_state, rfm_from_state


def test_stream_state_matches_batch(spark):
    work = tempfile.mkdtemp(prefix="storelens-stream-")
    src = os.path.join(work, "src")
    os.makedirs(src)
    shutil.copy(f"{SF_SMALL}/events.parquet", os.path.join(src, "part-0.parquet"))
    ev = spark.read.parquet(src)
    feed = ev.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("customer_id"), F.col("event_id").alias("invoice"),
        F.col("ts").alias("invoice_date"), F.col("value").alias("amount"))
    feed_dir = os.path.join(work, "feed")
    feed.write.parquet(feed_dir)
    q = customer_state_stream(spark, feed_dir, feed.schema, os.path.join(work, "state", "current"),
                              os.path.join(work, "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = rfm_from_state(read_state(spark, os.path.join(work, "state", "current")))
    exp = R.rfm(feed, amount="amount")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.select(*got.columns).collect()))
