"""Spark session and cluster-setting helpers."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "storelens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster the master and the shuffle-partition count come from the
    submit configuration; locally we default to ``local[*]`` and 8 partitions.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    elif not any(k in os.environ for k in ("SPARK_MASTER", "PYSPARK_SUBMIT_ARGS", "PYSPARK_GATEWAY_PORT")):
        # not launched by spark-submit: a local session
        b = b.master("local[*]")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    # local mode runs everything in the driver JVM; only used when this call
    # starts the JVM (a cluster sets executor / driver memory at submit)
    conf["spark.driver.memory"] = os.environ.get("STORELENS_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there.  Only a local session (tests) gets
    one of its own when the setting is absent; any other master raises, as a
    folder of the driver's machine is not visible to the executors.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not re.match(r"local($|\[)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="storelens-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # core setting, read-only at runtime on some versions
        pass
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers (UDFs import it
    there), once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="storelens-pkg-"), "storelens"), "zip",
                                  root_dir=root, base_dir="storelens")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
