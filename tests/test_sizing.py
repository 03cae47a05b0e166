import random

from pyspark.sql import functions as F

from storelens.functions import sizing
from storelens.operators.clean import clean_retail
from storelens.sources import fixtures


def tables(spark, folder, orders):
    draw = random.Random(orders)
    rows = {
        "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string",
                     [(o, draw.randrange(50), k, float(k), draw.random(), "N") for o in range(orders) for k in range(1, 4)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
                   [(o, o % 40, None) for o in range(orders)]),
        "customer": ("c_custkey long, c_nationkey int", [(c, c % 3) for c in range(40)]),
        "nation": ("n_nationkey int, n_name string", [(0, "A"), (1, "B"), (2, None)]),
        "part": ("p_partkey long, p_name string", [(p, f"part {p}") for p in range(50)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_task_holds_no_more_lines_of_a_larger_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "partitions_by_size", lambda df: sizing.partitions_by_size(df, 1000))
    largest = []
    for orders in (400, 6400):
        lines = clean_retail(fixtures.retail_lines_dup(spark, tables(spark, tmp_path / str(orders), orders)))
        per = lines.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert sum(r.n for r in per) == 3 * orders
        largest.append(max(r.n for r in per))
    assert largest[1] < 2 * largest[0], largest


def test_partitions_follow_the_size(spark, tmp_path):
    spark.range(20_000).select(F.sha1(F.col("id").cast("string")).alias("s")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert 2 * sizing.partitions_by_size(df, 20_000) - sizing.partitions_by_size(df, 10_000) in (0, 1)
    assert sizing.partitions_by_size(df, 1 << 40) == spark.sparkContext.defaultParallelism
