"""Short tables are written as few files, whatever the shuffle partitions; each
file of a checkpoint costs the executor a child process on a local file system."""

import pytest

from storelens.functions import sizing
from storelens.llm import mixing, near_copies
from storelens.operators import components

PARTS = 61


@pytest.fixture
def many_parts(spark):
    """More shuffle partitions than cores, none of them put together."""
    held = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield max(spark.sparkContext.defaultParallelism, 1)
    for k, v in before.items():
        spark.conf.set(k, v)


def _recorded(monkeypatch, module):
    files = []

    def cut(df, *args, **kwargs):
        out = sizing.cut_lineage(df, *args, **kwargs)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "cut_lineage", cut)
    return files


def test_rounds_of_components(spark, monkeypatch, many_parts):
    files = _recorded(monkeypatch, components)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (40, 40)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 40}
    assert len(files) > 2 and max(files[1:]) <= many_parts < PARTS


def test_steps_of_the_mix(spark, monkeypatch, many_parts):
    files = _recorded(monkeypatch, mixing)
    cells = spark.createDataFrame([("a", 1.0, 100), ("b", 1.0, 50), (None, 1.0, 10)], "source string, prior double, tokens long")
    sizes = cells.selectExpr("source", "tokens as source_size")
    got = {r.source: r for r in mixing.tilt(cells, mixing.source_targets(sizes), 3.0).collect()}
    assert set(got) == {"a", "b", None}
    assert len(files) > 2 and max(files[1:]) <= many_parts < PARTS


def test_rows_set_the_files(spark, many_parts):
    df = spark.range(0, 500, 1, PARTS)
    assert sizing.cut_lineage(df).rdd.getNumPartitions() == PARTS
    assert sizing.cut_lineage(df, rows=500).rdd.getNumPartitions() == many_parts
    assert sizing.cut_lineage(df, rows=(many_parts + 2) * sizing.FILE_ROWS).rdd.getNumPartitions() == many_parts + 2
    assert sizing.cut_lineage(df, rows=1000 * sizing.FILE_ROWS).rdd.getNumPartitions() == PARTS


def test_tables_used_once_are_not_written(spark, monkeypatch):
    files = _recorded(monkeypatch, near_copies)
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "another text of its own words here"), (None, None)]
    got = near_copies.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 4]
    assert len(files) <= 10  # before: the links, the second pairs and the classes too
