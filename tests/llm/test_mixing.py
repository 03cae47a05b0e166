import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import mixing as M
from storelens.llm.base import table
from tests.llm.conftest import as_rows


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            free.remove(s)
        left -= sum(cap * sizes[s] for s in over)
    return target


def check(rows, texts):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    target = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        yield s, taken[s], target[s]


def test_targets_met(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = M.entropy_mix(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(text) and all(r.size == len(re.findall(M.WORD, text[r.doc_id])) for r in got)
    for _, taken, target in check(got, text):
        assert abs(taken - target) <= 0.01 * target
    assert as_rows(M.entropy_mix(docs.repartition(7)).select("doc_id", "taken")) == sorted(
        (str(r.doc_id), str(r.taken)) for r in got)


def test_caps_are_shared_again(spark):
    rows = [(i, "w " * 10, s) for s, n in (("a", 3), ("b", 400), ("c", 20), (None, 30), ("", 50)) for i in range(n)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {s: (taken, target) for s, taken, target in check(M.entropy_mix(docs).collect(), None)}
    assert got["a"] == (90, 90.0)
    assert all(abs(taken - target) <= 10 for taken, target in got.values())


def test_priors_tilt(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', 5 + id % 50) AS text", "'s' AS source",
                                        "1.0 + id % 2 AS q")
    got = M.entropy_mix(docs.where("doc_id < 1500").unionByName(
        docs.where("doc_id >= 1500").withColumn("source", F.lit("t"))), prior=F.col("q")).toPandas()
    one = got[got.source == "s"]
    rates = sorted(one["rate"].unique())
    assert len(rates) == 2 and (rates[1] == 3.0 or rates[1] / rates[0] == pytest.approx(2, rel=1e-6))
    assert one["taken"].sum() == pytest.approx(one["target"].iloc[0], rel=0.01)
    assert np.dot(one["rate"], one["size"]) == pytest.approx(one["target"].iloc[0], rel=1e-6)


def test_odd_rows(odd, clashing, empty):
    got = M.entropy_mix(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {(r.size, r.taken) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 0)}
    list(check(rows, None))
    assert as_rows(M.entropy_mix(clashing)) == as_rows(got)
    assert M.entropy_mix(empty).count() == 0
    mixed = M.mixed_rows(clashing)
    assert mixed.columns == clashing.columns
    nothing = M.entropy_mix(odd.where("doc_id in (3, 4)"))
    assert {(r.target, r.taken) for r in nothing.collect()} == {(0.0, 0)}


def test_rows_without_an_id_are_dealt_over_chunks(spark):
    from storelens.llm import mixing as M

    docs = spark.range(3000).selectExpr("cast(null as long) AS doc_id", "concat('w', id, ' x') AS text",
                                        "if(id % 3 = 0, 'a', 'b') AS source")
    got = M.entropy_mix(docs, weights=(5, 2, 1), cap=3).collect()
    for source in ("a", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * (len(own) / 128 + 1)
    assert len({r.mark for r in got}) == 3000
    mixed = M.mixed_rows(docs, weights=(5, 2, 1), cap=3)
    assert mixed.count() == sum(r.copies for r in got)


def test_unmet_targets_are_an_error(spark):
    import pytest

    from storelens.llm import mixing as M

    cells = spark.createDataFrame([("a", 1.0, 100)], "source string, prior double, tokens long")
    targets = spark.createDataFrame([("a", 100, 290.0)], "source string, source_size long, target double")
    with pytest.raises(ArithmeticError):
        M.tilt(cells, targets, 3.0, steps=1)
    assert M.tilt(cells, targets, 3.0).first().tilt == pytest.approx(np.log(2.9))
