import numpy as np
import pyarrow as pa

from storelens.llm import quality as Q
from storelens.llm.base import table, utf8
from tests.llm.conftest import as_rows

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    got = Q.folded_quality(table(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s >= 0.3 for s in bad]) < 0.3


def test_prior_and_risk():
    draw = np.random.default_rng(0)
    positive = draw.normal(2, 1, (3000, 2)).astype(np.float32)
    hidden = draw.random(4000) < 0.7
    unlabelled = np.where(hidden[:, None], draw.normal(2, 1, (4000, 2)), draw.normal(-2, 1, (4000, 2))).astype(np.float32)
    prior = Q.cross_prior(positive, unlabelled)
    assert abs(prior - 0.7) < 0.06
    w, b = Q.non_negative_fit(positive, unlabelled, prior)
    assert ((unlabelled @ w + b > 0) == hidden).mean() > 0.98


def test_features_do_not_depend_on_the_batch():
    texts = ["", "one", "A B\nA B\nA B", "", "x" * 1000, "é ü 12%"]
    every = Q.features(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(every[i], Q.features(*utf8(pa.array([t])))[0])


def test_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (9, 0, 0), (None, 1, 1), (8, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = Q.folded_quality(odd, labels)
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert as_rows(Q.folded_quality(clashing, labels)) == as_rows(got)
    assert Q.folded_quality(empty, labels).count() == 0
    unknown = Q.folded_quality(odd, labels.limit(0))
    assert {(r.score, r.predicted) for r in unknown.collect()} == {(0.5, 1)}
    kept = Q.drop_rejected(clashing, None)
    assert kept.columns == clashing.columns and kept.count() == odd.count()
