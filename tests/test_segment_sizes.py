"""Clustering whose work must not grow with the pairs (round 4: F1-F5)."""

import numpy as np
import pytest

from storelens.operators import dbscan as D
from storelens.operators import evaluate as EV
from storelens.operators import nearby as N
from storelens.operators import neighbors as NB
from tests.test_operators import _dbscan_brute

SCHEMA = "id long, features array<double>"


def _sorted_distances(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("block_rows", [40, 10_000])
def test_nearest_distances_across_blocks(spark, block_rows):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(9, 0.1, (100, 3)), [[500.0, 0, 0]]])
    x = np.concatenate([x, x[:70], x[:70]])  # copies
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(x))]  # ids repeat and are missing
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(1, [None, 1.0, 2.0]), (2, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = N.nearest_distances(df, 12, block_rows=block_rows)
    lists = sorted(tuple(r.near) for r in got.collect() for _ in range(r.w))
    want = sorted(map(tuple, _sorted_distances(x, 12)))
    assert np.allclose(lists, want, rtol=1e-12, atol=1e-12) and len(lists) == len(x)
    for p in (0.0, 0.37, 0.9, 1.0):
        assert N.list_quantile(got, p) == pytest.approx(np.quantile(np.concatenate(lists), p), rel=1e-12)
    assert N.list_quantile(got.limit(0), 0.9) is None


def test_suggested_eps_makes_no_neighbour_rows(spark, monkeypatch):
    """the quantile of all k-NN distances without a row for each pair."""
    monkeypatch.setattr(NB, "knn_join", lambda *a, **k: pytest.fail("neighbour rows"))
    x = np.random.default_rng(2).normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    want = float(np.quantile(_sorted_distances(x, 50), 0.9)) * 0.5 + 0.7
    assert D.suggest_eps(df) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("min_samples", [3, 60])
def test_dbscan_by_boxes_matches_brute_force(spark, min_samples):
    rng = np.random.default_rng(min_samples)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in ((0, 0.5, 220), (3.2, 0.5, 120), (8, 0.3, 90), (-6, 2.5, 60))])
    x = np.round(x, 1)  # copies, and pairs at exactly eps
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = {r["id"]: r["dbscan_cluster"] for r in D.dbscan(df, 0.8, min_samples, block_rows=64, box_vectors=0).collect()}
    assert got == dict(enumerate(_dbscan_brute(x, 0.8, min_samples)))


def test_dbscan_counts_no_vector_that_boxes_decide(spark, monkeypatch):
    """in a dense table most vectors are decided by the boxes around their neighbours."""
    counted = []
    whole = D.vector_counts
    monkeypatch.setattr(D, "vector_counts", lambda v, g, e, c, home: counted.append(home.count()) or whole(v, g, e, c, home))
    x = np.concatenate([np.random.default_rng(4).uniform(0, 6, (3000, 2)), [[50.0, 50.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    lab = {r["id"]: r["dbscan_cluster"] for r in D.dbscan(df, 1.0, 200, box_vectors=1).collect()}
    assert set(lab.values()) == {0, -1} and lab[len(x) - 1] == -1
    assert counted[0] < 0.9 * len(x)  # before: every vector, as no patch has 200


def test_silhouettes_leave_out_noise_and_take_a_distance_once(spark, monkeypatch):
    """all methods' silhouettes by one pass over half of the pairs."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(230, 3)), 1)
    rows = [(i, v.tolist(), int(i % 3), int(i % 4) - 1, int(v[0] > 0), -1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA + ", a int, b int, c int, d int").repartition(3)
    want = {c: EV.silhouette(df.where(f"{c} <> -1"), "id", "features", c).first()[0] for c in "abc"}
    passes, plain = [], NB.block_pairs
    monkeypatch.setattr(NB, "block_pairs", lambda *a, **k: passes.append(k.get("half")) or plain(*a, **k))
    got = EV.silhouettes(df, list("abcd"), block_rows=40, noise_label=-1)
    assert {c: got[c] for c in "abc"} == pytest.approx(want, abs=1e-9) and got["d"] is None
    assert passes == [True]


def test_method_metrics_take_one_pass(spark, monkeypatch):
    from storelens.plans import models as M

    monkeypatch.setattr(NB, "label_distance_sums", lambda *a, **k: pytest.fail("a pass for one method"))
    x = np.random.default_rng(6).normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 2, i % 3, -1, i % 2 - 1) for i, v in enumerate(x)],
                               SCHEMA + ", kmeans int, ward_cluster int, dbscan_cluster int, gmm int")
    got = {r.method: r for r in M._method_metrics(df).collect()}
    assert got["dbscan_cluster"].silhouette == 0.0 and got["dbscan_cluster"].n == 0 and got["gmm"].k == 1 and got["gmm"].silhouette == 0.0
    assert got["kmeans"].silhouette == pytest.approx(_brute_silhouette(x, np.arange(60) % 2), abs=1e-9)


def _brute_silhouette(x, lab):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        means = {c: d[i, lab == c].sum() / ((lab == c).sum() - (lab[i] == c)) for c in set(lab)}
        a, b = means.pop(lab[i]), min(means.values())
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_kmeans_steps_take_squared_distances_only_at_the_end(spark, monkeypatch):
    """sums of squares only of the final centres; labels and sums as by the plain formula."""
    from storelens.operators import kmeans as K

    x = np.random.default_rng(7).normal(size=(500, 3))
    c = x[:6]
    plain = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    lab, sq = K._nearest(np.ascontiguousarray(x.T), c)
    assert (lab == plain.argmin(1)).all() and (sq == plain.min(1)).all()
    seen, whole = [], K._lloyd_pass
    monkeypatch.setattr(K, "_lloyd_pass", lambda *a: seen.append(a[-1]) or whole(*a))
    df = spark.createDataFrame([tuple(v) for v in x.tolist()], "a double, b double, c double")
    for m in K.kmeans_many(df, ["a", "b", "c"], [2, 3], 2, 42):
        sse = ((x[:, None, :] - m.centers[None, :, :]) ** 2).sum(-1).min(1).sum()
        assert m.inertia == pytest.approx(sse, rel=1e-9)
    assert seen[-1] is not None and all(s is None for s in seen[:-1])
