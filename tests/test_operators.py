"""Property and brute-force tests for operators without a SQL oracle, and
edge rows for the ones with one (FIXTURES.md section 4)."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storelens.functions.exprs import py_round
from storelens.functions.quantile import exact_quantiles, order_statistic
from storelens.operators import clean as C
from storelens.operators import cluster as CL
from storelens.operators import evaluate as EV
from storelens.operators import neighbors as NB
from storelens.operators import price as P
from storelens.operators import profile as PR
from storelens.operators import rfm as R
from storelens.operators import segments as SG
from storelens.operators import text as TX
from storelens.operators.kmeans import best_models, kmeans_many
from storelens.sources.io import synth_rfm


# ---------------------------------------------------------------- quantiles

@pytest.mark.parametrize("fast_rows", [0, 10_000_000])
def test_exact_quantiles_both_paths_match_numpy(spark, fast_rows):
    rng = np.random.default_rng(3)
    n = 3000
    g = rng.choice(["hot", "b", "c"], n, p=[0.8, 0.15, 0.05])
    v = np.round(rng.gamma(2.0, 50.0, n), 2)
    v[::37] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = exact_quantiles(df, "v", probs, ["g"], fast_path_rows=fast_rows).toPandas().set_index("g")
    for key, sub in pdf.dropna().groupby("g"):
        exp = np.quantile(sub["v"].to_numpy(), probs)
        assert np.allclose(got.loc[key, [f"q{i}" for i in range(5)]].to_numpy(float), exp, rtol=0, atol=1e-9)
        assert got.loc[key, "n"] == len(sub)


def test_quantile_paths_identical_bits(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 1013 / 7.0).alias("v"), (F.col("id") % 3).alias("g"))
    a = exact_quantiles(df, "v", [0.1, 0.33, 0.9], ["g"], fast_path_rows=0).orderBy("g").collect()
    b = exact_quantiles(df, "v", [0.1, 0.33, 0.9], ["g"]).orderBy("g").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_upper_median_order_statistic(spark):
    vals = [5.0, 1.0, 3.0, 2.0]
    df = spark.createDataFrame([(x,) for x in vals], "e double")
    r = order_statistic(df, "e", lambda n: n / 2, name="m").first()
    assert r["m"] == sorted(vals)[len(vals) // 2]


def test_zero_iqr_and_empty_input(spark):
    const = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert C.iqr_filter(const, ["x"]).count() == 5
    empty = spark.createDataFrame([], "x double")
    assert C.iqr_filter(empty, ["x"]).count() == 0


# ---------------------------------------------------------------- rounding

def test_py_round_matches_numpy(spark):
    cases = [1107.025, 2.675, 0.125, 0.375, 1006.4250000000001, 72598.07125, -2.5, 0.5, 1.5]
    rng = np.random.default_rng(1)
    cases += list(np.round(rng.uniform(0, 5000, 300), 3))
    df = spark.createDataFrame([(float(x),) for x in cases], "x double")
    got = df.select("x", py_round("x", 2).alias("r2"), py_round("x", 0).alias("r0")).collect()
    bad = [(r["x"], r["r2"]) for r in got if r["r2"] != float(np.round(r["x"], 2)) or r["r0"] != round(r["x"])]
    assert not bad
    # differs from Python's round only where the scaled value is an exact tie
    diff = [r["x"] for r in got if r["r2"] != round(r["x"], 2)]
    assert all((x * 100.0) % 1.0 == 0.5 for x in diff)


# ---------------------------------------------------------------- RFM, rules

def test_recency_counts_whole_days_across_midnight(spark):
    rows = [(1, 10, dt.datetime(2024, 1, 1, 12, 0), 5.0), (2, 11, dt.datetime(2024, 1, 3, 11, 0), 7.0)]
    df = spark.createDataFrame(rows, "customer_id long, invoice long, invoice_date timestamp_ntz, amount double")
    out = {r["customer_id"]: r for r in R.rfm(df, amount="amount").collect()}
    assert out[1]["recency"] == 1 and out[2]["recency"] == 0


def test_score_rules_and_names(spark):
    df = spark.createDataFrame([(59, 20, 900.0), (60, 4, 199.99), (400, 1, 10.0)],
                               "recency int, frequency long, monetary double")
    s = R.name_segments(R.rfm_scores(df), "nine").collect()
    assert [r["rfm_score"] for r in s] == ["455", "311", "011"]
    assert s[0]["segment"] == "Champions" and s[2]["segment"] == "Lost Customers"


def test_histogram_top_edge_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    h = {r["bin"]: r["count"] for r in PR.histogram(df, "v", 5).collect()}
    assert h == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}


def test_reply_price_edges(spark):
    df = spark.createDataFrame([("Price is $1,299.50",), ("$.99",), ("about 12",), ("-7",), ("none",), (None,)],
                               "text string")
    got = [r["price"] for r in P.extract_price(df, "text").collect()]
    assert got == [1299.5, 0.99, 12.0, 7.0, 0.0, 0.0]


def test_routing(spark):
    df = spark.createDataFrame([("Perform customer segmentation",), ("What is the Price of a Red Mug ",), ("How much is a red mug",), ("help me",),
                                ("",), ("what?",)], "text string")
    got = [(r["route"], r["description"]) for r in TX.route_messages(df).collect()]
    assert got == [("segment", None), ("price", "a red mug"), ("unknown", None), ("help", None), ("greeting", None),
                   ("unknown", None)]


def test_json_extraction_is_strict(spark):
    df = spark.createDataFrame([('{"a": 1} and {"b": 2}',), ('ok: [1, 2] done',), ('{"renamed_clusters": {}, '
                                '"descriptions": {}, "strategies": {}}',)], "text string")
    got = [(r["json_text"], r["has_required"]) for r in TX.extract_json(df).collect()]
    assert got[0] == (None, False) and got[1] == ("[1, 2]", False) and got[2][1] is True


def test_keyword_price_and_neighbors(spark):
    df = spark.createDataFrame([("vintage glass mug set",), ("x",)], "text string")
    kp = [r["specialist_price"] for r in P.keyword_price(df).collect()]
    assert kp == [5.0 + 3 * 1.25, 5.0]   # vintage, glass, set (mug is not premium)
    nb = P.neighbor_price(P.fallback_neighbors(df)).collect()
    assert len(nb[0]["neighbors"]) == 5 and nb[0]["neighbors"][0]["item"] == "SET OF 4 BLUE GLASS MUGS"
    assert len(nb[1]["neighbors"]) == 5 and nb[1]["neighbors"][0]["item"] == "VINTAGE METAL SIGN"


def test_scoring_failures_and_median(spark):
    df = spark.createDataFrame([(1, 0.0, 50.0), (2, 10.0, -5.0), (3, 100.0, 100.0), (4, 20.0, 30.0)],
                               "id long, truth double, guess double")
    s = {r["id"]: r for r in EV.score_predictions(df).collect()}
    assert s[1]["failed"] and not s[2]["failed"] and s[2]["guess"] == 0.01 and s[2]["error"] == 15.0
    rep = EV.score_report(EV.score_predictions(df)).first()
    assert rep["tested"] == 4 and rep["failed"] == 1 and rep["median_error"] == 10.0


# ---------------------------------------------------------------- sources

def test_synth_rfm_groups_and_determinism(spark):
    a = synth_rfm(spark, 500, 42)
    sizes = {r["true_group"]: r["count"] for r in a.groupBy("true_group").count().collect()}
    assert sizes == {"loyal high value": 100, "at risk high value": 150, "new": 125, "lost": 125}
    rng = a.groupBy("true_group").agg(F.min("recency"), F.max("recency")).collect()
    assert all(r[1] >= 1 and r[2] <= 120 for r in rng)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, synth_rfm(spark, 500, 42).collect()))
    assert a.select("customer_id").first()[0] == "CUST00001"


def test_synth_rfm_depends_on_the_row_alone(spark):
    from storelens.sources.io import draw_rfm

    whole = {tuple(r) for r in synth_rfm(spark, 2000, 7, 3).collect()}
    assert whole == {tuple(r) for r in synth_rfm(spark, 2000, 7, 16).collect()}
    assert whole != {tuple(r) for r in synth_rfm(spark, 2000, 8, 3).collect()}
    some = draw_rfm(spark.range(100, 110).unionAll(spark.range(105, 106)), "id", 2000, 7)
    assert {(r.recency, r.monetary) for r in some.collect()} <= {(r[1], r[3]) for r in whole}
    null = draw_rfm(spark.createDataFrame([(None,)], "id long"), "id", 10).first()
    assert tuple(null) == (None,) * 5
    new = np.array([r[3] for r in synth_rfm(spark, 20000, 7).where("true_group = 'new'").collect()])
    # a normal of mean 80 and deviation 20 cut at 50 and 150
    assert abs(new.mean() - 80.6) < 1.0 and 17.5 < new.std() < 20.0


def test_dataset_profile_samples_different_texts(spark):
    rows = [(1.0, "FR", "same")] * 50 + [(2.0, "DE", f"text {i}") for i in range(3)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "price double, country string, text string")
    got = PR.dataset_profile(df, "price", "country", "text")
    assert sorted(r[0] for r in got["sample"].collect()) == ["same", "text 0", "text 1", "text 2"]
    assert got["stats"].first()["count"] == 53
    empty = PR.dataset_profile(df.limit(0), "price", "country", "text")
    assert empty["sample"].count() == 0 and empty["countries"].count() == 0


def test_stable_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r[0] for r in C.stable_sample(df, "k", 50, 7).collect()]
    b = [r[0] for r in C.stable_sample(df.repartition(7), "k", 50, 7).collect()]
    assert len(a) == 50 and a == b


# ---------------------------------------------------------------- clustering

def _blobs(n=90, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 1, (n // 3, 2)), rng.normal(8, 1, (n // 3, 2)), rng.normal((0, 10), 1, (n // 3, 2))])


def test_kmeans_many_recovers_blobs(spark):
    x = _blobs(150)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    best = best_models(kmeans_many(df, ["a", "b"], [2, 3], 4, 42))
    lab = best[3].assign(df, ["a", "b"]).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in lab) == [50, 50, 50]
    d = ((x[:, None, :] - best[3].centers[None]) ** 2).sum(-1).min(1).sum()
    assert math.isclose(d, best[3].inertia, rel_tol=1e-9)
    assert best[2].inertia > best[3].inertia


def test_kmeans_many_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(4).normal(0, 1, (400, 2)).round(2)
    rows = [(float(a), float(b)) for a, b in x] + [(0.25, -0.5)] * 300 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    fits = [kmeans_many(d, ["a", "b"], [2, 4], 3, 42) for d in (df.repartition(1), df.repartition(6), df.orderBy("b"))]
    for other in fits[1:]:
        for one, two in zip(fits[0], other):
            assert one.inertia == two.inertia and one.n_iter == two.n_iter and (one.centers == two.centers).all()
    hot = np.array([r for r in rows if r[0] is not None])
    for fit in fits[0]:
        near = ((hot[:, None, :] - fit.centers[None]) ** 2).sum(-1)
        assert math.isclose(near.min(1).sum(), fit.inertia, rel_tol=1e-9)
        for c in range(fit.k):  # each centre is the mean of its rows, copies counted
            assert np.allclose(hot[near.argmin(1) == c].mean(0), fit.centers[c], atol=0.05)


def test_choose_k_formula(spark):
    sweep = spark.createDataFrame([(2, 100.0, 0.5), (3, 40.0, 0.6), (4, 35.0, 0.55), (5, 33.0, 0.4)],
                                  "k int, inertia double, silhouette double")
    sil = np.array([0.5, 0.6, 0.55, 0.4])
    d = np.diff([100.0, 40.0, 35.0, 33.0])
    d = np.append(d, d[-1])
    exp = max([2, 3, 4, 5][int(np.argmax(sil / sil.max() + d / d.max()))], 3)
    assert CL.choose_k(sweep).first()["k"] == exp


def test_ward_matches_naive():
    x = _blobs(45, 2)
    lab, merges = CL.ward_merge(x, np.ones(len(x)), 3)
    assert len(merges) == len(x) - 3 and sorted(np.bincount(lab)) == [15, 15, 15]


def test_silhouette_and_knn_brute_force(spark):
    x = _blobs(60, 5)
    lab = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([(i, [float(a), float(b)], int(l)) for i, ((a, b), l) in enumerate(zip(x, lab))],
                               "id long, features array<double>, label long")
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    got = EV.silhouette(df, "id", "features", "label", block_rows=16).first()["silhouette"]
    assert math.isclose(got, float(np.mean(s)), rel_tol=1e-9)
    nn = NB.knn_join(df, df, 3, exclude_self=True, block_rows=16).orderBy("query_id", "rank").collect()
    for q in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[q])) if j != q][:3]
        assert [r["neighbor_id"] for r in nn if r["query_id"] == q] == order
    eps = {r["id"]: r["n_within"] for r in NB.eps_counts(df, 1.5, block_rows=16).collect()}
    assert all(eps[i] == int((d[i] <= 1.5).sum()) for i in range(len(x)))


def test_gmm_information_formula():
    info = CL.gmm_information(-100.0, 50, 3, 2, "full")
    p = 3 * 2 + 2 + 3 * 3
    assert info["params"] == p and math.isclose(info["bic"], p * math.log(50) + 200)


def test_segment_report_and_insights(spark):
    st = spark.createDataFrame(
        [(0, "Champions", 10, 50.0, 5.0, 8.0, 300.0), (1, "Lost Customers", 10, 50.0, 90.0, 1.0, 20.0)],
        "segment_id int, segment_name string, count long, percentage double, avg_recency double, "
        "avg_frequency double, avg_monetary double")
    ins = SG.segment_insights(st).orderBy("segment_id").collect()
    assert ins[0]["strategy"] == SG.STRATEGY_DEFAULT
    assert ins[1]["description"].startswith("Cluster 1: This segment contains 10 customers (50.0% of total)")
    rep = SG.segment_report(ins and SG.segment_insights(st)).first()
    assert rep["report"].startswith("# Customer Segmentation Report")
    assert rep["summary"].splitlines() == ["- Champions: 10 customers (50.0%)", "- Lost Customers: 10 customers (50.0%)"]


def _dbscan_brute(x, eps, min_samples):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))
    adj = d <= eps
    core = adj.sum(1) >= min_samples
    comp = -np.ones(len(x), dtype=int)
    for i in np.flatnonzero(core):
        if comp[i] >= 0:
            continue
        stack, members = [i], []
        comp[i] = i
        while stack:
            j = stack.pop()
            members.append(j)
            for k in np.flatnonzero(adj[j] & core):
                if comp[k] < 0:
                    comp[k] = i
                    stack.append(k)
        m = min(members)
        comp[members] = m
    lab = comp.copy()
    for i in np.flatnonzero(~core):
        nb = np.flatnonzero(adj[i] & core)
        lab[i] = comp[nb].min() if len(nb) else -1
    order = {v: r for r, v in enumerate(sorted(set(lab[lab >= 0])))}
    return np.array([order[v] if v >= 0 else -1 for v in lab])


def test_dbscan_matches_brute_force(spark):
    from storelens.operators.dbscan import dbscan

    rng = np.random.default_rng(11)
    x = np.vstack([_blobs(90, 4), rng.uniform(-5, 15, (12, 2))])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)],
                               "id long, features array<double>")
    exp = _dbscan_brute(x, 1.2, 4)
    got = {r["id"]: r["dbscan_cluster"] for r in dbscan(df, 1.2, 4, block_rows=32).collect()}
    assert [got[i] for i in range(len(x))] == exp.tolist()


def test_sources_and_sinks(spark, tmp_path):
    from storelens.sources.io import load_rfm, read_parts, segments_json, write_csv, write_outputs

    a = spark.createDataFrame([(1, "x", 2.0)], "invoice long, description string, price double")
    b = spark.createDataFrame([(2, 3.0)], "invoice long, price double")
    u = read_parts(spark, {"2009": a, "2010": b}).orderBy("invoice").collect()
    assert u[1]["description"] is None and [r["_part"] for r in u] == ["2009", "2010"]
    rfm = spark.createDataFrame([(1, 5, 2, 10.0)], "`Customer ID` long, Recency int, Frequency long, Monetary double")
    paths = write_outputs({"rfm": rfm}, str(tmp_path))
    got = load_rfm(spark, paths[0] + "/")
    assert got.columns[:4] == ["customer_id", "recency", "frequency", "monetary"]
    with pytest.raises(ValueError):
        load_rfm(spark, str(tmp_path / "x.json"))
    write_csv(rfm, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    st = spark.createDataFrame([(0, "Champions", 3, 100.0, "d", "s")],
                               "segment_id int, segment_name string, count long, percentage double, "
                               "description string, strategy string")
    import json

    doc = json.loads(segments_json(st).first()["json"])
    assert doc["num_customers"] == 3 and doc["segments"]["0"]["segment_name"] == "Champions"
    assert doc["descriptions"] == {"0": "d"} and "timestamp" in doc


def test_to_wide_pivot(spark):
    from storelens.operators.cohort import to_wide

    long = spark.createDataFrame([("2010-01", 0, 10), ("2010-01", 1, 4), ("2010-02", 0, 7)],
                                 "cohort string, idx int, active long")
    w = {r["cohort"]: r for r in to_wide(long, "cohort", "idx", "active", [0, 1]).collect()}
    assert w["2010-01"]["0"] == 10 and w["2010-01"]["1"] == 4 and w["2010-02"]["1"] is None


def test_pca_scores_centred(spark):
    from storelens.operators.features import pca_scores

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.2]]) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out, ratio = pca_scores(df, ["a", "b", "c"], 2)
    m = out.agg(F.avg("PC1"), F.avg("PC2")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9
    cov = np.cov((x - x.mean(0)).T)
    ev = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert np.allclose(ratio, (ev / ev.sum())[:2], atol=1e-9)


def test_resample_gap_fill_and_min_periods(spark):
    from storelens.operators.timeseries import moving_avg, resample_daily

    rows = [(1, dt.date(2024, 1, 1), 10.0), (1, dt.date(2024, 1, 4), 5.0), (2, dt.date(2024, 1, 2), 1.0)]
    df = spark.createDataFrame(rows, "store long, date date, sales double")
    r = resample_daily(df, "date", "sales", keys=["store"])
    got = sorted((x["store"], str(x["date"]), x["sales"]) for x in r.collect())
    assert got == [(1, "2024-01-01", 10.0), (1, "2024-01-02", 0.0), (1, "2024-01-03", 0.0),
                   (1, "2024-01-04", 5.0), (2, "2024-01-02", 1.0)]
    ma = {(x["store"], str(x["date"])): x["sales_ma3"]
          for x in moving_avg(r, "date", "sales", 3, keys=["store"]).collect()}
    assert ma[(1, "2024-01-02")] is None and ma[(1, "2024-01-03")] == 10.0 / 3 and ma[(2, "2024-01-02")] is None


def test_components_follow_a_long_chain(spark):
    from storelens.operators.components import connected_components

    n = 1000
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b").unionByName(
        spark.createDataFrame([(5000, 5001), (5001, 5000), (7000, 7000), (None, 3)], "a long, b long"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 5000: 5000, 5001: 5000, 7000: 7000}


def test_knn_ties_take_the_smallest_ids(spark):
    from storelens.operators.neighbors import eps_counts, knn_join

    same = spark.range(40).selectExpr("id", "array(0.1D, 0.2D, 0.3D) AS features")
    got = knn_join(same, same, 5).where("query_id = 17").orderBy("rank").collect()
    assert [r.neighbor_id for r in got] == [0, 1, 2, 3, 4]
    grid = spark.range(400).selectExpr("id", "array((id % 20) * 0.1D, (id div 20) * 0.1D) AS features")
    pts = {r.id: r.features for r in grid.collect()}
    want = {i: sum(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 <= 0.1 for q in pts.values()) for i, p in pts.items()}
    assert {r.id: r.n_within for r in eps_counts(grid, 0.1).collect()} == want
    assert all(r.n_within == 1 for r in eps_counts(grid, 0.0).collect())


def test_money_keeps_more_than_two_decimals(spark):
    from pyspark.sql import functions as F
    from storelens.functions.exprs import money

    df = spark.createDataFrame([(0.125,)] * 3 + [(0.004,)], "x double")
    assert float(df.agg(F.sum(money("x")).alias("s")).first().s) == 0.379


def _norms(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("d,eps", [(1, 0.3), (2, 0.5), (3, 0.7), (5, 1.1)])
def test_range_join_on_a_grid_is_exact(spark, d, eps):
    from storelens.operators.grid import eps_counts

    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(150, d)), rng.integers(-4, 5, (150, d)) * 0.1, np.zeros((60, d)),
                        rng.normal(size=(40, d)) * 1e6, -np.zeros((2, d))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    acc = np.zeros((len(x), len(x)))
    for j in range(d):
        diff = x[:, None, j] - x[None, :, j]
        acc += diff * diff
    want = (np.sqrt(acc) <= eps).sum(1)
    for cell_rows in (16, 1024):  # with and without salted cells
        assert {r.id: r.n_within for r in eps_counts(df, eps, block_rows=cell_rows).collect()} == dict(enumerate(want))


def test_range_join_meets_as_many_rows_a_point_at_any_size(spark):
    from storelens.operators.grid import Grid, near_pairs, weighted_vectors

    met = {}
    for n in (1000, 4000):
        side = int(n ** 0.5)  # a square of constant density
        df = spark.range(n).selectExpr("id", f"array((id % {side}) * 1.0D, (id div {side}) * 1.0D) AS features")
        v = weighted_vectors(df)
        met[n] = near_pairs(v.select("v"), v.selectExpr("v AS u"), Grid.of(v, 2.5), 2.5).count() / n
        assert Grid.of(v, 2.5).side < 2.6
    assert met[4000] < 1.2 * met[1000]


def test_dbscan_with_copies_chains_and_salted_cells(spark):
    from storelens.operators.dbscan import dbscan

    rng = np.random.default_rng(9)
    chain = np.stack([np.arange(60) * 0.9, np.zeros(60)], 1)
    x = np.concatenate([chain, chain + [0, 30], rng.normal(size=(80, 2)) * 0.3 + [70, 0], np.repeat([[90.0, 90.0]], 12, 0),
                        rng.uniform(100, 200, (15, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    for min_samples in (2, 3, 6):
        exp = _dbscan_brute(x, 1.0, min_samples)
        for cell_rows in (8, 1024):
            got = {r["id"]: r["dbscan_cluster"] for r in dbscan(df, 1.0, min_samples, block_rows=cell_rows).collect()}
            assert got == dict(enumerate(exp))
    assert dbscan(df.limit(0), 1.0, 2).count() == 0


def test_pivots_rule_out_cells_without_losing_neighbours(spark):
    from storelens.operators import neighbors as NB

    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(60, 4)) + c for c in (0, 40, 80, 200)] + [np.zeros((20, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    d = _norms(x, x)
    seen = []
    plain = NB.cell_pairs
    try:
        NB.cell_pairs = lambda *a: seen.append((len(a[1]) * len(a[2]), plain(*a))) or seen[-1][1]
        for exclude in (False, True):
            got = NB.knn_join(df, df, 4, exclude_self=exclude, block_rows=32, pivot_rows=20).collect()
            for i in range(len(x)):
                order = sorted((v, j) for j, v in enumerate(d[i]) if not exclude or j != i)[:4]
                mine = sorted((r.rank, r.neighbor_id, r.distance) for r in got if r.query_id == i)
                assert [m[0] for m in mine] == [1, 2, 3, 4]
                assert np.allclose([m[2] for m in mine], [o[0] for o in order], atol=1e-9)
                assert [m[1] for m in mine] == [o[1] for o in order] or np.isclose(order[-1][0], order[0][0], atol=1e-9)
    finally:
        NB.cell_pairs = plain
    every, kept = seen[0]
    assert len(kept) < 0.5 * every  # clusters far apart never meet
    few = NB.knn_join(df.limit(3), df.limit(3), 5, exclude_self=True).groupBy("query_id").count().collect()
    assert all(r["count"] == 2 for r in few)
    assert NB.knn_join(df, df.limit(0), 5).count() == 0


def test_numbers_follow_the_order_over_partitions(spark):
    from storelens.functions.ordering import numbered

    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, id % 3) AS g", "(id * 7919) % 3000 AS v").repartition(7)
    got = numbered(df, ["v"], ["g"]).collect()
    for g in (None, 1, 2):
        own = sorted((r.order, r.v) for r in got if r.g == g)
        assert [o for o, _ in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: x[1])
    assert [r.n for r in numbered(df, ["v"], out="n").orderBy("v").select("n").collect()] == list(range(1, 3001))
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_silhouettes_of_a_sweep_take_one_pair_pass(spark, monkeypatch):
    from storelens.operators import neighbors as NB

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(70, 3)) + c for c in (0, 4)] + [np.ones((25, 3))])
    rows = [(i, [float(v) for v in r], *[int((r[0] * 3 + i) // 1) % k for k in (1, 2, 3, 7)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, features array<double>, k1 int, k2 int, k3 int, k7 int")
    passes = []
    plain = NB.block_pairs
    monkeypatch.setattr(NB, "block_pairs", lambda *a, **b: passes.append(1) or plain(*a, **b))
    got = EV.silhouettes(df, ["k1", "k2", "k3", "k7"], block_rows=32)
    assert len(passes) == 1 and got["k1"] == 0.0
    for c in ("k2", "k3", "k7"):
        assert got[c] == pytest.approx(EV.silhouette(df, "id", "features", c).first()["silhouette"], abs=1e-9)
    assert EV.silhouettes(df.limit(0), ["k2"]) == {"k2": None}


def test_mixtures_of_all_types_and_starts_advance_together(spark):
    from storelens.operators import mixture as M

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(120, 2)) * s + c for c, s in (((0, 0), 1), ((9, 3), 0.5), ((-6, 8), 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "customer_id long, a double, b double")
    kinds = ("full", "tied", "diag", "spherical")
    models, n = M.fit_mixtures(df.repartition(3), ["a", "b"], 3, kinds, n_init=4, chunk_rows=64)
    again, _ = M.fit_mixtures(df.orderBy(F.desc("a")).repartition(7), ["a", "b"], 3, kinds, n_init=4, chunk_rows=64)
    assert n == 360 and len(models) == 16 and all(m.done for m in models)
    for m, o in zip(models, again):  # any partitioning gives the same bits
        assert m.log_likelihood == o.log_likelihood and (m.means == o.means).all()
        assert all(b >= a - 1e-6 for a, b in zip(m.trace, m.trace[1:]))
    for m in models:  # EM on the driver from the same start
        one = M.Mixture(m.covariance, m.start, np.full(3, 1 / 3), *_start(x, m, df))
        while not one.done:
            one = M.updated(one, M.statistics(x, one), n, 1e-3)
        assert one.log_likelihood == pytest.approx(m.log_likelihood, rel=1e-9) and one.steps == m.steps
    best = M.best_mixtures(models)
    assert [m.covariance for m in best] == list(kinds)
    assert best[0].log_likelihood == max(m.log_likelihood for m in models if m.covariance == "full")
    assert sorted(np.round(best[0].weights, 1).tolist()) == [0.3, 0.3, 0.3]
    assert M.fit_mixtures(df.limit(0), ["a", "b"])[0] == []


def _start(x, m, df):
    from storelens.operators import mixture as M

    ids = [r.customer_id for r in df.withColumn("h", F.xxhash64(F.lit(42), F.lit(m.start), "customer_id")).orderBy("h").limit(3)
           .collect()]
    cov = np.cov(x.T, bias=True) + M.RIDGE * np.eye(2)
    v = np.diag(cov)
    return x[ids], {"full": np.tile(cov, (3, 1, 1)), "tied": cov, "diag": np.tile(v, (3, 1)),
                    "spherical": np.full(3, v.mean())}[m.covariance]


def test_python_round_is_the_exact_one(spark):
    from storelens.functions.exprs import python_round

    rng = np.random.default_rng(1)
    xs = [2.675, 1.005, 0.125, 2.5, 0.5, 1.5, -2.675, -0.125, 1e300, 5e15 + 0.5, 0.285, 1.115, 8.345, 0.0, 1e-9, -1.005]
    xs += [float(x) for x in rng.integers(0, 10**6, 3000) / 1000 + 0.005] + [float(x) for x in rng.normal(size=2000) * 1e4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2, 6):
        got = [r[0] for r in df.select(python_round("x", d)).collect()]
        assert got == [float(round(x, d)) for x in xs]


def test_bootstrap_intervals_do_not_depend_on_partitions(spark):
    from storelens.operators import profile as PR

    rng = np.random.default_rng(4)
    rows = [(i, None if i % 5 == 0 else "ab"[i % 2], float(x)) for i, x in enumerate(rng.gamma(2.0, 50.0, 900))]
    rows += [(1000, "a", None), (1001, "c", -3.25)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = PR.mean_ci(df.repartition(5), "g", "v", 100, "id").collect()
    again = PR.mean_ci(df.coalesce(1), "g", "v", 100, "id").collect()
    assert {(r.g, r.ci_lo, r.ci_hi) for r in got} == {(r.g, r.ci_lo, r.ci_hi) for r in again}
    for r in got:
        own = np.array([(k, v) for k, g, v in rows if g == r.g and v is not None])
        means = []
        for rep in range(100):
            w = PR.poisson_weights(own[:, 0].astype(np.int64), rep)
            if w.sum():
                means.append((w * np.round(own[:, 1] * 1e6)).sum() / 1e6 / w.sum())
        lo, hi = np.quantile(means, [0.025, 0.975])
        assert r.ci_lo == pytest.approx(lo, rel=1e-9) and r.ci_hi == pytest.approx(hi, rel=1e-9)
        assert r.ci_lo <= r["mean"] <= r.ci_hi or len(own) < 2
    w = PR.poisson_weights(np.arange(200_000), 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def test_two_dimensional_density_integrates_to_one(spark):
    from storelens.operators import profile as PR

    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([3, -2], [[4, 3], [3, 9]], 800)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0)], "a double, b double")
    k = PR.kde_2d(df, "a", "b", 50, 80).toPandas()
    dx, dy = np.diff(sorted(k.x.unique())).mean(), np.diff(sorted(k.y.unique())).mean()
    assert len(k) == 2500 and (k.density.sum() * dx * dy) == pytest.approx(1.0, abs=0.02)
    cov = np.cov(x.T) * len(x) ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 2 * math.pi * np.linalg.det(cov) ** 0.5 * len(x)
    for _, r in k.sample(40, random_state=1).iterrows():  # unbinned
        d = np.array([r.x, r.y]) - x
        want = np.exp(-0.5 * np.einsum("ia,ab,ib->i", d, inv, d)).sum() / norm
        assert r.density == pytest.approx(want, rel=0.05, abs=1e-4)
    assert PR.kde_2d(df.limit(1), "a", "b").count() == 0
    assert PR.kde_2d(df.selectExpr("a", "2 * a AS b"), "a", "b").count() == 0


def test_quantiles_of_a_null_group_and_a_hot_one(spark):
    rng = np.random.default_rng(12)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "x", float(v)) for i, v in enumerate(rng.normal(size=4000).round(2))]
    df = spark.createDataFrame(rows + [("one", 5.0), ("none", None)], "g string, v double")
    for fast in (0, 1 << 20):
        got = {r.g: r for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.975, 1.0], ["g"], num_partitions=6,
                                               fast_path_rows=fast).collect()}
        assert set(got) == {None, "hot", "x", "one"}
        for g, r in got.items():
            own = [v for k, v in rows + [("one", 5.0)] if k == g]
            assert r.n == len(own) and list(r[1:6]) == pytest.approx(np.quantile(own, [0, 0.25, 0.5, 0.975, 1]).tolist(), abs=1e-12)


def test_bunches_of_cells_hold_about_a_block(spark):
    from storelens.operators.neighbors import bunches

    rng = np.random.default_rng(3)
    pivots, sizes = rng.normal(size=(200, 8)), {i: int(n) for i, n in enumerate(rng.integers(1, 600, 200))}
    got = bunches(pivots, sizes, 2048)
    rows = {}
    for c, g in got.items():
        rows[g] = rows.get(g, 0) + sizes[c]
    assert set(got) == set(sizes) and max(rows.values()) <= 2048
    assert len(rows) <= 2 * sum(sizes.values()) / 2048 + 1
    assert bunches(pivots, {}, 2048) == {} and bunches(pivots, {7: 9000, 8: 1}, 2048) == {7: 0, 8: 1}


def test_blocks_of_a_pair_plan_grow_with_the_rows(spark):
    import pyarrow as pa

    rows = spark.range(400).selectExpr("id AS _id", "array(id * 1.0D, 0.0D) AS _v")

    def fn(lp, rp):
        return pa.table({"_id": lp["_id"], "n": np.full(len(lp), float(len(rp)))})

    few = NB.block_pairs(rows.limit(9), rows.limit(9), fn, NB.sum_schema(["n"]), ["_v"], 2, 9, 9, 2)  # some blocks empty
    assert {r.n for r in few.groupBy("_id").agg(F.sum("n").alias("n")).collect()} == {9.0}
    met = NB.block_pairs(rows, rows, fn, NB.sum_schema(["n"]), ["_v"], 4, 400, 400, 2).groupBy("_id").agg(
        F.count("*").alias("copies"), F.sum("n").alias("n")).collect()
    assert len(met) == 400 and all(r.n == 400 and r.copies <= NB.SHARES for r in met)  # before: 100 copies
    assert 615_000 / NB.block_size(615_000, 64) <= NB.SHARES and NB.block_size(10 ** 9, 64) * 64 <= NB.BLOCK_NUMBERS


def test_label_sums_match_brute_force():
    rng = np.random.default_rng(1)
    a, b, w, g = rng.normal(size=(300, 3)), rng.normal(size=(2500, 3)), rng.integers(1, 4, 2500) * 1.0, rng.integers(0, 5, 2500)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    want = np.stack([(d * np.where(g == k, w, 0)).sum(1) for k in range(5)], 1)
    assert np.allclose(NB.label_sums(a, b, w, g, 5), want, rtol=1e-9)


def test_neighbour_blocks_grow_with_the_rows(spark, monkeypatch):
    """Copies, repeated ids and many blocks: the nearest as by brute force, from at most SHARES bunches."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(500, 6)), np.repeat(rng.normal(size=(3, 6)), 40, 0)])
    ids = np.concatenate([np.arange(len(x)), [3, 3, 519, 519, 519]])
    x = x[ids]
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id long, features array<double>")
    sizes = []
    plain = NB.bunches
    monkeypatch.setattr(NB, "bunches", lambda p, s, r: sizes.append((sum(s.values()), r)) or plain(p, s, r))
    got = NB.knn_join(df, df, 4, exclude_self=True, block_rows=8, pivot_rows=10).distinct().collect()
    assert sizes[0][0] / sizes[0][1] <= NB.SHARES  # before: bunches of block_rows
    d = _norms(x, x)
    for q in set(ids.tolist()):
        order = sorted((v, int(i)) for v, i in zip(d[int(np.flatnonzero(ids == q)[0])], ids) if i != q)
        mine = sorted((r.rank, r.distance, r.neighbor_id) for r in got if r.query_id == q)
        assert np.allclose(sorted({r[1] for r in mine}), sorted({m for m in (o[0] for o in order) if m <= mine[-1][1] + 1e-12}), atol=1e-9)
        if q >= 500 and q not in (519,):
            assert all(r[1] == 0 for r in mine)


def test_crowded_cells_make_few_blocks_and_no_pairs(spark, monkeypatch):
    """Counts, links and borders of a crowd come from blocks, not from row pairs; vectors
    that miss a coordinate lie near nothing."""
    from storelens.operators import dbscan as D
    from storelens.operators import grid as G

    def pairs(*_a, **_k):
        raise AssertionError("row pairs")  # before: near_pairs

    monkeypatch.setattr(G, "near_pairs", pairs)
    monkeypatch.setattr(D, "near_pairs", pairs, raising=False)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 2)) * 0.4, rng.normal(size=(60, 2)) * 0.4 + [6, 0], rng.uniform(-9, 9, (25, 2))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + [(1000, [None, 1.0]), (1001, [0.0, None])], "id long, features array<double>")
    want = (_norms(x, x) <= 0.9).sum(1)
    assert {r.id: r.n_within for r in G.eps_counts(df, 0.9, block_rows=8).collect()} == dict(enumerate(want.tolist()))
    for min_samples in (3, 40):
        exp = _dbscan_brute(x, 0.9, min_samples).tolist()
        got = {r["id"]: r["dbscan_cluster"] for r in D.dbscan(df, 0.9, min_samples, block_rows=8).collect()}
        assert [got[i] for i in range(len(x))] == exp and got[1000] == got[1001] == -1


def test_statistics_of_all_models_match_their_formula():
    from storelens.operators import mixture as M

    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 3)) * [1, 2, 0.5] + [3, 0, -1]  # more rows than a slice
    cov = np.cov(x.T)
    spread = {"full": np.stack([cov, 2 * cov]), "tied": cov, "diag": np.stack([np.diag(cov)] * 2), "spherical": np.array([1.0, 3.0])}
    models = [M.Mixture(c, 0, np.array([0.3, 0.7]), x[:2], s) for c, s in spread.items()]
    for m, got in zip(models, M.all_statistics(x, models)):
        full = {"full": lambda j: m.spread[j], "tied": lambda j: m.spread, "diag": lambda j: np.diag(m.spread[j]),
                "spherical": lambda j: m.spread[j] * np.eye(3)}[m.covariance]
        p = np.stack([m.weights[j] * np.exp(-0.5 * np.einsum("ia,ab,ib->i", x - m.means[j], np.linalg.inv(full(j)), x - m.means[j]))
                      / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(full(j))) for j in range(2)], 1)
        share = p / p.sum(1, keepdims=True)
        want = np.concatenate([[np.log(p.sum(1)).sum()], share.sum(0), (share.T @ x).ravel(),
                               np.einsum("ij,ia,ib->jab", share, x, x).ravel()])
        assert np.allclose(got, want, rtol=1e-9) and np.allclose(M.statistics(x, m), got, rtol=1e-12)
