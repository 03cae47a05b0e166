"""Hypothesis properties: exact quantiles against numpy on random inputs,
through both the fast path and the bucketed path."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from storelens.functions.quantile import exact_quantiles

values = st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=60)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, groups=st.integers(1, 3), p=st.sampled_from([0.0, 0.01, 0.25, 0.5, 0.9, 1.0]),
       fast=st.booleans())
def test_quantiles_match_numpy(spark, vals, groups, p, fast):
    rows = [(i % groups, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["q"] for r in
           exact_quantiles(df, "v", [p], ["g"], names=["q"], num_partitions=3,
                           fast_path_rows=10_000 if fast else 0).collect()}
    for g in range(groups):
        sub = [v for i, v in enumerate(vals) if i % groups == g]
        if not sub:
            assert g not in got
            continue
        exp = float(np.quantile(np.array(sub), p))
        assert abs(got[g] - exp) <= 1e-9 * max(1.0, abs(exp))
