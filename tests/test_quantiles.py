"""Skew-safe exact quantiles against numpy (ties, hot key, refinement)."""

import numpy as np
import pytest

from envspark.operators.quantiles import exact_quantile_table, exact_quantiles

RNG = np.random.default_rng(21)
PS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small", [1_000_000, 50])
def test_exact_quantiles_match_numpy(spark, small):
    hot = RNG.normal(0, 1, 3000)
    ties = np.repeat([1.0, 2.0, 2.0, 3.0], 200)
    rows = [(0, float(v)) for v in hot] + [(1, float(v)) for v in ties] + [(2, 5.0)] + [(3, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r["k"]: r for r in exact_quantiles(df, "v", PS, ["k"], buckets=16, small=small).collect()}
    for k, arr in ((0, hot), (1, ties), (2, np.array([5.0]))):
        want = np.percentile(arr, [p * 100 for p in PS])
        assert np.allclose([got[k][f"v_q{i}"] for i in range(len(PS))], want, rtol=0, atol=1e-12), k
    assert 3 not in got                            # only nulls: no row


def test_exact_quantiles_unkeyed(spark):
    v = RNG.integers(0, 50, 2000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = exact_quantiles(df, "v", [0.25, 0.75], buckets=8, small=30).first()
    assert np.allclose([r["v_q0"], r["v_q1"]], np.percentile(v, [25, 75]))


def test_heavy_hitter_with_values_on_both_sides(spark):
    """99 % of a key's values are equal; several columns and a null key."""
    rng = np.random.default_rng(5)
    n = 20_000
    a = np.full(n, 7.0)
    a[:100] = rng.normal(0, 1, 100)
    a[100:200] = rng.normal(50, 1, 100)
    b = rng.normal(0, 1, n)
    c = np.where(rng.random(n) < 0.5, 3.0, np.floor(rng.normal(0, 3, n)))
    rows = [(None if i % 4 == 0 else 1, float(x), None if i % 3 == 0 else float(y), float(z))
            for i, (x, y, z) in enumerate(zip(a, b, c))] + [(5, None, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    ps = [0.0, 0.001, 0.004, 0.5, 0.996, 0.9999, 1.0]
    for small in (1_000_000, 100):
        got = {r["k"]: r for r in exact_quantile_table(df, ["a", "b", "c"], ps, ["k"], buckets=8, small=small).collect()}
        for key in (None, 1):
            at = np.array([i for i, r in enumerate(rows) if r[0] == key])
            for name, col in (("a", 1), ("b", 2), ("c", 3)):
                v = np.array([rows[i][col] for i in at if rows[i][col] is not None])
                want = np.percentile(v, [100 * p for p in ps])
                assert np.allclose([got[key][f"{name}_q{i}"] for i in range(len(ps))], want, rtol=1e-12, atol=1e-10), (key, name)
        assert got[5]["a_q0"] is None and got[5]["c_q3"] == 1.0 and len(got) == 3


def test_selection_never_sorts_a_group(spark):
    """No plan node orders or gathers the values of a group: the only windows
    are over the counts of one interval."""
    from unittest import mock

    from envspark.operators import quantiles
    plans = []

    def noting(df, _cut=quantiles.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return _cut(df)
    df = spark.range(5000).selectExpr("double(if(id % 100 = 0, id, 7)) as v")
    with mock.patch.object(quantiles, "stored", noting):
        r = exact_quantiles(df, "v", [0.5, 0.999], buckets=8, small=10).first()
    v = np.where(np.arange(5000) % 100 == 0, np.arange(5000), 7).astype(float)
    assert np.allclose([r["v_q0"], r["v_q1"]], np.percentile(v, [50, 99.9]))
    assert plans and not any("row_number" in p or "collect_list" in p or " percentile(" in p for p in plans)
