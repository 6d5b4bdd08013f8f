"""Series cleaning and window operators against pandas / NumPy written from
the published definitions (hand-made frames)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from envspark.operators import series, windows


def _frame(spark, rows, schema="source_id long, ts timestamp_ntz, v double"):
    return spark.createDataFrame(rows, schema)


def T(h, m=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)


OFF_GRID = [(1, T(0, 0), 1.0), (1, T(0, 40), 2.0), (1, T(1, 10), 3.0), (1, T(3, 0), 4.0)]


def _vals(df, col="v"):
    return [None if (x is None or x != x) else round(x, 9) for x in df.orderBy("ts").toPandas()[col].tolist()]


def test_resample_mean_gaps(spark):
    df = _frame(spark, OFF_GRID)
    out = series.resample_mean(df, "1h", ["v"], ["source_id"])
    assert _vals(out) == [1.5, 3.0, None, 4.0]


def test_resample_asfreq_grid(spark):
    df = _frame(spark, OFF_GRID)
    out = series.resample_asfreq(df, "1h", ["v"], ["source_id"])
    assert _vals(out) == [1.0, None, None, 4.0]


def test_preprocess_ffill_matches_asof(spark):
    df = _frame(spark, OFF_GRID)
    out = series.preprocess_series(df, "1h", "ffill", ["v"], ["source_id"])
    assert _vals(out) == [1.0, 2.0, 3.0, 4.0]
    out = series.preprocess_series(df, "1h", "bfill", ["v"], ["source_id"])
    assert _vals(out) == [1.0, 3.0, 4.0, 4.0]


def test_resample_duplicates_on_grid_fail(spark):
    df = _frame(spark, [(1, T(0), 1.0), (1, T(0), 2.0), (1, T(1), 3.0)])
    with pytest.raises(Exception):
        series.resample_asfreq(df, "1h", ["v"], ["source_id"]).collect()


GAPS = [None, None, 1.0, None, None, 4.0, 5.0, None, 9.0, None, None]


def _gap_frame(spark, vals=GAPS, key=1):
    return _frame(spark, [(key, T(i), v) for i, v in enumerate(vals)])


@pytest.mark.parametrize("method", ["linear", "ffill", "bfill", "mean", "median", "zero"])
def test_fills_match_pandas(spark, method):
    df = _gap_frame(spark)
    got = _vals(series.fill(df, method, ["v"], ["source_id"]))
    s = pd.Series(GAPS, dtype=float)
    want = {"linear": s.interpolate(method="linear"), "ffill": s.ffill(), "bfill": s.bfill(),
            "mean": s.fillna(s.mean()), "median": s.fillna(s.median()), "zero": s.fillna(0)}[method]
    want = [None if np.isnan(x) else round(x, 9) for x in want]
    assert got == want


def test_unknown_fill_raises(spark):
    with pytest.raises(ValueError):
        series.fill(_gap_frame(spark), "cubic", ["v"], ["source_id"])


def test_scalers(spark):
    vals = [1.0, 2.0, None, 4.0, 10.0]
    df = _frame(spark, [(1, T(i), v) for i, v in enumerate(vals)] + [(2, T(i), 5.0) for i in range(3)])
    x = np.array([v for v in vals if v is not None])
    std = _vals(series.scale(df, "standard", ["v"], ["source_id"]).where("source_id = 1"))
    want = [None if v is None else round((v - x.mean()) / x.std(), 9) for v in vals]
    assert std == want
    mm = _vals(series.scale(df, "minmax", ["v"], ["source_id"]).where("source_id = 1"))
    assert mm == [None if v is None else round((v - 1) / 9, 9) for v in vals]
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    rb = _vals(series.scale(df, "robust", ["v"], ["source_id"]).where("source_id = 1"))
    assert rb == [None if v is None else round((v - q2) / (q3 - q1), 9) for v in vals]
    const = _vals(series.scale(df, "standard", ["v"], ["source_id"]).where("source_id = 2"))
    assert const == [0.0, 0.0, 0.0]            # zero std -> divisor 1
    with pytest.raises(ValueError):
        series.scale(df, "log", ["v"], ["source_id"])


def _random_series(spark, n=300, seed=0, nulls=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(25, 5, n)
    if nulls:
        v[rng.random(n) < 0.1] = np.nan
    rows = [(1, T(0) + dt.timedelta(minutes=7 * i), None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    return _frame(spark, rows), pd.Series(v)


@pytest.mark.parametrize("span", [1, 2, 30, 365, 2000])
@pytest.mark.parametrize("block, chunk", [(None, "range"), (64, "range"), (7, "1h")])
def test_ewma_matches_pandas(spark, span, block, chunk):
    """Every span, with runs of missing values that reach over block borders
    and a small variation on a large level."""
    rng = np.random.default_rng(3)
    v = 1000.0 + rng.normal(0, 0.01, 900)
    v[rng.random(900) < 0.2] = np.nan
    v[:5] = v[100:300] = v[620:650] = np.nan
    w = rng.normal(0, 5, 900)
    rows = [(1, T(0) + dt.timedelta(minutes=7 * i), *(None if np.isnan(x) else float(x) for x in p))
            for i, p in enumerate(zip(v, w))] + [(2, T(1), None, 4.0), (None, T(1), 3.0, None), (None, T(2), 5.0, 1.0)]
    df = spark.createDataFrame(rows, "source_id long, ts timestamp_ntz, v double, w double").repartition(5)
    got = windows.ewma(df, ["v", "w"], span, ["source_id"], block=block, chunk=chunk).toPandas()
    assert len(got) == len(rows)
    one = got[got.source_id == 1].sort_values("ts")
    for c, x in (("v", v), ("w", w)):
        s = pd.Series(x)
        mean, std = s.ewm(span=span).mean().to_numpy(), s.ewm(span=span).std().to_numpy()
        w = (1 - 2 / (span + 1)) ** np.arange(len(x), dtype=float)
        shares = np.full(len(x), np.nan)               # 1 - sum w^2 / (sum w)^2; pandas loses it to rounding when small
        for t in range(len(x)):
            u = w[t::-1][~np.isnan(x[:t + 1])] if t else w[:1][~np.isnan(x[:1])]
            u = u / u.sum() if u.sum() > 0 else u
            shares[t] = 2 * (u[1:] * np.cumsum(u)[:-1]).sum() if len(u) else np.nan
        std[shares < 1e-9] = np.nan
        one.loc[(shares < 1e-9).tolist(), f"{c}_ewmstd"] = None
        assert np.allclose(one[f"{c}_ewma"].to_numpy(dtype=float), mean, rtol=1e-12, atol=1e-12, equal_nan=True)
        assert np.allclose(one[f"{c}_ewmstd"].to_numpy(dtype=float), std, rtol=1e-6, atol=1e-9, equal_nan=True)
    none = got[got.source_id.isna()].sort_values("ts")
    assert np.allclose(none.v_ewma.to_numpy(dtype=float), pd.Series([3.0, 5.0]).ewm(span=span).mean())
    assert got[got.source_id == 2].v_ewma.isna().all()


def test_ewma_unkeyed_and_long_gap(spark):
    """A value, 3000 missing ones, another value; no task holds the series."""
    v = [5.0] + [None] * 3000 + [9.0, None]
    df = spark.createDataFrame([(T(0) + dt.timedelta(seconds=i), x) for i, x in enumerate(v)], "ts timestamp_ntz, v double")
    for span in (2.0, 30.0):
        got = windows.ewma(df, ["v"], span, [], block=16).orderBy("ts").toPandas()["v_ewma"].to_numpy(dtype=float)
        assert np.allclose(got, pd.Series(v, dtype=float).ewm(span=span).mean().to_numpy(), rtol=1e-12)
    with pytest.raises(ValueError):
        windows.ewma(df, ["v"], 0.5, [])


def test_ewma_triple(spark):
    df = _frame(spark, [(1, T(0), 1.0), (1, T(1), 2.0), (1, T(2), 4.0)])
    got = windows.ewma(df, ["v"], 30.0, ["source_id"]).orderBy("ts").toPandas()
    assert np.allclose(got["v_ewma"], [1.0, 1.51667, 2.40022], atol=1e-5)
    assert np.isnan(got["v_ewmstd"].iloc[0]) and np.allclose(got["v_ewmstd"].iloc[1:], [0.70711, 1.53787], atol=1e-5)


@pytest.mark.parametrize("chunk", [None, "1h", "3h"])
def test_rolling_matches_pandas(spark, chunk):
    df, s = _random_series(spark, 240)
    got = windows.rolling_stats(df, ["v"], 24, ["source_id"], chunk=chunk).orderBy("ts").toPandas()
    r = s.rolling(24)
    for name, want in (("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("max", r.max()),
                       ("median", r.median())):
        assert np.allclose(got[f"v_rolling_{name}"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True), name
    assert len(got) == 240


@pytest.mark.parametrize("chunk", ["1d", "1h", "2h"])
def test_pct_change_matches_pandas(spark, chunk):
    vals = [1.0, 2.0, None, None, None, 4.0, 0.0, 3.0, 0.0, 0.0, None, -2.0]
    df = _frame(spark, [(1, T(i), v) for i, v in enumerate(vals)])
    got = windows.pct_change(df, ["v"], ["source_id"], chunk=chunk).orderBy("ts").toPandas()["v_pct_change"] \
        .to_numpy(dtype=float)
    want = pd.Series(vals, dtype=float).ffill().pct_change().to_numpy()
    assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("chunk", ["1h", "1d"])
def test_crossings_and_autocorr_across_chunks(spark, chunk):
    x = np.array([1.0, -2.0, 3.0, None, -1.0, -4.0, 2.0, 5.0, -3.0, 1.0], dtype=float)
    df = _frame(spark, [(1, T(i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)])
    zc = windows.zero_crossings(df, ["v"], ["source_id"], chunk=chunk).first()["v_zero_crossings"]
    sb = x < 0
    want = sum(1 for i in range(1, len(x)) if not np.isnan(x[i]) and not np.isnan(x[i - 1]) and sb[i] != sb[i - 1])
    assert zc == want
    ac = windows.autocorr_lag1(df, ["v"], ["source_id"], chunk=chunk).first()["v_autocorr_lag1"]
    assert np.isclose(ac, pd.Series(x).autocorr(1))


def test_make_sequences_count(spark):
    n, s, t, step = 20, 5, 2, 3
    df = _frame(spark, [(1, T(i), float(i)) for i in range(n)])
    got = windows.make_sequences(df, s, t, step, ["v"], None, ["source_id"]).orderBy("start_ts").toPandas()
    starts = list(range(0, n - s - t + 1, step))
    assert len(got) == (n - s - t) // step + 1 == len(starts)
    for row, i in zip(got.itertuples(), starts):
        assert list(row.sequence) == [float(x) for x in range(i, i + s)]
        assert list(row.target) == [float(x) for x in range(i + s, i + s + t)]


def test_chunked_rows_indices_are_dense(spark):
    df, _ = _random_series(spark, 100, nulls=False)
    parts = windows.chunked_rows(df, ["source_id"], "ts", 5, "1h").where("not __halo").toPandas()
    assert sorted(parts["__idx"]) == list(range(100))


def test_short_chunks_copy_few_rows(spark):
    """Chunks of one row each are merged: the halos are a fraction of the rows,
    also of a series without a key, and the windows stay those of the series."""
    rows = [(k, T(i), float((i * 7919) % 101)) for k in (1, None) for i in range(400)]
    df = _frame(spark, rows)
    parts = windows.chunked_rows(df, ["source_id"], "ts", 9, "1h")
    assert parts.where("not __halo").count() == 800
    assert 0 < parts.where("__halo").count() <= 800 / windows.MERGED
    got = windows.rolling_stats(df, ["v"], 10, ["source_id"], chunk="1h")
    want = windows.rolling_stats(df, ["v"], 10, ["source_id"], chunk=None)
    assert got.count() == 800 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("method", ["ffill", "bfill", "linear", "mean"])
def test_preprocess_series_matches_pandas_with_nulls(spark, method):
    rows = [(T(0, 0), 1.0), (T(0, 40), None), (T(1, 10), 3.0), (T(2, 0), None), (T(2, 30), 5.0),
            (T(5, 0), None), (T(6, 20), 2.0), (T(9, 0), 7.0)]
    df = _frame(spark, [(1, t, v) for t, v in rows])
    got = _vals(series.preprocess_series(df, "1h", method, ["v"], ["source_id"]))
    s = pd.Series([np.nan if v is None else v for _, v in rows], index=pd.DatetimeIndex([t for t, _ in rows]))
    r = s.resample("1h")
    want = {"ffill": r.ffill(), "bfill": r.bfill(), "mean": r.mean(),
            "linear": r.asfreq().interpolate(method="linear")}[method].ffill().bfill()
    assert got == [round(x, 9) for x in want]
