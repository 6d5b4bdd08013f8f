"""Window features, spectral features and detectors against NumPy, and
statistical invariants on planted anomalies / steps / peaks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.operators import detectors, features, models, spectral
from envspark.operators.features import _welch_np

RNG = np.random.default_rng(11)


def _series(spark, vals, key=1, step_min=60):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(key, t0 + dt.timedelta(minutes=step_min * i), None if v is None else float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "source_id long, ts timestamp_ntz, v double")


def _np_haar_energy(x, max_level=3):
    a = np.asarray(x, float)
    level = min(max_level, int(np.floor(np.log2(len(a)))))
    e = 0.0
    for _ in range(level):
        if len(a) % 2:
            a = np.append(a, a[-1])            # symmetric extension of one sample
        d = (a[0::2] - a[1::2]) / math.sqrt(2)
        a = (a[0::2] + a[1::2]) / math.sqrt(2)
        e += (d ** 2).sum()
    return e + (a ** 2).sum()


def _np_entropy(x):
    bins = min(10, len(x) // 2)
    h, _ = np.histogram(x, bins=bins)
    p = h / h.sum()
    return -np.sum(p * np.log(p + 1e-10))


@pytest.mark.parametrize("n", [24, 20, 13, 7])
def test_shape_features_match_numpy(spark, n):
    x = RNG.normal(0, 1, 40)
    got = features.series_shape_features(_series(spark, x), "v", n).first()
    last = x[-n:]
    assert got["n"] == n
    assert math.isclose(got["wavelet_energy"], _np_haar_energy(last), rel_tol=1e-12)
    assert math.isclose(got["entropy"], _np_entropy(last), rel_tol=1e-9, abs_tol=1e-12)
    assert got["zero_crossings"] == len(np.where(np.diff(np.signbit(last)))[0])


def test_window_features_match_numpy(spark):
    x = RNG.normal(5, 2, 50)
    g = features.window_features(_series(spark, x), "v", 24).first()
    last = x[-24:]
    slope, intercept = np.polyfit(np.arange(24), last, 1)
    assert math.isclose(g["mean"], last.mean(), rel_tol=1e-12)
    assert math.isclose(g["std"], last.std(ddof=1), rel_tol=1e-12)
    assert math.isclose(g["median"], np.median(last), rel_tol=1e-12)
    assert math.isclose(g["iqr"], np.percentile(last, 75) - np.percentile(last, 25), rel_tol=1e-12)
    assert math.isclose(g["trend_slope"], slope, rel_tol=1e-9)
    assert math.isclose(g["trend_intercept"], intercept, rel_tol=1e-9)


def test_welch_single_segment_is_periodogram():
    x = RNG.normal(0, 1, 24)
    e, f = _welch_np(x)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(24) / 24)
    p = np.abs(np.fft.rfft((x - x.mean()) * win)) ** 2 / (win ** 2).sum()
    p[1:-1] *= 2
    assert math.isclose(e, p.sum(), rel_tol=1e-12)
    assert f == np.fft.rfftfreq(24)[np.argmax(p)]


def test_fft_features_per_frame(spark):
    n = 64
    x = np.sin(2 * np.pi * 8 * np.arange(n) / n)
    df = _series(spark, x, step_min=10)
    out = spectral.fft_features(df, ["v"], ["source_id"], "ts", "day", order_col=None).first()
    assert math.isclose(abs(out["v_dominant_freq"]), 8 / n, rel_tol=1e-12)
    assert math.isclose(out["v_dominant_power"], n / 2, rel_tol=1e-9)


def test_threshold_events(spark):
    x = np.zeros(50)
    x[10] = 100.0
    ev = features.threshold_events(_series(spark, x), ["v"], 3.0).collect()
    assert len(ev) == 1 and ev[0]["value"] == 100.0


def test_isolation_forest_finds_planted_outliers(spark):
    X = RNG.normal(0, 1, (2000, 2))
    X[:10] += 8.0
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = detectors.isolation_forest(df, ["a", "b"], contamination=0.005).toPandas()
    flagged = set(out.loc[out.anomaly, "id"])
    assert set(range(10)) <= flagged and len(flagged) <= 15
    top = out.sort_values("score", ascending=False).id.head(10)
    assert set(top) == set(range(10))


def test_cosine_of_the_svm_features():
    x = np.r_[np.random.default_rng(3).normal(0, 20, 20_000), np.linspace(-1e5, 1e5, 4001), 0.0, np.nan]
    got = detectors._cosine(x.copy())
    assert np.isnan(got[-1]) and np.abs(got[:-1] - np.cos(x[:-1])).max() < 1e-15


def test_one_class_svm_flag_share(spark):
    X = RNG.normal(0, 1, (1500, 2))
    X[:5] = [[7, 7], [-7, 7], [7, -7], [-7, -7], [9, 0]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, a double, b double")
    out = detectors.one_class_svm(df, ["a", "b"], nu=0.05, iterations=40).toPandas()
    share = out.anomaly.mean()
    assert 0.03 <= share <= 0.07
    assert out.loc[out.id < 5, "anomaly"].all()


def test_pelt_finds_planted_step():
    x = np.concatenate([np.zeros(50), np.full(50, 10.0)]) + RNG.normal(0, 0.1, 100)
    assert detectors.pelt_l2(x, pen=10.0, min_size=2, jump=5) == [50]


def test_cwt_finds_planted_peaks():
    t = np.arange(400)
    x = np.exp(-((t - 100) / 6.0) ** 2) + np.exp(-((t - 300) / 6.0) ** 2) + RNG.normal(0, 0.01, 400)
    peaks = detectors.cwt_peaks((x - x.mean()) / x.std())
    assert any(abs(p - 100) <= 2 for p in peaks) and any(abs(p - 300) <= 2 for p in peaks)


def test_series_events_distributed(spark):
    x = np.concatenate([np.zeros(40), np.full(40, 5.0)]) + RNG.normal(0, 0.05, 80)
    df = _series(spark, x)
    ev = detectors.change_points(df, ["v"], frame="month").collect()
    assert len(ev) == 1 and ev[0]["ts"] == dt.datetime(2024, 1, 1) + dt.timedelta(hours=40)


def test_kmeans_and_meanshift(spark):
    from envspark.operators import raster_models
    pts = np.concatenate([RNG.normal(0.1, 0.02, (50, 2)), RNG.normal(0.9, 0.02, (50, 2))])
    df = spark.createDataFrame([(0, i // 10, i % 10, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "image_id long, row long, col long, a double, b double")
    km, cost = models.segment_kmeans(df, ["a", "b"], k=2)
    labs = km.orderBy("row", "col").toPandas().segment.to_numpy()
    assert len(set(labs[:50])) == 1 and len(set(labs[50:])) == 1 and labs[0] != labs[-1]
    inertia = sum(((p - p.mean(0)) ** 2).sum() for p in (pts[:50], pts[50:]))
    assert np.isclose(cost.first()["cost"], inertia)
    ms = raster_models.segment_meanshift(df, ["a", "b"], bandwidth=0.3).orderBy("row", "col").toPandas().segment
    assert ms.nunique() == 2 and ms.iloc[0] != ms.iloc[-1]


def test_score_uses_user_model(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")

    def make():
        return lambda X: X.sum(axis=1)
    got = [r["prediction"] for r in models.score(df, make, ["a", "b"]).collect()]
    assert got == [3.0, 7.0]


def test_unknown_methods_raise(spark):
    df = _series(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        detectors.detect_multivariate(df, "lof", ["v"])
    from envspark.operators import anomaly
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(df, "mad", ["v"])
    assert F is not None


def test_reconstruction_score_flags_off_plane_pixel(spark):
    t = RNG.normal(0, 1, 200)
    pts = np.stack([t, 2 * t, -t], axis=1) + RNG.normal(0, 0.01, (200, 3))
    pts[17] = [0.0, 3.0, 3.0]                          # off the dominant line
    rows = [(0, i // 20, i % 20, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "image_id long, row long, col long, a double, b double, c double")
    out = models.reconstruction_score(df, ["a", "b", "c"], k=1).toPandas()
    top = out.sort_values("score", ascending=False).iloc[0]
    assert (top.row, top.col) == (0, 17) and abs(top.score - 1.0) < 1e-6 and out.score.min() >= 0


def test_slic_segments_follow_colour_halves(spark):
    from envspark.operators import raster_models
    rows = [(0, r, c, 0.1 if c < 8 else 0.9) for r in range(8) for c in range(16)]
    df = spark.createDataFrame(rows, "image_id long, row long, col long, g double")
    seg = raster_models.segment_slic(df, ["g"], n_segments=2, compactness=0.1, iterations=5).toPandas()
    left = set(seg[seg.col < 8].segment)
    right = set(seg[seg.col >= 8].segment)
    assert len(left) == 1 and len(right) == 1 and left != right


def test_ewma_anomalies_planted_spike(spark):
    x = list(RNG.normal(10, 0.5, 80))
    x[60] = 30.0
    out = features.ewma_anomalies(_series(spark, x), ["v"], 30.0, 3.0).orderBy("ts").toPandas()
    assert bool(out.anomaly_v.iloc[60]) and out.anomaly_v.sum() <= 2


def test_cwt_events_find_peaks_on_frame_borders(spark):
    n = 720                                            # five days of 10-minute readings
    t = np.arange(n)
    planted = [144, 287, 433, 575]                     # on / next to day borders
    x = sum(np.exp(-((t - p) / 4.0) ** 2) for p in planted) + RNG.normal(0, 0.01, n)
    df = _series(spark, x, step_min=10)
    ev = detectors.cwt_events(df, ["v"], frame="day").toPandas()
    t0 = dt.datetime(2024, 1, 1)
    found = sorted(int((ts - t0).total_seconds() // 600) for ts in ev.ts)
    for p in planted:
        assert any(abs(f - p) <= 2 for f in found), (p, found)
    assert len(found) == len(set(found))             # no peak reported twice by two frames


def test_change_point_on_frame_border(spark):
    x = np.concatenate([np.zeros(144), np.full(144, 6.0)]) + RNG.normal(0, 0.05, 288)   # step at a day border
    ev = detectors.change_points(_series(spark, x, step_min=10), ["v"], frame="day").collect()
    assert [r["ts"] for r in ev] == [dt.datetime(2024, 1, 2)]


def test_cwt_events_row_blocks_match_calendar_frames(spark):
    n = 720
    t = np.arange(n)
    x = sum(np.exp(-((t - p) / 4.0) ** 2) for p in (100, 144, 400, 650)) + RNG.normal(0, 0.01, n)
    df = _series(spark, x, step_min=10)
    by_day = sorted(r["ts"] for r in detectors.cwt_events(df, ["v"], frame="day").collect())
    by_rows = sorted(r["ts"] for r in detectors.cwt_events(df, ["v"], frame=300).collect())
    assert by_day == by_rows and len(by_day) >= 4
