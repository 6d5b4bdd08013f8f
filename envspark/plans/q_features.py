"""Queries: window operators, series features, events (2.5, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.operators import features, spectral, windows
from envspark.plans.catalog import register
from envspark.sources.views import view

COLS = ["temperature", "humidity"]
KEYS = ["source_id"]
W = "(PARTITION BY source_id ORDER BY ts, id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
WO = "(PARTITION BY source_id ORDER BY ts, id)"


def R(spark, sf):
    return view(spark, sf, "readings").select("id", "source_id", "ts", *COLS)


def _roll_sql(c):
    full = f"count({c}) OVER {W} = 24"
    mean, std = f"avg({c}) OVER {W}", f"stddev_samp({c}) OVER {W}"
    return (f"CASE WHEN {full} THEN {mean} END AS {c}_rolling_mean, "
            f"CASE WHEN {full} THEN {std} END AS {c}_rolling_std, "
            f"CASE WHEN {full} THEN min({c}) OVER {W} END AS {c}_rolling_min, "
            f"CASE WHEN {full} THEN max({c}) OVER {W} END AS {c}_rolling_max, "
            f"CASE WHEN {full} THEN quantile_cont({c}, 0.5) OVER {W} END AS {c}_rolling_median, "
            f"CASE WHEN {full} AND {mean} <> 0 THEN {std} / {mean} END AS {c}_volatility")


_ROLL = f"SELECT id, source_id, ts, temperature, humidity, {_roll_sql('temperature')}, {_roll_sql('humidity')} FROM readings"
_ROLL_COLS = [f"{c}_{k}" for c in COLS for k in ("rolling_mean", "rolling_std", "rolling_min", "rolling_max",
                                                    "rolling_median", "volatility")]


@register("w1_rolling_stats", _ROLL, ["readings"], rnd=_ROLL_COLS)
def w1(spark, sf):
    return windows.rolling_stats(R(spark, sf), COLS, 24, KEYS)


@register("w1_rolling_stats_chunked", _ROLL, ["readings"], rnd=_ROLL_COLS)
def w1c(spark, sf):
    """Same result computed with each series cut into 1-day chunks + halo."""
    return windows.rolling_stats(R(spark, sf), COLS, 24, KEYS, chunk="1d")


def _pct_sql(c):
    f = f"last_value({c} IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"{f} AS __f_{c}"


_PCT = ("SELECT id, source_id, ts, temperature, humidity, " + ", ".join(
    f"CASE WHEN lag(__f_{c}) OVER {WO} IS NULL OR __f_{c} IS NULL THEN NULL "
    f"ELSE __f_{c} / lag(__f_{c}) OVER {WO} - 1 END AS {c}_pct_change" for c in COLS)
    + f" FROM (SELECT *, {_pct_sql('temperature')}, {_pct_sql('humidity')} FROM readings)")


@register("w2_pct_change", _PCT, ["readings"], rnd=[f"{c}_pct_change" for c in COLS])
def w2(spark, sf):
    return windows.pct_change(R(spark, sf), COLS, KEYS)


def _ewma_sql(span, cols=COLS):
    """Weighted sums over the list of all rows up to each row (no window of a
    fixed number of rows), the variance from the deviations."""
    d = 1.0 - 2.0 / (span + 1.0)
    src = ("(SELECT *, " + ", ".join(
        f"list({c}) OVER (PARTITION BY source_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l_{c}"
        for c in cols) + " FROM readings)")

    def total(c, e):
        return (f"list_sum(list_transform(range(len(l_{c})), lambda i: CASE WHEN l_{c}[i + 1] IS NOT NULL THEN "
                f"pow({d!r}, len(l_{c}) - 1 - i) * ({e}) END))")
    mean = ", ".join(f"{total(c, '1')} AS w_{c}, {total(c, f'l_{c}[i + 1]')} / {total(c, '1')} AS m_{c}, "
                     f"{total(c, f'pow({d!r}, len(l_{c}) - 1 - i)')} AS q_{c}" for c in cols)
    var = ", ".join(f"{total(c, f'pow(l_{c}[i + 1] - m_{c}, 2)')} AS v_{c}" for c in cols)
    out = ", ".join(f"m_{c} AS {c}_ewma, CASE WHEN w_{c} * w_{c} - q_{c} > w_{c} * w_{c} * 1e-12 "
                    f"THEN sqrt(v_{c} / w_{c} / (1 - q_{c} / (w_{c} * w_{c}))) END AS {c}_ewmstd" for c in cols)
    return (f"SELECT id, source_id, ts, temperature, humidity, {out} FROM (SELECT *, {var} FROM "
            f"(SELECT *, {mean} FROM {src}))")


_EWM_COLS = [f"{c}_{k}" for c in COLS for k in ("ewma", "ewmstd")]


@register("w4_ewma", _ewma_sql(30), ["readings"], rnd=_EWM_COLS)
def w4(spark, sf):
    return windows.ewma(R(spark, sf), COLS, 30.0, KEYS)


@register("w4_ewma_span365", _ewma_sql(365), ["readings"], rnd=_EWM_COLS)
def w4_long(spark, sf):
    """Short blocks, so that states are chained over many of them."""
    return windows.ewma(R(spark, sf), COLS, 365.0, KEYS, block=16)


_SEQ = ("SELECT source_id, ts AS start_ts, list_slice(w, 1, 6) AS sequence, list_slice(w, 7, 7) AS target FROM "
        "(SELECT source_id, ts, list(humidity) OVER (PARTITION BY source_id ORDER BY ts, id "
        "ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS w, "
        "row_number() OVER (PARTITION BY source_id ORDER BY ts, id) - 1 AS pos FROM readings) "
        "WHERE len(w) = 7 AND pos % 2 = 0")


@register("w6_make_sequences", _SEQ, ["readings"])
def w6(spark, sf):
    return windows.make_sequences(R(spark, sf), 6, 1, 2, ["humidity"], None, KEYS)


_SEQ_T = ("SELECT source_id, ts AS start_ts, list_slice(f, 1, 4) AS sequence, list_slice(t, 5, 6) AS target FROM "
          "(SELECT source_id, ts, list(humidity) OVER w AS f, list(humidity * 2 + 1) OVER w AS t, "
          "row_number() OVER (PARTITION BY source_id ORDER BY ts, id) - 1 AS pos FROM readings "
          "WINDOW w AS (PARTITION BY source_id ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) "
          "WHERE len(f) = 6 AND pos % 3 = 0")


@register("w6_make_sequences_target", _SEQ_T, ["readings"])
def w6t(spark, sf):
    """Features with a separate target column (excluded from the features)."""
    r = R(spark, sf).withColumn("level", F.col("humidity") * 2 + 1)
    return windows.make_sequences(r, 4, 2, 3, ["humidity", "level"], "level", KEYS)


@register("w7_zero_crossings",
          "SELECT source_id, count_if(s <> p) AS h_zero_crossings FROM (SELECT source_id, h < 0 AS s, "
          "lag(h < 0) OVER (PARTITION BY source_id ORDER BY ts, id) AS p FROM "
          "(SELECT source_id, ts, id, humidity - 50 AS h FROM readings)) GROUP BY source_id",
          ["readings"])
def w7(spark, sf):
    r = view(spark, sf, "readings").select("id", "source_id", "ts", (F.col("humidity") - 50).alias("h"))
    return windows.zero_crossings(r, ["h"], KEYS)


@register("w8_autocorr_lag1",
          "SELECT source_id, corr(humidity, l) AS humidity_autocorr_lag1 FROM (SELECT source_id, humidity, "
          "lag(humidity) OVER (PARTITION BY source_id ORDER BY ts, id) AS l FROM readings) GROUP BY source_id",
          ["readings"], rnd=["humidity_autocorr_lag1"])
def w8(spark, sf):
    return windows.autocorr_lag1(R(spark, sf), ["humidity"], KEYS)


_LAST = ("SELECT source_id, humidity AS x, n - rd AS pos, n FROM (SELECT source_id, humidity, "
         "row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS rd, "
         "count(*) OVER (PARTITION BY source_id) AS n0, least(count(*) OVER (PARTITION BY source_id), 24) AS n "
         "FROM readings) WHERE rd <= 24")


_N1 = (f"SELECT source_id, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, "
       f"quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, "
       f"quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, regr_slope(x, CAST(pos AS DOUBLE)) AS trend_slope, "
       f"regr_intercept(x, CAST(pos AS DOUBLE)) AS trend_intercept FROM ({_LAST}) GROUP BY source_id")


@register("n1_window_features", _N1,
          ["readings"], rnd=["mean", "std", "min", "max", "median", "q25", "q75", "iqr", "trend_slope",
                             "trend_intercept"])
def n1(spark, sf):
    return features.window_features(R(spark, sf), "humidity", 24, KEYS)


_ENT = (f"WITH l AS ({_LAST}), "
        "b AS (SELECT source_id, x, least(10, n // 2) AS bins, "
        "CASE WHEN min(x) OVER p = max(x) OVER p THEN min(x) OVER p - 0.5 ELSE min(x) OVER p END AS lo, "
        "CASE WHEN min(x) OVER p = max(x) OVER p THEN max(x) OVER p + 0.5 ELSE max(x) OVER p END AS hi, n "
        "FROM l WINDOW p AS (PARTITION BY source_id)), "
        "c AS (SELECT source_id, n, least(CAST(floor((x - lo) / (hi - lo) * bins) AS INTEGER), bins - 1) AS bin, "
        "count(*) AS cnt FROM b GROUP BY ALL) "
        "SELECT source_id, n, -sum((cnt / n) * ln(cnt / n + 1e-10)) AS entropy FROM c GROUP BY source_id, n")


@register("n5_hist_entropy", _ENT, ["readings"], rnd=["entropy"])
def n5(spark, sf):
    return features.series_shape_features(R(spark, sf), "humidity", 24, KEYS).select("source_id", "n", "entropy")


def _haar_level(a):
    """DuckDB list expressions for one Haar level of list column ``a``:
    (detail energy, approximation list); odd lengths repeat the last sample."""
    x0 = f"{a}[2 * k + 1]"
    x1 = f"{a}[least(2 * k + 2, len({a}))]"
    rng = f"range((len({a}) + 1) // 2)"
    d = f"list_sum(list_transform({rng}, lambda k: pow(({x0} - {x1}) / sqrt(2), 2)))"
    nxt = f"list_transform({rng}, lambda k: ({x0} + {x1}) / sqrt(2))"
    return d, nxt


_D1, _A1 = _haar_level("a0")
_D2, _A2 = _haar_level("a1")
_D3, _A3 = _haar_level("a2")
_N3 = (f"WITH w AS (SELECT source_id, count(*) AS n, list(x ORDER BY pos) AS a0 FROM ({_LAST}) GROUP BY source_id), "
       f"l1 AS (SELECT *, least(3, CAST(floor(log2(n)) AS INTEGER)) AS lvl, {_D1} AS d1, {_A1} AS a1 FROM w), "
       f"l2 AS (SELECT *, {_D2} AS d2, {_A2} AS a2 FROM l1), "
       f"l3 AS (SELECT *, {_D3} AS d3, {_A3} AS a3 FROM l2) "
       "SELECT source_id, n, CASE lvl WHEN 0 THEN list_sum(list_transform(a0, lambda v: v * v)) "
       "WHEN 1 THEN d1 + list_sum(list_transform(a1, lambda v: v * v)) "
       "WHEN 2 THEN d1 + d2 + list_sum(list_transform(a2, lambda v: v * v)) "
       "ELSE d1 + d2 + d3 + list_sum(list_transform(a3, lambda v: v * v)) END AS wavelet_energy, "
       "CAST(list_sum(list_transform(range(1, len(a0)), lambda i: CASE WHEN (a0[i] < 0) <> (a0[i + 1] < 0) "
       "THEN 1 ELSE 0 END)) AS INTEGER) AS zero_crossings FROM l3")


@register("n3_wavelet_energy", _N3, ["readings"], rnd=["wavelet_energy"])
def n3(spark, sf):
    return features.series_shape_features(R(spark, sf), "humidity", 24, KEYS).select(
        "source_id", "n", "wavelet_energy", "zero_crossings")


# Welch with one segment (n <= 256): periodic Hann window w, mean-detrended
# y = (x - mean) * w, one-sided density PSD.  Its sum is n * sum(y^2) / sum(w^2)
# (Parseval); the dominant frequency is the first argmax of |DFT|^2 over
# k = 0..n/2 (doubling of the interior bins does not move a strict maximum
# away from them, so it is applied before the argmax as well).
_WELCH = (
    f"WITH w AS (SELECT source_id, list(x ORDER BY pos) AS a FROM ({_LAST}) GROUP BY source_id), "
    "h AS (SELECT source_id, a, len(a) AS n, list_avg(a) AS m, list_transform(range(len(a)), "
    "lambda j: 0.5 - 0.5 * cos(2 * pi() * j / len(a))) AS win FROM w), "
    "y AS (SELECT *, list_transform(range(n), lambda j: (a[j + 1] - m) * win[j + 1]) AS yy FROM h), "
    "p AS (SELECT *, list_transform(range(n // 2 + 1), lambda k: (CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END) * "
    "(pow(list_sum(list_transform(range(n), lambda j: yy[j + 1] * cos(2 * pi() * j * k / n))), 2) + "
    "pow(list_sum(list_transform(range(n), lambda j: yy[j + 1] * sin(2 * pi() * j * k / n))), 2))) AS ps FROM y) "
    "SELECT source_id, n * list_sum(list_transform(yy, lambda v: v * v)) / list_sum(list_transform(win, lambda v: v * v)) "
    "AS spectral_energy, CAST(list_position(ps, list_max(ps)) - 1 AS DOUBLE) / n AS dominant_freq FROM p")


@register("n4_welch_spectrum", _WELCH, ["readings"], rnd=["spectral_energy", "dominant_freq"])
def n4(spark, sf):
    return features.welch_features(R(spark, sf), "humidity", 24, KEYS)


_DFT = ("list_transform(range({n}), lambda k: sqrt(pow(list_sum(list_transform(range({n}), lambda j: "
        "a[j + 1] * cos(2 * pi() * j * k / {n}))), 2) + pow(list_sum(list_transform(range({n}), lambda j: "
        "a[j + 1] * sin(2 * pi() * j * k / {n}))), 2)))")
_FFT = (
    "WITH f AS (SELECT source_id, date_trunc('month', ts) AS fr, list(COALESCE(humidity, 0.0) ORDER BY ts, id) AS a, "
    "count(*) AS n FROM readings GROUP BY ALL), "
    f"m AS (SELECT *, {_DFT.format(n='n')} AS mag FROM f), "
    "s AS (SELECT *, list_slice(mag, 2, n // 2 + 1) AS pos, list_sum(list_transform(mag, lambda v: v * v)) AS tot FROM m), "
    "r AS (SELECT source_id, fr, CAST(list_position(pos, list_max(pos)) AS DOUBLE) / n AS humidity_dominant_freq, "
    "list_max(pos) AS humidity_dominant_power, -list_sum(list_transform(mag, lambda v: (v * v / tot) * "
    "log2(v * v / tot + 1e-10))) AS humidity_spectral_entropy FROM s) "
    "SELECT x.id, x.source_id, x.ts, x.temperature, x.humidity, r.humidity_dominant_freq, r.humidity_dominant_power, "
    "r.humidity_spectral_entropy FROM readings x JOIN r ON x.source_id = r.source_id AND date_trunc('month', x.ts) = r.fr")


@register("n6_fft_features", _FFT, ["readings"],
          rnd=["humidity_dominant_freq", "humidity_dominant_power", "humidity_spectral_entropy"])
def n6(spark, sf):
    return spectral.fft_features(R(spark, sf), ["humidity"], KEYS, "ts", "month")


def _cal_sql():
    return ("CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, "
            "CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month, "
            "isodow(ts) >= 6 AS is_weekend")


_N7_COLS = ["hour", "day_of_week", "day_of_month", "month", "is_weekend", *_ROLL_COLS,
            "temperature_pct_change", "humidity_pct_change"]
_N7 = (f"SELECT source_id, ts, {', '.join(_N7_COLS)} FROM (SELECT *, {_cal_sql()} FROM (SELECT r.source_id, r.ts, "
       + ", ".join(f"r.{c}" for c in _ROLL_COLS) + ", p.temperature_pct_change, p.humidity_pct_change "
       f"FROM ({_ROLL}) r JOIN ({_PCT}) p ON r.id = p.id)) WHERE "
       + " AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in _N7_COLS if c != "is_weekend"))


@register("n7_extract_features", _N7, ["readings"], rnd=[*_ROLL_COLS, "temperature_pct_change", "humidity_pct_change"])
def n7(spark, sf):
    return features.extract_features(R(spark, sf), COLS, 24, KEYS)


_AC = (f"SELECT source_id, CASE WHEN count(*) > 2 THEN corr(x, xl) END AS autocorr_lag1 FROM (SELECT source_id, x, "
       f"lag(x) OVER (PARTITION BY source_id ORDER BY pos) AS xl FROM ({_LAST})) GROUP BY source_id")
_N8 = ("SELECT a.*, b.wavelet_energy, e.entropy, b.zero_crossings, w.spectral_energy, w.dominant_freq, c.autocorr_lag1 "
       f"FROM ({_N1}) a JOIN ({_N3}) b USING (source_id) JOIN ({_ENT}) e USING (source_id) "
       f"JOIN ({_WELCH}) w USING (source_id) JOIN ({_AC}) c USING (source_id)")


@register("n8_all_window_features", _N8, ["readings"],
          rnd=["mean", "std", "min", "max", "median", "q25", "q75", "iqr", "trend_slope", "trend_intercept",
               "wavelet_energy", "entropy", "spectral_energy", "dominant_freq", "autocorr_lag1"])
def n8(spark, sf):
    return features.all_window_features(R(spark, sf), "humidity", 24, KEYS)


def _n12_sql(span, k):
    flags = ", ".join(f"COALESCE(abs({c} - {c}_ewma) > {k} * {c}_ewmstd, false) AS anomaly_{c}" for c in COLS)
    return f"SELECT id, source_id, ts, temperature, humidity, {flags} FROM ({_ewma_sql(span)})"


@register("n12_ewma_anomalies", _n12_sql(30, 2.0), ["readings"])
def n12(spark, sf):
    return features.ewma_anomalies(R(spark, sf), COLS, 30.0, 2.0, KEYS)


@register("n12_ewma_anomalies_span365", _n12_sql(365, 1.5), ["readings"])
def n12_long(spark, sf):
    return features.ewma_anomalies(R(spark, sf), COLS, 365.0, 1.5, KEYS)


_N15 = " UNION ALL ".join(
    f"SELECT r.source_id, '{c}' AS \"column\", r.ts, r.{c} AS value, 'threshold' AS method, t.th AS threshold "
    f"FROM readings r JOIN (SELECT source_id, avg({c}) + 2.0 * stddev_samp({c}) AS th FROM readings GROUP BY 1) t "
    f"ON r.source_id = t.source_id WHERE r.{c} > t.th" for c in COLS)


@register("n15_threshold_events", _N15, ["readings"], rnd=["value", "threshold"])
def n15(spark, sf):
    return features.threshold_events(R(spark, sf), COLS, 2.0, KEYS)
