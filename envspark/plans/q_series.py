"""Queries for series cleaning, scaling, anomaly flags and the flagship."""

from __future__ import annotations

from envspark.operators import anomaly, series
from envspark.plans import sqlgen as S
from envspark.plans.catalog import register
from envspark.plans.monitor import monitor
from envspark.sources.views import view

COLS = ["temperature", "humidity"]
KEYS = ["source_id"]
H1, H6 = 3600, 6 * 3600


def _readings(spark, sf):
    return view(spark, sf, "readings")


def _raw_sql():
    return "SELECT source_id, ts, temperature, humidity FROM readings"


R6 = S.resample_mean("readings", H6, COLS, KEYS)


@register("p1_resample_mean", R6, ["readings"], rnd=COLS)
def p1(spark, sf):
    return series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS)


_ASFREQ_SQL = (f"SELECT g.source_id, g.ts, r.temperature, r.humidity FROM ({S.grid('readings', H1, KEYS)}) g "
               f"LEFT JOIN (SELECT source_id, ts, temperature, humidity FROM readings "
               f"WHERE ts = {S.bin_expr(H1)}) r ON g.source_id = r.source_id AND g.ts = r.ts")


@register("p2_resample_asfreq", _ASFREQ_SQL, ["readings"], rnd=COLS)
def p2(spark, sf):
    return series.resample_asfreq(_readings(spark, sf), "1h", COLS, KEYS)


@register("p3_fill_linear", S.fill_linear(R6, COLS, KEYS), ["readings"], rnd=COLS)
def p3(spark, sf):
    return series.fill_linear(series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS), COLS, KEYS)


@register("p4_fill_ffill", S.fill_dir(R6, COLS, KEYS, "ffill"), ["readings"], rnd=COLS)
def p4(spark, sf):
    return series.fill_ffill(series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS), COLS, KEYS)


@register("p5_fill_bfill", S.fill_dir(R6, COLS, KEYS, "bfill"), ["readings"], rnd=COLS)
def p5(spark, sf):
    return series.fill_bfill(series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS), COLS, KEYS)


@register("p6_fill_mean",
          f"SELECT source_id, ts, {', '.join(f'COALESCE({c}, avg({c}) OVER (PARTITION BY source_id)) AS {c}' for c in COLS)} FROM ({R6})",
          ["readings"], rnd=COLS)
def p6(spark, sf):
    return series.fill_mean(series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS), COLS, KEYS)


@register("p7_fill_median",
          f"SELECT source_id, ts, {', '.join(f'COALESCE({c}, quantile_cont({c}, 0.5) OVER (PARTITION BY source_id)) AS {c}' for c in COLS)} FROM ({R6})",
          ["readings"], rnd=COLS)
def p7(spark, sf):
    return series.fill_median(series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS), COLS, KEYS)


@register("p8_fill_zero",
          f"SELECT source_id, ts, {', '.join(f'COALESCE({c}, 0.0) AS {c}' for c in COLS)} FROM ({R6})",
          ["readings"], rnd=COLS)
def p8(spark, sf):
    return series.fill_zero(series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS), COLS, KEYS)


def _ffbf(sql):
    return S.fill_dir(S.fill_dir(sql, COLS, KEYS, "ffill"), COLS, KEYS, "bfill")


_ASOF_FF = (f"SELECT g.source_id, g.ts, r.temperature, r.humidity FROM ({S.grid('readings', H1, KEYS)}) g "
            f"ASOF LEFT JOIN (SELECT source_id, ts AS rts, temperature, humidity FROM readings) r "
            f"ON g.source_id = r.source_id AND g.ts >= r.rts")
_ASOF_BF = (f"SELECT g.source_id, g.ts, r.temperature, r.humidity FROM ({S.grid('readings', H1, KEYS)}) g "
            f"ASOF LEFT JOIN (SELECT source_id, ts AS rts, temperature, humidity FROM readings) r "
            f"ON g.source_id = r.source_id AND g.ts <= r.rts")


@register("p9_preprocess_ffill", _ffbf(_ASOF_FF), ["readings"], rnd=COLS)
def p9_ffill(spark, sf):
    return series.preprocess_series(_readings(spark, sf), "1h", "ffill", COLS, KEYS)


@register("p9_preprocess_bfill", _ffbf(_ASOF_BF), ["readings"], rnd=COLS)
def p9_bfill(spark, sf):
    return series.preprocess_series(_readings(spark, sf), "1h", "bfill", COLS, KEYS)


@register("p9_preprocess_linear", _ffbf(S.fill_linear(_ASFREQ_SQL, COLS, KEYS)), ["readings"], rnd=COLS)
def p9_linear(spark, sf):
    return series.preprocess_series(_readings(spark, sf), "1h", "linear", COLS, KEYS)


@register("p9_preprocess_mean", _ffbf(S.resample_mean("readings", H1, COLS, KEYS)), ["readings"], rnd=COLS)
def p9_mean(spark, sf):
    return series.preprocess_series(_readings(spark, sf), "1h", "mean", COLS, KEYS)


@register("p9_preprocess_asfreq", _ffbf(_ASFREQ_SQL), ["readings"], rnd=COLS)
def p9_asfreq(spark, sf):
    return series.preprocess_series(_readings(spark, sf), "1h", "asfreq", COLS, KEYS)


_LIN6 = S.fill_linear(R6, COLS, KEYS)


def _lin6(spark, sf):
    return series.fill_linear(series.resample_mean(_readings(spark, sf), "6h", COLS, KEYS), COLS, KEYS)


@register("p10_scale_standard", S.scale(_LIN6, COLS, KEYS, "standard"), ["readings"], rnd=COLS)
def p10(spark, sf):
    return series.scale(_lin6(spark, sf), "standard", COLS, KEYS)


@register("p11_scale_minmax", S.scale(_LIN6, COLS, KEYS, "minmax"), ["readings"], rnd=COLS)
def p11(spark, sf):
    return series.scale(_lin6(spark, sf), "minmax", COLS, KEYS)


@register("p12_scale_robust", S.scale(_LIN6, COLS, KEYS, "robust"), ["readings"], rnd=COLS)
def p12(spark, sf):
    return series.scale(_lin6(spark, sf), "robust", COLS, KEYS)


_PRE1 = S.scale(S.fill_linear(S.resample_mean("readings", H1, COLS, KEYS), COLS, KEYS), COLS, KEYS, "standard")


@register("p13_preprocess", _PRE1, ["readings"], rnd=COLS)
def p13(spark, sf):
    return series.preprocess(_readings(spark, sf), "1h", "linear", "standard", COLS, KEYS)


@register("p13_scaler_stats",
          "SELECT source_id, " + ", ".join(
              f"avg({c}) AS {c}__center, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL "
              f"THEN 1.0 ELSE stddev_pop({c}) END AS {c}__scale" for c in COLS)
          + " FROM readings GROUP BY source_id",
          ["readings"], rnd=[f"{c}__{s}" for c in COLS for s in ("center", "scale")])
def p13_stats(spark, sf):
    return series.scale_stats(_readings(spark, sf), "standard", COLS, KEYS)


@register("s2_project_values", "SELECT id, source_id, ts, temperature, humidity FROM readings", ["readings"])
def s2(spark, sf):
    r = _readings(spark, sf)
    return r.select("id", "source_id", "ts", *series.numeric_cols(r, ["source_id", "ts"]))


_FLAG_SEL = "id, source_id, ts, anomaly_temperature, anomaly_humidity"
_RAW = "SELECT id, source_id, ts, temperature, humidity FROM readings"


def _flags(spark, sf, method, threshold=None):
    r = _readings(spark, sf).select("id", "source_id", "ts", *COLS)
    return anomaly.detect_anomalies(r, method, COLS, KEYS, threshold=threshold).select(
        "id", "source_id", "ts", "anomaly_temperature", "anomaly_humidity")


@register("n9_zscore", f"SELECT {_FLAG_SEL} FROM ({S.zscore_flags(_RAW, COLS, KEYS, 3.0)})", ["readings"])
def n9(spark, sf):
    return _flags(spark, sf, "zscore")


@register("n10_zscore_pop", f"SELECT {_FLAG_SEL} FROM ({S.zscore_flags(_RAW, COLS, KEYS, 2.0, True)})",
          ["readings"])
def n10(spark, sf):
    return _flags(spark, sf, "zscore_pop", 2.0)


@register("n11_iqr_k15", f"SELECT {_FLAG_SEL} FROM ({S.iqr_flags(_RAW, COLS, KEYS, 1.5)})", ["readings"])
def n11a(spark, sf):
    return _flags(spark, sf, "iqr", 1.5)


@register("n11_iqr_k3", f"SELECT {_FLAG_SEL} FROM ({S.iqr_flags(_RAW, COLS, KEYS, 3.0)})", ["readings"])
def n11b(spark, sf):
    return _flags(spark, sf, "iqr", 3.0)


@register("a13_anomaly_summary",
          S.anomaly_summary(S.zscore_flags(_RAW, COLS, KEYS, 2.5), COLS, KEYS, "zscore", 2.5), ["readings"])
def a13(spark, sf):
    r = _readings(spark, sf).select("id", "source_id", "ts", *COLS)
    flags = anomaly.zscore_flags(r, COLS, KEYS, threshold=2.5)
    return anomaly.anomaly_summary(flags, COLS, KEYS, "ts", "zscore", 2.5)


@register("a13_anomaly_rows",
          " UNION ALL ".join(f"SELECT source_id, '{c}' AS \"column\", ts, {c} AS value FROM "
                             f"({S.zscore_flags(_RAW, COLS, KEYS, 2.5)}) WHERE anomaly_{c}" for c in COLS),
          ["readings"], rnd=["value"])
def a13_rows(spark, sf):
    r = _readings(spark, sf).select("id", "source_id", "ts", *COLS)
    return anomaly.flagged_rows(anomaly.zscore_flags(r, COLS, KEYS, threshold=2.5), COLS, KEYS)


_MON = S.anomaly_summary(S.zscore_flags(_PRE1, COLS, KEYS, 3.0), COLS, KEYS, "zscore", 3.0)


@register("n18_monitor", _MON, ["readings"])
def n18(spark, sf):
    return monitor(_readings(spark, sf), COLS, KEYS)


# All readings as one unkeyed series: no window over the whole of it.

_U10M = S.resample_mean("readings", 600, COLS, [])


def _u(spark, sf, freq="10min"):
    return series.resample_mean(_readings(spark, sf), freq, COLS, [])


@register("p1_resample_mean_unkeyed", _U10M, ["readings"], rnd=COLS)
def p1_unkeyed(spark, sf):
    return _u(spark, sf)


@register("p2_resample_asfreq_unkeyed",
          f"SELECT g.ts, r.temperature, r.humidity FROM ({S.grid('readings', 600, [])}) g LEFT JOIN "
          f"(SELECT ts, temperature, humidity FROM readings WHERE ts = {S.bin_expr(600)}) r ON g.ts = r.ts",
          ["readings"], rnd=COLS)
def p2_unkeyed(spark, sf):
    return series.resample_asfreq(_readings(spark, sf), "10min", COLS, [])


@register("p3_fill_linear_unkeyed", S.fill_linear(_U10M, COLS, []), ["readings"], rnd=COLS)
def p3_unkeyed(spark, sf):
    return series.fill_linear(_u(spark, sf), COLS, [])


@register("p4_fill_ffill_unkeyed", S.fill_dir(_U10M, COLS, [], "ffill"), ["readings"], rnd=COLS)
def p4_unkeyed(spark, sf):
    return series.fill_ffill(_u(spark, sf), COLS, [])


@register("p5_fill_bfill_unkeyed", S.fill_dir(_U10M, COLS, [], "bfill"), ["readings"], rnd=COLS)
def p5_unkeyed(spark, sf):
    return series.fill_bfill(_u(spark, sf), COLS, [])


_ASOF_U = (f"SELECT g.ts, r.temperature, r.humidity FROM ({S.grid('readings', 600, [])}) g "
           f"ASOF LEFT JOIN (SELECT ts AS rts, temperature, humidity FROM readings) r ON g.ts >= r.rts")


@register("p9_preprocess_ffill_unkeyed", S.fill_dir(S.fill_dir(_ASOF_U, COLS, [], "ffill"), COLS, [], "bfill"),
          ["readings"], rnd=COLS)
def p9_unkeyed(spark, sf):
    return series.preprocess_series(_readings(spark, sf), "10min", "ffill", COLS, [])


_PRE_U = S.scale(S.fill_linear(_U10M, COLS, []), COLS, [], "standard")


@register("p13_preprocess_unkeyed", _PRE_U, ["readings"], rnd=COLS)
def p13_unkeyed(spark, sf):
    return series.preprocess(_readings(spark, sf), "10min", "linear", "standard", COLS, [])


@register("p13_preprocess_robust", S.scale(S.fill_dir(R6, COLS, KEYS, "bfill"), COLS, KEYS, "robust"), ["readings"], rnd=COLS)
def p13_robust(spark, sf):
    return series.preprocess(_readings(spark, sf), "6h", "bfill", "robust", COLS, KEYS)


@register("n18_monitor_unkeyed", S.anomaly_summary(S.zscore_flags(_PRE_U, COLS, [], 2.0), COLS, [], "zscore", 2.0),
          ["readings"])
def n18_unkeyed(spark, sf):
    return monitor(_readings(spark, sf), COLS, [], freq="10min", threshold=2.0)


def flagship(spark, sf):
    return n18(spark, sf)

