"""N18 - the upload-and-analyse flow as one lazy plan:
resample (bin means) -> linear fill -> standard scale -> z-score flags ->
per-series summary.  One action at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.operators import anomaly, series
from envspark.operators.common import attach


def _standard_zscore_flags(grid: DataFrame, cols, keys, time_col, threshold: float) -> DataFrame:
    """Standard scaling followed by z-score flags from ONE partial aggregate
    of the filled grid.  With x' = (x - m) / d (d = population std, 1 when
    zero), the scaled series has mean (mean(x) - m) / d and sample std
    std_samp(x) / d, so the flags need no second pass over the grid."""
    keys = list(keys)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__sp_{c}"),
                 F.stddev_samp(c).alias(f"__ss_{c}")]
    j = attach(grid, grid.groupBy(*keys).agg(*aggs), keys)
    out = [*[F.col(k) for k in keys], F.col(time_col)]
    flags = []
    for c in cols:
        sp = F.col(f"__sp_{c}")
        d = F.when((sp == 0) | sp.isNull(), F.lit(1.0)).otherwise(sp)
        x = (F.col(c) - F.col(f"__m_{c}")) / d
        s = F.col(f"__ss_{c}") / d
        z = F.abs(F.try_divide(x, F.when(s != 0, s)))       # scaled mean is 0 up to rounding
        out.append(x.alias(c))
        flags.append(F.coalesce(z > F.lit(threshold), F.lit(False)).alias(f"anomaly_{c}"))
    return j.select(*out, *flags)


def monitor_flags(readings: DataFrame, cols=("temperature", "humidity"), keys=("source_id",),
                  time_col="ts", freq="1h", fill_method="linear", scale_method="standard",
                  method="zscore", threshold: float = 3.0, via: str | None = None) -> DataFrame:
    cols = list(cols)
    if scale_method == "standard" and method == "zscore" and freq and fill_method in ("linear", "ffill", "pad",
                                                                                       "bfill"):
        grid = series.resample_fill(readings, freq, fill_method, cols, keys, time_col, via=via)
        return _standard_zscore_flags(grid, cols, keys, time_col, threshold)
    prepared = series.preprocess(readings, freq, fill_method, scale_method, cols, keys, time_col, via)
    # per-key statistics as partial aggregates joined back: the grid is never sorted
    return anomaly.detect_anomalies(prepared, method, cols, keys, time_col, threshold, via="join")


def monitor(readings: DataFrame, cols=("temperature", "humidity"), keys=("source_id",),
            time_col="ts", freq="1h", fill_method="linear", scale_method="standard",
            method="zscore", threshold: float = 3.0, via: str | None = None) -> DataFrame:
    flags = monitor_flags(readings, cols, keys, time_col, freq, fill_method, scale_method,
                          method, threshold, via)
    return anomaly.anomaly_summary(flags, list(cols), keys, time_col, method, threshold)
