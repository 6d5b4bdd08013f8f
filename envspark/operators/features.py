"""Series features and events.

Window features take the last ``window`` readings of every series: the
``row_number() <= window`` filter is planned with a partial WindowGroupLimit
before the shuffle, so only ``window`` rows per key and task cross the
network even when one key holds most of the data.  The per-key arrays are
bounded by ``window``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.functions.timefn import calendar_features
from envspark.operators.series import _cols
from envspark.operators.windows import _order, pct_change, rolling_stats
from envspark.operators.common import attach
from envspark.session import ship_package

SQRT2 = math.sqrt(2.0)


def last_window(df: DataFrame, col: str, window: int = 24, keys=("source_id",), time_col="ts") -> DataFrame:
    """Rows of the last ``window`` readings per series, with ``__pos``
    0..n-1 in time order (shorter series: all rows)."""
    keys = list(keys)
    order_desc = [c.desc() for c in _order(df, time_col)]
    wd = Window.partitionBy(*keys).orderBy(*order_desc) if keys else Window.orderBy(*order_desc)
    last = df.select(*keys, F.col(time_col),
                     *(["id"] if "id" in df.columns else []), F.col(col).cast("double").alias("x")) \
        .withColumn("__rd", F.row_number().over(wd)).where(F.col("__rd") <= window)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.count(F.lit(1)).over(Window.partitionBy())
    return last.withColumn("__n", n).withColumn("__pos", F.col("__n") - F.col("__rd"))


def window_features(df: DataFrame, col: str, window: int = 24, keys=("source_id",), time_col="ts") -> DataFrame:
    """N1 + N2: mean, std (ddof 1), min, max, median, q25, q75, iqr and the
    least-squares trend (slope, intercept on positions 0..n-1) of the last
    ``window`` values of each series."""
    keys = list(keys)
    lw = last_window(df, col, window, keys, time_col)
    q = F.percentile(F.col("x"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = lw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"), q.alias("__q"),
        F.regr_slope("x", F.col("__pos").cast("double")).alias("trend_slope"),
        F.regr_intercept("x", F.col("__pos").cast("double")).alias("trend_intercept"))
    return g.select(*keys, "n", "mean", "std", "min", "max", F.col("__q")[1].alias("median"),
                    F.col("__q")[0].alias("q25"), F.col("__q")[2].alias("q75"),
                    (F.col("__q")[2] - F.col("__q")[0]).alias("iqr"), "trend_slope", "trend_intercept")


def _window_arrays(df, col, window, keys, time_col) -> DataFrame:
    """One bounded array (time order) of the last ``window`` values per key."""
    lw = last_window(df, col, window, keys, time_col)
    return lw.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "x"))).alias("__a")) \
        .select(*keys, F.transform("__a", lambda e: e["x"]).alias("values"))


def haar_energy(values: Column, max_level: int = 3) -> Column:
    """Energy of a Haar (db1) multilevel decomposition with symmetric
    extension, level = min(max_level, floor(log2 n)).  An odd-length level
    repeats its last sample, which adds that sample's energy; even lengths
    preserve energy exactly (orthonormal transform)."""
    n = F.size(values)
    level = F.least(F.lit(max_level), F.floor(F.log2(n.cast("double"))).cast("int"))
    energy = F.lit(0.0)
    a = values
    for lv in range(1, max_level + 1):
        m = F.size(a)
        half = ((m + 1) / 2).cast("int")
        idx = F.sequence(F.lit(0), half - 1)
        pairs = F.transform(idx, lambda k: F.struct(F.get(a, 2 * k).alias("x0"),
                                                    F.get(a, F.least(2 * k + 1, m - 1)).alias("x1")))
        d_energy = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.pow((p["x0"] - p["x1"]) / SQRT2, 2))
        new_a = F.transform(pairs, lambda p: (p["x0"] + p["x1"]) / SQRT2)
        active = level >= lv
        energy = energy + F.when(active, d_energy).otherwise(F.lit(0.0))
        a = F.when(active, new_a).otherwise(a)
    a_energy = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(n >= 1, energy + a_energy)


def hist_entropy(values: Column, max_bins: int = 10) -> Column:
    """Entropy (natural log, +1e-10) of an equal-width histogram with
    min(10, n // 2) bins over [min, max] (last bin closed; a constant series
    uses [v - 0.5, v + 0.5]).  Null when fewer than 2 values."""
    n = F.size(values)
    bins = F.least(F.lit(max_bins), (n / 2).cast("int"))
    lo0, hi0 = F.array_min(values), F.array_max(values)
    lo = F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0)
    hi = F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0)
    idx = F.transform(values, lambda x: F.least(F.floor((x - lo) / (hi - lo) * bins).cast("int"), bins - 1))
    counts = F.transform(F.sequence(F.lit(0), bins - 1),
                         lambda b: F.size(F.filter(idx, lambda i: i == b)).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c)
    ent = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - (c / total) * F.log(c / total + 1e-10))
    return F.when(n >= 2, ent)


def _shape_columns(arr: DataFrame, values: str = "values", max_level: int = 3, max_bins: int = 10) -> DataFrame:
    """N3/N5/W7 on a bounded array column, one level per projection: every
    intermediate array is its own column, so higher-order functions never
    re-evaluate a nested array expression per element."""
    v = F.col(values)
    df = arr.withColumn("__n", F.size(v))
    df = df.withColumn("__lvl", F.least(F.lit(max_level), F.floor(F.log2(F.col("__n").cast("double"))).cast("int")))
    df = df.withColumn("__a0", v).withColumn("__e", F.lit(0.0))
    for lv in range(1, max_level + 1):
        a = F.col(f"__a{lv - 1}")
        m = F.size(a)
        half = ((m + 1) / 2).cast("int")
        df = df.withColumn("__pairs", F.transform(F.sequence(F.lit(0), half - 1), lambda k: F.struct(
            F.get(a, 2 * k).alias("x0"), F.get(a, F.least(2 * k + 1, m - 1)).alias("x1"))))
        d_e = F.aggregate("__pairs", F.lit(0.0), lambda acc, p: acc + F.pow((p["x0"] - p["x1"]) / SQRT2, 2))
        new_a = F.transform("__pairs", lambda p: (p["x0"] + p["x1"]) / SQRT2)
        active = F.col("__lvl") >= lv
        df = (df.withColumn("__e", F.col("__e") + F.when(active, d_e).otherwise(F.lit(0.0)))
              .withColumn(f"__a{lv}", F.when(active, new_a).otherwise(a)).drop("__pairs"))
    energy = F.col("__e") + F.aggregate(f"__a{max_level}", F.lit(0.0), lambda acc, x: acc + x * x)
    # histogram entropy: bin index per value materialised once
    n = F.col("__n")
    bins = F.least(F.lit(max_bins), (n / 2).cast("int"))
    lo0, hi0 = F.array_min(v), F.array_max(v)
    df = df.withColumn("__bins", bins).withColumn("__lo", F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0)) \
        .withColumn("__hi", F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0))
    df = df.withColumn("__idx", F.transform(v, lambda x: F.least(
        F.floor((x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.col("__bins")).cast("int"),
        F.col("__bins") - 1)))
    df = df.withColumn("__cnt", F.transform(F.sequence(F.lit(0), F.greatest(F.col("__bins") - 1, F.lit(0))),
                                            lambda b: F.size(F.filter("__idx", lambda i: i == b)).cast("double")))
    tot = F.aggregate("__cnt", F.lit(0.0), lambda acc, c: acc + c)
    ent = F.aggregate("__cnt", F.lit(0.0), lambda acc, c: acc - (c / tot) * F.log(c / tot + 1e-10))
    sb = F.transform(v, lambda x: x < 0)
    flips = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0),
                        lambda acc, i: acc + F.when((n > 1) & (F.get(sb, i) != F.get(sb, i - 1)), 1).otherwise(0))
    return df.select(*[c for c in arr.columns if c != values], n.cast("bigint").alias("n"),
                     F.when(n >= 1, energy).alias("wavelet_energy"),
                     F.when(n >= 2, ent).alias("entropy"), flips.alias("zero_crossings"), v.alias(values))


def series_shape_features(df: DataFrame, col: str, window: int = 24, keys=("source_id",),
                          time_col="ts") -> DataFrame:
    """N3, N5, W7 on the last ``window`` values (bounded arrays)."""
    keys = list(keys)
    return _shape_columns(_window_arrays(df, col, window, keys, time_col))


def _welch_np(x: np.ndarray) -> tuple[float, float]:
    """One-sided Welch PSD (density scaling, fs=1, periodic Hann window,
    nperseg=min(n,256), 50 % overlap, constant detrend); returns
    (sum of the PSD, frequency of its maximum)."""
    n = len(x)
    if n == 0:
        return float("nan"), float("nan")
    nper = min(n, 256)
    step = nper - nper // 2
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nper) / nper)
    scale = 1.0 / (win * win).sum()
    segs = [x[s:s + nper] for s in range(0, n - nper + 1, step)]
    psd = np.zeros(nper // 2 + 1)
    for s in segs:
        s = (s - s.mean()) * win
        spec = np.abs(np.fft.rfft(s)) ** 2 * scale
        if nper % 2 == 0:
            spec[1:-1] *= 2
        else:
            spec[1:] *= 2
        psd += spec
    psd /= len(segs)
    freqs = np.fft.rfftfreq(nper, 1.0)
    return float(psd.sum()), float(freqs[int(np.argmax(psd))])


@F.pandas_udf(T.StructType([T.StructField("spectral_energy", T.DoubleType()),
                            T.StructField("dominant_freq", T.DoubleType())]))
def _welch_udf(values: pd.Series) -> pd.DataFrame:
    res = [_welch_np(np.asarray(v, dtype=float)) for v in values]
    return pd.DataFrame(res, columns=["spectral_energy", "dominant_freq"])


def welch_features(df: DataFrame, col: str, window: int = 24, keys=("source_id",), time_col="ts") -> DataFrame:
    """Welch spectrum summary of the last ``window`` values (Arrow UDF
    on bounded arrays; NumPy FFT)."""
    ship_package(df.sparkSession)
    keys = list(keys)
    arr = _window_arrays(df, col, window, keys, time_col)
    return arr.select(*keys, _welch_udf("values").alias("w")).select(*keys, "w.*")


def all_window_features(df: DataFrame, col: str, window: int = 24, keys=("source_id",),
                        time_col="ts") -> DataFrame:
    """N1-N5, W7, W8 of the last window in one row per series."""
    ship_package(df.sparkSession)
    keys = list(keys)
    base = window_features(df, col, window, keys, time_col)
    shape = series_shape_features(df, col, window, keys, time_col)
    v = F.col("values")
    ac = shape.select(*keys, "wavelet_energy", "entropy", "zero_crossings",
                      _welch_udf(v).alias("w"), _lag1_corr(v).alias("autocorr_lag1"))
    return base.join(ac.select(*keys, "wavelet_energy", "entropy", "zero_crossings", "w.*", "autocorr_lag1"), keys)


def _lag1_corr(v: Column) -> Column:
    """Pearson correlation of (x[1:], x[:-1]) computed on the array."""
    n = F.size(v)
    xs = F.slice(v, 2, F.greatest(n - 1, F.lit(1)))
    ys = F.slice(v, 1, F.greatest(n - 1, F.lit(1)))
    m = (n - 1).cast("double")
    mx = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / m
    my = F.aggregate(ys, F.lit(0.0), lambda a, x: a + x) / m
    idx = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    sxy = F.aggregate(idx, F.lit(0.0), lambda a, i: a + (F.get(xs, i - 1) - mx) * (F.get(ys, i - 1) - my))
    sxx = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mx) * (x - mx))
    syy = F.aggregate(ys, F.lit(0.0), lambda a, x: a + (x - my) * (x - my))
    return F.when((n > 2) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))


def extract_features(df: DataFrame, cols=None, window: int = 24, keys=("source_id",), time_col="ts",
                     include_time: bool = True, include_statistical: bool = True,
                     include_spectral: bool = False, frame: str | None = None) -> DataFrame:
    """Calendar features (C1), rolling statistics and volatility (W1, W3),
    percent change (W2) and optionally spectral features per series/frame
    (N6), then rows with any null or NaN are dropped."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    out = df.select(*keys, time_col, *(["id"] if "id" in df.columns else []), *cols)
    if include_time:
        out = out.select("*", *[c.alias(n) for n, c in calendar_features(time_col).items()])
    if include_statistical:
        out = rolling_stats(out, cols, window, keys, time_col)
        out = pct_change(out, cols, keys, time_col)
    if include_spectral:
        from envspark.operators.spectral import fft_features
        out = fft_features(out, cols, keys, time_col, frame)
    feat_cols = [c for c in out.columns if c not in (*keys, time_col, "id", *cols)]
    return out.select(*keys, time_col, *feat_cols).na.drop(how="any")


def ewma_anomalies(df: DataFrame, cols=None, span: float = 30.0, threshold: float = 3.0,
                   keys=("source_id",), time_col="ts") -> DataFrame:
    """|x - ewma| > threshold * ewm std (nulls never flagged)."""
    from envspark.operators.windows import ewma
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    e = ewma(df, cols, span, keys, time_col)
    flags = [F.coalesce(F.abs(F.col(c) - F.col(f"{c}_ewma")) > threshold * F.col(f"{c}_ewmstd"), F.lit(False))
             .alias(f"anomaly_{c}") for c in cols]
    return e.select(*df.columns, *flags)


def threshold_events(df: DataFrame, cols=None, k: float = 3.0, keys=("source_id",), time_col="ts") -> DataFrame:
    """Long event table of values above mean + k * std (ddof 1) of the
    series: ``(keys, column, ts, value, method, threshold)``."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    stats = df.groupBy(*keys).agg(*[(F.avg(c) + k * F.stddev_samp(c)).alias(f"__t_{c}") for c in cols])
    j = attach(df, stats, keys)
    parts = [j.where(F.col(c) > F.col(f"__t_{c}")).select(
        *keys, F.lit(c).alias("column"), F.col(time_col), F.col(c).cast("double").alias("value"),
        F.lit("threshold").alias("method"), F.col(f"__t_{c}").alias("threshold")) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

