"""Statistical anomaly flags and their summary.

Flags are added as ``anomaly_<col>`` boolean columns on the input.  Series
statistics are computed once per key with a partially-aggregated ``groupBy``
and joined back (AQE broadcasts the per-key table when it is small and falls
back to a sort-merge join with skew splitting when it is not), so a hot key
never has to be held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.operators.quantiles import exact_quantile_table
from envspark.operators.series import _cols
from envspark.operators.common import attach


def _with_stats(df: DataFrame, keys, aggs, via: str = "join") -> DataFrame:
    """Attach per-series statistics to every row.

    ``join``   partial aggregate per key, joined back: skew-safe for raw
               readings where one key may hold a large share of all rows.
    ``window`` window over ``partitionBy(keys)``: no second scan of the
               input; right for bounded per-key grids (resampled series)
               that are already partitioned by ``keys``.
    """
    keys = list(keys)
    if via == "window":
        w = Window.partitionBy(*keys)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs])
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs])
    return attach(df, stats, keys)


def zscore_flags(df: DataFrame, cols=None, keys=("source_id",), time_col="ts",
                 threshold: float = 3.0, population: bool = False, via: str = "join") -> DataFrame:
    """N9 (sample std) / N10 (population std + 1e-10): |x - mean| / std > t.
    A zero or undefined std gives no anomaly; null values are not anomalies."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    aggs = []
    for c in cols:
        aggs += [(f"__m_{c}", F.avg(c)),
                 (f"__s_{c}", F.stddev_pop(c) if population else F.stddev_samp(c))]
    j = _with_stats(df, keys, aggs, via)
    flags = []
    for c in cols:
        m, s = F.col(f"__m_{c}"), F.col(f"__s_{c}")
        if population:
            z = F.abs((F.col(c) - m) / (s + F.lit(1e-10)))
        else:
            z = F.abs(F.try_divide(F.col(c) - m, F.when(s != 0, s)))
        flags.append(F.coalesce(z > F.lit(threshold), F.lit(False)).alias(f"anomaly_{c}"))
    return j.select(*df.columns, *flags)


def iqr_flags(df: DataFrame, cols=None, keys=("source_id",), time_col="ts",
              k: float = 1.5, via: str = "join") -> DataFrame:
    """Outside [Q1 - k*IQR, Q3 + k*IQR] (exact linear quantiles).
    k=1.5 is the sensor default, k=3 the series default."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    if via == "window":                       # bounded per-key grids
        aggs = [(f"__q_{c}", F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.75)))) for c in cols]
        j = _with_stats(df, keys, aggs, via)
    else:                                     # raw data: skew-safe exact quantiles, joined back
        q = exact_quantile_table(df, cols, [0.25, 0.75], keys)
        j = attach(df, q.select(*keys, *[F.array(f"{c}_q0", f"{c}_q1").alias(f"__q_{c}") for c in cols]), keys)
    flags = []
    for c in cols:
        q1, q3 = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        iqr = q3 - q1
        x = F.col(c)
        flags.append(F.coalesce((x < q1 - k * iqr) | (x > q3 + k * iqr), F.lit(False)).alias(f"anomaly_{c}"))
    return j.select(*df.columns, *flags)


def detect_anomalies(df: DataFrame, method: str = "zscore", cols=None, keys=("source_id",),
                     time_col="ts", threshold: float | None = None, via: str = "join") -> DataFrame:
    if method == "zscore":
        return zscore_flags(df, cols, keys, time_col, 3.0 if threshold is None else threshold, via=via)
    if method == "zscore_pop":
        return zscore_flags(df, cols, keys, time_col, 3.0 if threshold is None else threshold, True, via)
    if method == "iqr":
        return iqr_flags(df, cols, keys, time_col, 1.5 if threshold is None else threshold, via)
    raise ValueError(f"no anomaly test called {method!r}; there are zscore, zscore_pop and iqr")


def flagged_rows(flags: DataFrame, cols, keys=("source_id",), time_col="ts") -> DataFrame:
    """The anomaly indices as a long table ``(keys, column, ts, value)``:
    one row per flagged value, distributed (never gathered into one list)."""
    keys = list(keys)
    parts = [flags.where(F.col(f"anomaly_{c}"))
             .select(*keys, F.lit(c).alias("column"), F.col(time_col), F.col(c).cast("double").alias("value"))
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def anomaly_summary(flags: DataFrame, cols, keys=("source_id",), time_col="ts",
                    method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Per key and column - method, threshold, count, first/last
    flagged time.  Unpivot with ``stack`` then one partial aggregate."""
    keys = list(keys)
    stack = "stack({n}, {items}) as (column, flag)".format(
        n=len(cols), items=", ".join(f"'{c}', `anomaly_{c}`" for c in cols))
    long = flags.select(*keys, time_col, F.expr(stack))
    return (long.groupBy(*keys, "column")
            .agg(F.count_if(F.col("flag")).alias("anomaly_count"),
                 F.min(F.when(F.col("flag"), F.col(time_col))).alias("first_anomaly"),
                 F.max(F.when(F.col("flag"), F.col(time_col))).alias("last_anomaly"))
            .select(*keys, "column", F.lit(method).alias("method"),
                    F.lit(float(threshold)).alias("threshold"),
                    "anomaly_count", "first_anomaly", "last_anomaly"))
