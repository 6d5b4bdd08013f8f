"""Dashboard aggregates and column statistics.

All are ``groupBy`` aggregates with partial (map-side) combine; the group
keys are low-cardinality (period x category), so the shuffle carries only
one partial row per key and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.timefn import look_back, period_label, time_bucket, ts_lit
from envspark.operators.quantiles import exact_quantile_table
from envspark.operators.common import attach

GROUP_BY = ("hour", "day", "week", "month")
AGGREGATION = ("minute", "hour", "day")


def _since(df: DataFrame, as_of, time_range, default, time_col="ts") -> DataFrame:
    start, end = look_back(as_of, time_range, default)
    return df.where(F.col(time_col) >= ts_lit(start))


def detection_stats(detections: DataFrame, as_of, time_range="7d", group_by="day") -> DataFrame:
    """A1: count and average confidence per period x threat type, ordered by
    period.  ``time_range`` must be ``<n>h``/``<n>d`` (error otherwise)."""
    if group_by not in GROUP_BY:
        raise ValueError(f"Invalid group_by {group_by!r}. Must be one of: {', '.join(GROUP_BY)}")
    df = _since(detections, as_of, time_range, None)
    period = time_bucket("ts", group_by)
    return (df.groupBy(period.alias("time_period"), "threat_type")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"))
            .withColumn("label", period_label(F.col("time_period"), group_by))
            .orderBy("time_period", "threat_type"))


def detection_stats_nested(detections: DataFrame, as_of, time_range="7d", group_by="day") -> DataFrame:
    """A2: one row per period with ``map<threat, struct<count, avg_confidence>>``
    (at most five entries per period - bounded)."""
    flat = detection_stats(detections, as_of, time_range, group_by)
    entries = F.array_sort(F.collect_list(F.struct("threat_type", F.struct("count", "avg_confidence"))))
    return flat.groupBy("label").agg(F.map_from_entries(entries).alias("stats")).orderBy("label")


def sensor_stats(readings: DataFrame, as_of, time_range="24h", aggregation="hour",
                 source_id=None) -> DataFrame:
    """A3: per period x source - mean temperature, mean humidity (nulls
    skipped), number of readings.  Unknown ranges fall back to 24 h."""
    if aggregation not in AGGREGATION:
        raise ValueError(f"Invalid aggregation {aggregation!r}. Must be one of: minute, hour, day")
    df = _since(readings, as_of, time_range, "24h")
    if source_id is not None:
        df = df.where(F.col("source_id") == F.lit(source_id))
    return (df.groupBy(time_bucket("ts", aggregation).alias("time_period"), "source_id")
            .agg(F.avg("temperature").alias("avg_temperature"), F.avg("humidity").alias("avg_humidity"),
                 F.count(F.lit(1)).alias("reading_count"))
            .orderBy("time_period", "source_id"))


def detection_counts(detections: DataFrame, as_of, time_range="7d") -> DataFrame:
    """A4: detections per threat type in the look-back (bad range -> 7 d)."""
    return (_since(detections, as_of, time_range, "7d").groupBy("threat_type")
            .agg(F.count(F.lit(1)).alias("count")))


def source_counts(sources: DataFrame) -> DataFrame:
    """A5: active sources per type."""
    return sources.where(F.col("is_active")).groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def column_moments(df: DataFrame, cols, keys=("source_id",)) -> DataFrame:
    """Per key and column - mean, sample and population std, min, max,
    exact median, null count (long output).  The moments of all columns are
    one partial aggregate; the medians come from one rank selection."""
    keys, cols = list(keys), list(cols)
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"), F.stddev_pop(x).alias(f"{c}__std_pop"),
                 F.min(x).cast("double").alias(f"{c}__min"), F.max(x).cast("double").alias(f"{c}__max"),
                 F.count_if(x.isNull()).alias(f"{c}__nulls"), F.count(x).alias(f"{c}__count")]
    both = attach(df.groupBy(*keys).agg(*aggs), exact_quantile_table(df, cols, [0.5], keys), keys)
    names = ("mean", "std", "std_pop", "min", "max", "median", "nulls", "count")
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              *[F.col(f"{c}_q0" if n == "median" else f"{c}__{n}").alias(n) for n in names]) for c in cols])
    return both.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r.column", *[f"__r.{n}" for n in names])


def quantiles(df: DataFrame, cols, ps=(0.25, 0.5, 0.75), keys=("source_id",), exact: bool = True,
              accuracy: int = 10000) -> DataFrame:
    """Linear-interpolated exact quantiles per key (skew-safe rank
    selection), or ``percentile_approx`` when ``exact=False``."""
    keys = list(keys)
    names = {c: [f"{c}_q{int(round(p * 100)):02d}" for p in ps] for c in cols}
    if not exact:
        arr = F.array(*[F.lit(float(p)) for p in ps])
        g = df.groupBy(*keys).agg(*[F.percentile_approx(F.col(c).cast("double"), arr, accuracy).alias(f"__q_{c}")
                                    for c in cols])
        return g.select(*keys, *[F.col(f"__q_{c}")[i].alias(n) for c in cols for i, n in enumerate(names[c])])
    g = exact_quantile_table(df, list(cols), list(ps), keys)
    return g.select(*keys, *[F.col(f"{c}_q{i}").alias(n) for c in cols for i, n in enumerate(names[c])])


def mean_loss(batches: DataFrame, loss_col="loss", n_col="n", keys=()) -> DataFrame:
    """Sample-weighted mean loss, sum(loss*n)/sum(n)."""
    return batches.groupBy(*keys).agg(
        (F.sum(F.col(loss_col) * F.col(n_col)) / F.sum(n_col)).alias("mean_loss"),
        F.sum(n_col).alias("samples"))
