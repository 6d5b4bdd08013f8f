"""Structured Streaming versions of ingest and statistics.

The batch operators are reused on streams wherever they are stateless
(decode, points, validation joins).  Stateful statistics use event-time
windows with a watermark, so late rows past ``delay`` are dropped and state
is bounded.  All sinks are checkpointed (exactly-once file sinks); no sink
collects to the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from envspark.operators import blocks
from envspark.operators.common import join_on
from envspark.session import checkpoint_dir
from envspark.sources import ingest
from envspark.session import ship_package

MESSAGE_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("qos", T.IntegerType()),
    T.StructField("retain", T.BooleanType()),
    T.StructField("received_at", T.TimestampNTZType()),
])


def topic_regex(pattern: str) -> str:
    """MQTT filter -> anchored regex: ``+`` one level, ``#`` the rest."""
    parts = pattern.split("/")
    out = []
    for i, p in enumerate(parts):
        if p == "+":
            out.append("[^/]+")
        elif p == "#":
            if i != len(parts) - 1:
                raise ValueError("'#' must be the last level of a topic filter")
            prefix = "/".join(out)
            return f"^{prefix}(/.*)?$" if prefix else "^.*$"
        else:
            out.append(re.escape(p))
    return "^" + "/".join(out) + "$"


def topic_filter(topics: Sequence[str] | None):
    if not topics:
        return F.lit(True)
    cond = F.lit(False)
    for t in topics:
        cond = cond | F.col("topic").rlike(topic_regex(t))
    return cond


def stream_messages(spark: SparkSession, path: str | None = None, fmt: str = "json",
                    topics: Sequence[str] | None = None, schema: T.StructType = MESSAGE_SCHEMA,
                    kafka: dict | None = None, **options) -> DataFrame:
    """A message stream from files (json/parquet) or Kafka, filtered by
    MQTT topic patterns (``+``/``#`` wildcards)."""
    if kafka is not None:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        df = raw.select(F.col("topic"), F.col("value").cast("string").alias("payload"),
                        F.lit(0).alias("qos"), F.lit(False).alias("retain"),
                        F.col("timestamp").cast("timestamp_ntz").alias("received_at"))
    else:
        r = spark.readStream.format(fmt).schema(schema)
        for k, v in options.items():
            r = r.option(k, v)
        df = r.load(path)
    return df.where(topic_filter(topics))


def stream_points(messages: DataFrame) -> DataFrame:
    """S3-S6 on a stream (stateless)."""
    ok, _ = ingest.decode_messages(messages)
    return ingest.messages_to_points(ok)


def on_batch(callbacks: Iterable[Callable[[DataFrame, int], None]], errors: list | None = None):
    """A ``foreachBatch`` function calling every handler on the batch;
    a failing handler is recorded and does not stop the others.  The batch
    is persisted once for all handlers."""
    callbacks = list(callbacks)

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for cb in callbacks:
                try:
                    cb(batch, epoch)
                except Exception as e:  # noqa: BLE001 - isolate handlers
                    if errors is not None:
                        errors.append((epoch, getattr(cb, "__name__", str(cb)), repr(e)))
        finally:
            batch.unpersist()
    return run


def _ckpt(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def sink_points(points: DataFrame, path: str, checkpoint: str | None = None,
                available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Checkpointed parquet sink partitioned by measurement and day."""
    w = (points.withColumn("date", F.to_date("time")).writeStream.format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint or _ckpt(points.sparkSession, "points"))
         .partitionBy("measurement", "date").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def stream_validate(readings: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """S8 on a stream (stream-static join with the source table)."""
    ok, _ = ingest.ingest_readings(readings, sources, as_of)
    return ok


def _event_time(df: DataFrame, time_col: str, delay: str) -> DataFrame:
    # watermarks need TIMESTAMP (not NTZ); the session is UTC
    return df.withColumn("__et", F.col(time_col).cast("timestamp")).withWatermark("__et", delay)


def stream_sensor_stats(readings: DataFrame, window: str = "1 hour", delay: str = "10 minutes",
                        time_col: str = "ts") -> DataFrame:
    """A3 over event-time tumbling windows; rows later than ``delay``
    behind the newest event are dropped; a window is emitted once."""
    s = _event_time(readings, time_col, delay)
    g = s.groupBy(F.window("__et", window).alias("w"), "source_id").agg(
        F.avg("temperature").alias("avg_temperature"), F.avg("humidity").alias("avg_humidity"),
        F.count(F.lit(1)).alias("reading_count"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("time_period"), "source_id",
                    "avg_temperature", "avg_humidity", "reading_count")


def stream_detection_stats(detections: DataFrame, window: str = "1 hour", slide: str | None = None,
                           delay: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """A1 over tumbling (or sliding) event-time windows."""
    s = _event_time(detections, time_col, delay)
    win = F.window("__et", window, slide) if slide else F.window("__et", window)
    g = s.groupBy(win.alias("w"), "threat_type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("time_period"),
                    F.col("w.end").cast("timestamp_ntz").alias("time_period_end"),
                    "threat_type", "count", "avg_confidence")


def stream_alerts(detections: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The alert predicate on a stream."""
    return detections.where(F.col("confidence") >= F.lit(threshold))


def stream_health(readings: DataFrame) -> DataFrame:
    """Last-seen time per source (state = one row per source; emit in
    update/complete mode; the status is computed at read time with J1)."""
    return readings.groupBy("source_id").agg(F.max("ts").alias("last_seen"))


def stream_anomaly(readings: DataFrame, stats: DataFrame, cols: Sequence[str], threshold: float = 3.0,
                   keys=("source_id",)) -> DataFrame:
    """Z-score flags against a fitted scaler table (P13 ``scale_stats``)
    - a stream-static join, no streaming state."""
    keys = list(keys)
    j = readings.join(stats, keys, "left")
    flags = [F.coalesce(F.abs((F.col(c) - F.col(f"{c}__center")) / F.col(f"{c}__scale")) > threshold,
                        F.lit(False)).alias(f"anomaly_{c}") for c in cols]
    return j.select(*readings.columns, *flags)


RUNNING_SCHEMA = "n long, mean double, m2 double"


def stream_running_zscore(readings: DataFrame, col: str, threshold: float = 3.0, key: str = "source_id",
                          time_col: str = "ts") -> DataFrame:
    """X10 (running form): per-sensor Welford mean/variance kept in state
    (``applyInPandasWithState``); each reading is scored against the
    statistics of the readings before it (sample std), then folded in.  A
    key's rows of one micro-batch meet in one Python worker;
    ``running_zscore_table`` has no such bound."""
    ship_package(readings.sparkSession)
    ties = ["id"] if "id" in readings.columns and key != "id" else []
    out_schema = T.StructType([T.StructField(key, readings.schema[key].dataType), T.StructField(time_col, T.TimestampNTZType()),
                               T.StructField(col, T.DoubleType()), T.StructField("zscore", T.DoubleType()),
                               T.StructField("anomaly", T.BooleanType())])

    def fold(k, batches: Iterable[pd.DataFrame], state: GroupState):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        # a key's rows of the micro-batch may come in several Arrow batches
        held = list(batches)
        for pdf in [pd.concat(held)] if held else []:
            pdf = pdf.sort_values([time_col, *ties], kind="mergesort")
            zs, flags = [], []
            for x in pdf[col].to_numpy(dtype=float):
                if x != x:  # null reading: not scored, not folded
                    zs.append(None)
                    flags.append(False)
                    continue
                sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
                z = (x - mean) / sd if sd > 0 else None
                zs.append(z)
                flags.append(bool(z is not None and abs(z) > threshold))
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
            state.update((n, mean, m2))
            yield pd.DataFrame({key: pdf[key].to_numpy(), time_col: pdf[time_col].to_numpy(),
                                col: pdf[col].to_numpy(dtype=float), "zscore": zs, "anomaly": flags})

    slim = readings.select(key, time_col, F.col(col).cast("double").alias(col), *ties)
    return slim.groupBy(key).applyInPandasWithState(fold, out_schema, RUNNING_SCHEMA, "append",
                                                    GroupStateTimeout.NoTimeout)


def score_running(batch: DataFrame, state: DataFrame, col: str, threshold: float = 3.0, key: str = "source_id",
                  time_col: str = "ts") -> tuple[DataFrame, DataFrame]:
    """One micro-batch of the running z-score: rows in time order scored
    against all readings of their key before them, in ``state`` (key, n, mean,
    m2; one row per key) and in the batch.  Returns (scored, next state).

    Running count, mean and squared deviations inside ranges of about equal
    size; each range takes over what the state and the ranges before it hold
    (one row per key and range).  Squared deviations are sums of positive
    terms, so they lose no digits when the level of a sensor moves.  Rows
    that tie in time follow ``id`` if there is one, then the value; null and
    NaN readings are neither scored nor folded in."""
    ties = ["id"] if "id" in batch.columns and key != "id" else []
    rows = blocks.ranges(batch.select(key, time_col, *ties, F.nanvl(F.col(col).cast("double"), F.lit(None))
                                      .alias(col)), [key], [time_col, *ties, col])
    part = [key, blocks.RANGE]
    level = rows.groupBy(*part).agg(F.avg(col).alias("__c"))
    rows = join_on(rows, level, part, "inner").withColumn("__x", F.col(col) - F.col("__c"))
    prior = (Window.partitionBy(*part).orderBy(time_col, *ties, col)
             .rowsBetween(Window.unboundedPreceding, -1))
    x = F.col("__x")
    rows = rows.select("*", F.count("__x").over(prior).alias("__n"),
                       F.coalesce(F.sum("__x").over(prior), F.lit(0.0)).alias("__s"))
    term = F.when(F.col("__n") > 0, F.col("__n") / (F.col("__n") + 1) * (x - F.col("__s") / F.col("__n")) ** 2)
    rows = rows.withColumn("__t", F.when(x.isNotNull(), F.coalesce(term, F.lit(0.0))))
    rows = rows.withColumn("__m2", F.coalesce(F.sum("__t").over(prior), F.lit(0.0)))

    # per key: the state, then one row per range, chained in order
    totals = rows.groupBy(*part).agg(F.count("__x").alias("n"), F.avg(col).alias("mean"), F.sum("__t").alias("m2"))
    links = (state.select(key, F.lit(-1).alias(blocks.RANGE), "n", "mean", "m2")
             .unionByName(totals)).select(key, blocks.RANGE, "n", F.coalesce("mean", F.lit(0.0)).alias("mean"),
                                          F.coalesce("m2", F.lit(0.0)).alias("m2"))
    chain = Window.partitionBy(key).orderBy(blocks.RANGE)
    upto = chain.rowsBetween(Window.unboundedPreceding, -1)
    start = F.first("mean").over(chain.rowsBetween(Window.unboundedPreceding, 0))
    links = links.withColumn("__d", F.col("mean") - start).withColumn("__start", start)
    links = links.select("*", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__n0"),
                         F.coalesce(F.sum(F.col("n") * F.col("__d")).over(upto), F.lit(0.0)).alias("__s0"))
    gap = F.col("__d") - F.col("__s0") / F.col("__n0")
    joint = F.when((F.col("__n0") > 0) & (F.col("n") > 0),
                   F.col("__n0") * F.col("n") / (F.col("__n0") + F.col("n")) * gap * gap).otherwise(F.lit(0.0))
    links = links.withColumn("__t", F.col("m2") + joint)
    links = links.withColumn("__v0", F.coalesce(F.sum("__t").over(upto), F.lit(0.0)))
    last = links.groupBy(key).agg(F.max_by(F.struct(
        (F.col("__n0") + F.col("n")).alias("n"), F.col("__start").alias("a"),
        (F.col("__s0") + F.col("n") * F.col("__d")).alias("s"), (F.col("__v0") + F.col("__t")).alias("m2")),
        blocks.RANGE).alias("l"))
    following = last.select(key, F.col("l.n").alias("n"), F.when(
        F.col("l.n") > 0, F.col("l.a") + F.col("l.s") / F.col("l.n")).otherwise(0.0).alias("mean"),
        F.col("l.m2").alias("m2"))

    before = links.where(F.col(blocks.RANGE) >= 0).select(*part, "__n0", "__v0", F.when(
        F.col("__n0") > 0, F.col("__start") + F.col("__s0") / F.col("__n0")).alias("__mean0"))
    j = join_on(rows, before, part, "inner")
    n = F.col("__n") + F.col("__n0")
    own = F.col("__s") / F.col("__n")                   # relative to the level of the range
    away = F.col("__mean0") - F.col("__c")              # the rows before, likewise
    both = (F.col("__n") > 0) & (F.col("__n0") > 0)
    mean = (F.when(both, away + (own - away) * F.col("__n") / n).when(F.col("__n") > 0, own)
            .when(F.col("__n0") > 0, away))
    m2 = F.col("__m2") + F.col("__v0") + F.when(
        both, F.col("__n") * F.col("__n0") / n * (own - away) ** 2).otherwise(F.lit(0.0))
    sd = F.when(n > 1, F.sqrt(m2 / (n - 1)))
    j = j.withColumn("zscore", F.when(sd > 0, (x - mean) / sd))
    scored = j.select(key, time_col, col, "zscore",
                      F.coalesce(F.abs("zscore") > threshold, F.lit(False)).alias("anomaly"))
    return scored, following


def running_zscore_table(readings: DataFrame, col: str, threshold: float = 3.0, key: str = "source_id",
                         time_col: str = "ts", base: str | None = None) -> DataFrame:
    """X10 (running form, sensors of any rate): every micro-batch is scored by
    ``score_running`` and written under its epoch, its state to one of two
    slots in turn.  An epoch that is run again after a failure reads the slot
    of the epoch before and writes the same places, so each reading is scored
    once; a further run with the same ``base`` (by default a new folder in the
    shared checkpoint folder) continues where the last one ended.  Returns the
    table of all scored readings."""
    spark = readings.sparkSession
    base = (base or _ckpt(spark, "running-zscore")).rstrip("/")
    kind = readings.schema[key].dataType
    held = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()),
                         T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())])
    out = T.StructType([T.StructField(key, kind), readings.schema[time_col], T.StructField(col, T.DoubleType()),
                        T.StructField("zscore", T.DoubleType()), T.StructField("anomaly", T.BooleanType())])

    def fold(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        state = (s.read.schema(held).parquet(f"{base}/state/{(epoch - 1) % 2}") if epoch > 0
                 else s.createDataFrame([], held))
        scored, following = score_running(batch, state, col, threshold, key, time_col)
        scored.write.mode("overwrite").parquet(f"{base}/data/epoch={epoch}")
        following.write.mode("overwrite").parquet(f"{base}/state/{epoch % 2}")

    q = (readings.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(out).option("recursiveFileLookup", "true").parquet(f"{base}/data")


def dedup_messages(messages: DataFrame, keys: Sequence[str] = ("topic", "payload"), delay: str = "10 minutes",
                   time_col: str = "received_at") -> DataFrame:
    """X11: drop redelivered messages (same keys) within the watermark delay."""
    s = _event_time(messages, time_col, delay)
    return s.dropDuplicatesWithinWatermark(list(keys)).drop("__et")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", partition_by: Sequence[str] = ()) -> DataFrame:
    """Run a stream to completion (``availableNow``) into a checkpointed
    parquet table in the shared checkpoint folder and return the table.
    Update/complete results are written per micro-batch with foreachBatch
    (overwrite = the latest state)."""
    spark = stream.sparkSession
    base = _ckpt(spark, name)
    path = f"{base}/data"
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", path).outputMode("append")
        if partition_by:
            w = w.partitionBy(*partition_by)
    else:
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        w = stream.writeStream.foreachBatch(write).outputMode(mode)
    q = w.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(path)
