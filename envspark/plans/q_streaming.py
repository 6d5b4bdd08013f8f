"""Queries: the streaming operators run to completion (``availableNow``)
over a file stream of the events table, results read back from their
checkpointed sinks (2.12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from envspark.operators import joins, series
from envspark.plans.catalog import register
from envspark.plans.q_ingest import _S5
from envspark.session import checkpoint_dir
from envspark.sources.views import VIEW_EXPRS, view
from envspark.streaming import streams

AS_OF = "2024-01-31 00:00:00"
T = f"TIMESTAMP '{AS_OF}'"


def _stream_view(spark, sf, name):
    """A domain view over a file stream of its base table."""
    base, exprs = VIEW_EXPRS[name]
    path = f"{sf.rstrip('/')}/{base}.parquet"
    schema = spark.read.parquet(path).schema
    raw = (spark.readStream.format("parquet").schema(schema)
           .option("pathGlobFilter", f"{base}.parquet").load(sf.rstrip("/")))
    return raw.selectExpr(*exprs)


@register("x1_stream_messages",
          "SELECT id, topic, received_at FROM messages WHERE regexp_matches(topic, '^sensors/[^/]+/click$')",
          ["messages"])
def x1(spark, sf):
    m = _stream_view(spark, sf, "messages").where(streams.topic_filter(["sensors/+/click"]))
    return streams.run_to_table(m.select("id", "topic", "received_at"), "x1")


@register("x2_stream_points", _S5, ["messages"])
def x2(spark, sf):
    p = streams.stream_points(_stream_view(spark, sf, "messages"))
    out = p.select("id", "measurement", F.col("tags")["sensor_id"].alias("sensor_id"), "field", "value", "time")
    return streams.run_to_table(out, "x2")


@register("x4_sink_points",
          f"SELECT id, sensor_id, field, value, time FROM ({_S5}) WHERE measurement = 'error'", ["messages"])
def x4(spark, sf):
    path = f"{checkpoint_dir(spark).rstrip('/')}/streams/points-{uuid.uuid4().hex}"
    q = streams.sink_points(streams.stream_points(_stream_view(spark, sf, "messages")), path)
    q.awaitTermination()
    back = spark.read.parquet(path).where(F.col("measurement") == "error")
    return back.select("id", F.col("tags")["sensor_id"].alias("sensor_id"), "field", "value", "time")


@register("x5_stream_validate",
          f"SELECT r.id, r.source_id, COALESCE(TRY_CAST(CASE WHEN r.id % 11 = 0 THEN 'not a time' ELSE "
          f"strftime(r.ts, '%Y-%m-%dT%H:%M:%S.%f') END AS TIMESTAMP), {T}) AS ts, s.lon, s.lat, r.temperature, "
          "r.humidity, CAST(NULL AS VARCHAR) AS air_quality, CAST(NULL AS VARCHAR) AS water_quality, "
          "COALESCE(r.metadata, '{}') AS metadata FROM readings r JOIN sources s ON r.source_id = s.id "
          "WHERE s.type = 'iot_sensor'", ["readings", "sources"])
def x5(spark, sf):
    r = _stream_view(spark, sf, "readings")
    text = F.when(F.col("id") % 11 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    uploads = r.select("id", "source_id", text.alias("timestamp"), "temperature", "humidity", "metadata")
    return streams.run_to_table(streams.stream_validate(uploads, view(spark, sf, "sources"), AS_OF), "x5")


@register("x6_stream_sensor_stats",
          "SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS time_period, source_id, "
          "avg(temperature) AS avg_temperature, avg(humidity) AS avg_humidity, count(*) AS reading_count "
          "FROM readings GROUP BY ALL) WHERE time_period + INTERVAL 1 HOUR <= "
          "(SELECT max(ts) - INTERVAL 10 MINUTE FROM readings)",
          ["readings"], rnd=["avg_temperature", "avg_humidity"])
def x6(spark, sf):
    return streams.run_to_table(streams.stream_sensor_stats(_stream_view(spark, sf, "readings")), "x6")


@register("x7_stream_detection_stats",
          "SELECT * FROM (SELECT s AS time_period, s + INTERVAL 1 HOUR AS time_period_end, threat_type, "
          "count(*) AS count, avg(confidence) AS avg_confidence FROM (SELECT threat_type, confidence, "
          "unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, "
          "time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s FROM detections) GROUP BY ALL) "
          "WHERE time_period_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM detections)",
          ["detections"], rnd=["avg_confidence"])
def x7(spark, sf):
    d = _stream_view(spark, sf, "detections")
    return streams.run_to_table(streams.stream_detection_stats(d, "1 hour", "15 minutes"), "x7")


@register("x8_stream_alerts",
          "SELECT id, threat_type, confidence, ts FROM detections WHERE confidence >= 0.7", ["detections"])
def x8(spark, sf):
    d = _stream_view(spark, sf, "detections")
    return streams.run_to_table(streams.stream_alerts(d, 0.7).select("id", "threat_type", "confidence", "ts"), "x8")


@register("x9_stream_health",
          f"SELECT s.id, s.name, s.type, CASE WHEN l.last_seen IS NULL THEN 'offline' "
          f"WHEN epoch({T}) - epoch(l.last_seen) < 3600 THEN 'online' "
          f"WHEN epoch({T}) - epoch(l.last_seen) < 86400 THEN 'warning' ELSE 'error' END AS status, "
          f"l.last_seen, s.lon, s.lat FROM sources s LEFT JOIN (SELECT source_id, max(ts) AS last_seen "
          f"FROM readings GROUP BY source_id) l ON s.id = l.source_id "
          f"WHERE s.is_active AND s.type IN ('iot_sensor', 'drone')", ["sources", "readings"])
def x9(spark, sf):
    state = streams.run_to_table(streams.stream_health(_stream_view(spark, sf, "readings")), "x9", mode="complete")
    last = state.select("source_id", F.col("last_seen").alias("ts"))
    return joins.sensor_health(view(spark, sf, "sources"), last, AS_OF)


_COLS = ["temperature", "humidity"]


@register("x10_stream_anomaly",
          "SELECT r.id, r.source_id, r.ts, r.temperature, r.humidity, " + ", ".join(
              f"COALESCE(abs((r.{c} - s.m_{c}) / s.s_{c}) > 3.0, false) AS anomaly_{c}" for c in _COLS)
          + " FROM readings r LEFT JOIN (SELECT source_id, " + ", ".join(
              f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 "
              f"ELSE stddev_pop({c}) END AS s_{c}" for c in _COLS)
          + " FROM readings GROUP BY source_id) s ON r.source_id = s.source_id", ["readings"])
def x10(spark, sf):
    stats = series.scale_stats(view(spark, sf, "readings"), "standard", _COLS)
    r = _stream_view(spark, sf, "readings").select("id", "source_id", "ts", *_COLS)
    return streams.run_to_table(streams.stream_anomaly(r, stats, _COLS, 3.0), "x10")


_PREV = "(PARTITION BY source_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("x10_stream_running_zscore",
          "SELECT source_id, ts, humidity, z AS zscore, COALESCE(abs(z) > 3.0, false) AS anomaly FROM ("
          f"SELECT source_id, ts, humidity, CASE WHEN humidity IS NOT NULL AND stddev_samp(humidity) OVER {_PREV} > 0 "
          f"THEN (humidity - avg(humidity) OVER {_PREV}) / stddev_samp(humidity) OVER {_PREV} END AS z FROM readings)",
          ["readings"], rnd=["zscore"])
def x10r(spark, sf):
    r = _stream_view(spark, sf, "readings")
    return streams.running_zscore_table(r, "humidity", 3.0)


@register("x11_dedup_messages", "SELECT DISTINCT topic, payload FROM messages", ["messages"])
def x11(spark, sf):
    m = _stream_view(spark, sf, "messages").select("topic", "payload", "received_at")
    return streams.run_to_table(streams.dedup_messages(m), "x11").select("topic", "payload")
