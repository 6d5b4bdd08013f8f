"""Structured Streaming: batch/stream parity, late data, handler isolation,
running state, topic filters."""

import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.operators import stats
from envspark.streaming import streams


def test_topic_regex():
    import re
    r = re.compile(streams.topic_regex("sensors/+/temperature"))
    assert r.match("sensors/12/temperature") and not r.match("sensors/12/x/temperature")
    h = re.compile(streams.topic_regex("sensors/#"))
    assert h.match("sensors") and h.match("sensors/a/b") and not h.match("sensorsX")
    with pytest.raises(ValueError):
        streams.topic_regex("a/#/b")


def _write_batch(spark, rows, path):
    df = spark.createDataFrame(rows, "source_id long, ts timestamp_ntz, temperature double, humidity double")
    df.coalesce(1).write.mode("append").parquet(path)   # one file = one micro-batch


def _stream(spark, path):
    schema = "source_id long, ts timestamp_ntz, temperature double, humidity double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_dropped_and_windows_closed(spark, tmp_path):
    """Late input is filtered with the watermark of the previous batch, so
    the watermark is first advanced (files 1-2), then the late row comes."""
    src = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    _write_batch(spark, [(1, t0 + dt.timedelta(minutes=5), 10.0, 1.0),
                         (1, t0 + dt.timedelta(minutes=50), 20.0, 1.0),
                         (1, t0 + dt.timedelta(hours=3), 30.0, 1.0)], src)
    _write_batch(spark, [(1, t0 + dt.timedelta(hours=5), 50.0, 1.0)], src)
    # third file: a row far behind the watermark (dropped) and a closing row
    _write_batch(spark, [(1, t0 + dt.timedelta(minutes=10), 99.0, 1.0),
                         (1, t0 + dt.timedelta(hours=10), 40.0, 1.0)], src)
    out = streams.run_to_table(streams.stream_sensor_stats(_stream(spark, src), "1 hour", "10 minutes"),
                               f"t-{uuid.uuid4().hex}")
    got = {r["time_period"]: (r["avg_temperature"], r["reading_count"]) for r in out.collect()}
    assert got[t0] == (15.0, 2)                       # late 99.0 not included, window emitted once
    assert got[t0 + dt.timedelta(hours=3)] == (30.0, 1)
    assert got[t0 + dt.timedelta(hours=5)] == (50.0, 1)
    assert t0 + dt.timedelta(hours=10) not in got       # still open at the end
    assert len(got) == 3


def test_stream_batch_parity(spark, tmp_path):
    src = str(tmp_path / "in")
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(int(k), t0 + dt.timedelta(minutes=int(m)), float(v), float(h))
            for k, m, v, h in zip(rng.integers(0, 5, 300), np.sort(rng.integers(0, 600, 300)),
                                  rng.normal(20, 3, 300), rng.normal(50, 5, 300))]
    _write_batch(spark, rows, src)
    streamed = streams.run_to_table(streams.stream_health(_stream(spark, src)), f"h-{uuid.uuid4().hex}",
                                    mode="complete")
    batch = spark.read.parquet(src).groupBy("source_id").agg(F.max("ts").alias("last_seen"))
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert stats is not None


def test_on_batch_isolates_failures(spark, tmp_path):
    src = str(tmp_path / "in")
    _write_batch(spark, [(1, dt.datetime(2024, 1, 1), 1.0, 2.0)], src)
    seen, errors = [], []

    def boom(batch, epoch):
        raise RuntimeError("handler failed")

    def count(batch, epoch):
        seen.append(batch.count())

    q = (_stream(spark, src).writeStream.foreachBatch(streams.on_batch([boom, count], errors))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(seen) == 1 and len(errors) >= 1 and "handler failed" in errors[0][2]


def test_running_zscore_matches_numpy(spark, tmp_path):
    src = str(tmp_path / "in")
    rng = np.random.default_rng(5)
    vals = rng.normal(10, 2, 40)
    vals[30] = 40.0
    t0 = dt.datetime(2024, 1, 1)
    _write_batch(spark, [(1, t0 + dt.timedelta(minutes=i), 0.0, float(v)) for i, v in enumerate(vals[:20])], src)
    _write_batch(spark, [(1, t0 + dt.timedelta(minutes=20 + i), 0.0, float(v)) for i, v in enumerate(vals[20:])], src)
    out = streams.run_to_table(streams.stream_running_zscore(_stream(spark, src), "humidity", 3.0),
                               f"z-{uuid.uuid4().hex}").orderBy("ts").toPandas()
    for i in (10, 30):
        prev = vals[:i]
        z = (vals[i] - prev.mean()) / prev.std(ddof=1)
        assert abs(out.zscore.iloc[i] - z) < 1e-9
    assert bool(out.anomaly.iloc[30]) and out.anomaly.sum() == 1


def test_dedup_within_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "{1}", t), ("a", "{1}", t + dt.timedelta(minutes=1)), ("b", "{1}", t)],
                               "topic string, payload string, received_at timestamp_ntz")
    df.write.parquet(src)
    s = spark.readStream.schema(df.schema).parquet(src)
    out = streams.run_to_table(streams.dedup_messages(s), f"d-{uuid.uuid4().hex}")
    assert sorted((r["topic"], r["payload"]) for r in out.collect()) == [("a", "{1}"), ("b", "{1}")]
