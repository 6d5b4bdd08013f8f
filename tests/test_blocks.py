"""Series of any length: block scans, gaps of any length, row positions of a
fast sensor."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from envspark.operators import blocks, series, windows
from envspark.plans import monitor

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "source_id long, ts timestamp_ntz, a double, b double"


def _rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for key in (1, 2, None):
        at = np.sort(rng.choice(6 * n, n, replace=False))
        for i in at:
            out.append((key, T0 + dt.timedelta(minutes=int(i) * 3), *(None if rng.random() < 0.4 else float(rng.normal())
                                                                      for _ in range(2))))
    return out


def _table(df):
    cols = df.columns
    return sorted((tuple(None if v is None or v != v else (round(v, 9) if isinstance(v, float) else v) for v in r)
                   for r in df.collect()), key=lambda r: tuple(str(x) for x in r)), cols


OPERATORS = {
    "linear": lambda df, keys, via: series.fill_linear(df, ["a", "b"], keys, "ts", via),
    "ffill": lambda df, keys, via: series.fill_ffill(df, ["a", "b"], keys, "ts", via),
    "bfill": lambda df, keys, via: series.fill_bfill(df, ["a", "b"], keys, "ts", via),
    "resample": lambda df, keys, via: series.resample_mean(df, "1h", ["a", "b"], keys, "ts", via=via),
    "resample_linear": lambda df, keys, via: series.resample_fill(df, "1h", "linear", ["a", "b"], keys, "ts", edges=True, via=via),
    "asfreq": lambda df, keys, via: series.resample_asfreq(df, "9min", ["a", "b"], keys, "ts", via=via),
    "p9_ffill": lambda df, keys, via: series.preprocess_series(df, "1h", "ffill", ["a", "b"], keys, "ts", via),
    "p9_bfill": lambda df, keys, via: series.preprocess_series(df, "1h", "bfill", ["a", "b"], keys, "ts", via),
    "p13": lambda df, keys, via: series.preprocess(df, "1h", "linear", "standard", ["a", "b"], keys, "ts", via),
    "n18": lambda df, keys, via: monitor.monitor(df, ["a", "b"], keys, threshold=1.5, via=via),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_blocks_equal_windows(spark, name):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(7)
    assert _table(OPERATORS[name](df, ["source_id"], "blocks")) == _table(OPERATORS[name](df, ["source_id"], "window"))
    one = df.where("source_id = 1")
    unkeyed, keyed = _table(OPERATORS[name](one, [], None)), _table(OPERATORS[name](one, ["source_id"], "window"))
    drop = [i for i, c in enumerate(keyed[1]) if c == "source_id"]
    if "source_id" not in unkeyed[1]:
        keyed = (sorted((tuple(v for i, v in enumerate(r) if i not in drop) for r in keyed[0]),
                        key=lambda r: tuple(str(x) for x in r)), unkeyed[1])
    assert unkeyed == keyed


def _single_partitions(df):
    """Lines of the plan below each exchange into a single partition."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines, found = text.splitlines(), []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            depth = re.search(r"[A-Z]", line).start()
            for below in lines[i + 1:]:
                start = re.search(r"[A-Z]", below)
                if start is None or start.start() <= depth:
                    break
                found.append(below.strip(" :+-"))
                if "HashAggregate" in below or "SortAggregate" in below or "ObjectHashAggregate" in below:
                    found.pop()
                    break
            else:
                continue
    return [x for x in found if not re.match(r"\*?\(?\d*\)? ?(Project|Sort|AQEShuffleRead)", x)]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_unkeyed_plans_bring_no_rows_into_one_task(spark, name):
    """Only aggregates (one row per range) may go to a single partition."""
    df = spark.createDataFrame(_rows(50), SCHEMA)
    assert _single_partitions(OPERATORS[name](df, [], None)) == []
    if name in ("linear", "ffill", "bfill"):           # the window form is what the test must be able to see
        assert _single_partitions(OPERATORS[name](df, [], "window")) != []


def test_ten_year_gap_at_one_second(spark):
    """A stray old stamp: 315 million gap rows, no array longer than STEPS."""
    rows = [(1, dt.datetime(2014, 1, 1), 1.0, None), (1, dt.datetime(2024, 1, 1), 2.0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = series.resample_mean(df, "1s", ["a"], ["source_id"], "ts").agg(
        F.count(F.lit(1)).alias("n"), F.count("a").alias("known"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    n = int((rows[1][1] - rows[0][1]).total_seconds()) + 1
    assert (got.n, got.known, got.lo, got.hi) == (n, 2, rows[0][1], rows[1][1])


@pytest.mark.parametrize("n", [1, 2, series.STEPS - 1, series.STEPS, series.STEPS + 1, 3 * series.STEPS + 5])
def test_steps(spark, n):
    got = series._steps(spark.range(1), F.lit(n).cast("long"), "k").agg(
        F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count_distinct("k").alias("d")).first()
    assert tuple(got) == (n, 0, n - 1, n)


def test_positions_of_a_fast_sensor(spark):
    """All rows of a series within one day, and many at the same moment: the
    ranges share them, and every position is given once."""
    n = 30_000
    df = spark.range(n).selectExpr("7L as source_id", "id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, floor(id / 100)) as ts",
                                   "double(id % 13) as v").repartition(6)
    base = blocks.ranges(df, ["source_id"], ["ts", "id"])
    sizes = [r["count"] for r in base.groupBy(blocks.RANGE).count().collect()]
    # the session may merge small ranges; by themselves they are even
    assert sum(sizes) == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in blocks.ranges(df, ["source_id"], ["ts", "id"]).groupBy(blocks.RANGE).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * n / 8
        got = windows.indexed_rows(df, ["source_id"], "ts", "range")[0].select("id", "__idx").collect()
        assert all(r["id"] == r["__idx"] for r in got) and len(got) == n
        r = windows.rolling_stats(df, ["v"], 24, ["source_id"], chunk="range").orderBy("id").toPandas()
        want = pd.Series(np.arange(n) % 13, dtype=float).rolling(24)
        assert np.allclose(r["v_rolling_mean"].to_numpy(dtype=float), want.mean(), equal_nan=True)
        assert np.allclose(r["v_rolling_median"].to_numpy(dtype=float), want.median(), equal_nan=True)
        ac = windows.autocorr_lag1(df, ["v"], ["source_id"], chunk="range").first()["v_autocorr_lag1"]
        assert np.isclose(ac, pd.Series(np.arange(n) % 13, dtype=float).autocorr(1))
        seq = windows.make_sequences(df, 5, 1, 7, ["v"], None, ["source_id"], chunk="range")
        assert seq.count() == (n - 6) // 7 + 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
