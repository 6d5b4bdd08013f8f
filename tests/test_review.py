"""Cases found in review: invalid first occurrences, many bands, two masks."""

from envspark.operators.raster import pixel_bands
from envspark.sources.ingest import register_sources
from envspark.sources.readers import scan_image_catalog


def test_invalid_first_occurrence_does_not_take_the_name(spark):
    new = spark.createDataFrame([(1, "a", "lake"), (2, "a", "drone"), (3, "a", "drone"), (4, None, "drone")],
                                "id int, name string, type string")
    accepted, rejected = register_sources(new, spark.createDataFrame([], "name string"))
    assert [r.id for r in accepted.collect()] == [2]
    assert {r.id: r.reason for r in rejected.collect()} == {1: "invalid type", 3: "duplicate name in batch", 4: "missing name"}


def test_requested_band_after_many_others(spark):
    rows = [(1, 0, 0, f"A{i:04d}", float(i)) for i in range(1100)] + [(1, 0, 0, "B04", 7.0)]
    px = spark.createDataFrame(rows, "image_id int, row int, col int, band string, value double")
    r = pixel_bands(px).collect()
    assert [(x.B04, x.B03) for x in r] == [(7.0, None)]
    assert pixel_bands(px.where("band <> 'B04'")).columns[-3:] == ["A0000", "A0001", "A0002"]


def test_image_with_two_masks_is_listed_once(spark, tmp_path):
    for f in ("train/images/a.tif", "train/images/labels/a_mask.tif", "train/labels/a_mask.tif"):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    r = scan_image_catalog(spark, str(tmp_path)).collect()
    assert [(x.image_id, x.label_path.endswith("images/labels/a_mask.tif")) for x in r] == [("a", True)]


def test_point_query_is_sorted_and_prunes_dates(spark, tmp_path):
    from envspark.operators.listing import query_points
    rows = [(f"2024-01-{d:02d} 10:00:00", f"2024-01-{d:02d}", "m", {"s": str(d % 2)}, "f", float(d)) for d in range(1, 21)]
    df = spark.createDataFrame(rows, "time string, date string, measurement string, tags map<string,string>, field string, value double")
    df = df.withColumn("time", df.time.cast("timestamp_ntz")).withColumn("date", df.date.cast("date"))
    df.write.partitionBy("measurement", "date").parquet(str(tmp_path / "points"))
    got = query_points(spark.read.parquet(str(tmp_path / "points")), "m", "2024-01-05", "2024-01-10")
    assert [r.value for r in got.collect()] == [5.0, 6.0, 7.0, 8.0, 9.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert filters and all("date" in x.split("PartitionFilters")[1] for x in filters)


def test_running_zscore_in_time_order_over_small_batches(spark, tmp_path):
    import random
    import statistics
    from envspark.streaming import streams
    rng = random.Random(1)
    rows = [(i, "s", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rng.random()) for i in range(200)]
    values = [r[3] for r in rows]
    rng.shuffle(rows)
    src = str(tmp_path / "src")
    df = spark.createDataFrame(rows, "id int, source_id string, ts string, v double")
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(src)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        out = streams.run_to_table(streams.stream_running_zscore(stream, "v"), "zs").orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for i in (2, 50, 199):
        before = values[:i]
        assert abs(out[i].zscore - (values[i] - statistics.mean(before)) / statistics.stdev(before)) < 1e-9
