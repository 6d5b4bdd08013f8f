"""Message decoding, time normalisation, uploads and file readers on
hand-made inputs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from envspark.sources import ingest, readers

RECV = dt.datetime(2024, 5, 1, 12, 0, 0)


def _messages(spark, payloads):
    rows = [(i, f"sensors/{i}/temperature", p, RECV) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id long, topic string, payload string, received_at timestamp_ntz")


def test_decode_rejects_malformed(spark):
    df = _messages(spark, ['{"a": 1}', "{broken", "[1, 2]", '"text"'])
    ok, bad = ingest.decode_messages(df)
    assert [r["id"] for r in ok.collect()] == [0]
    assert sorted(r["id"] for r in bad.collect()) == [1, 2, 3]


def test_points_fields_and_tags(spark):
    payload = json.dumps({"sensor_id": 7, "location": "roof", "temp": 21.5, "hum": 40, "ok": True,
                          "station_id": 3, "label": "x", "timestamp": 1700000000})
    ok, _ = ingest.decode_messages(_messages(spark, [payload]))
    pts = ingest.messages_to_points(ok).collect()
    assert sorted((r["field"], r["value"]) for r in pts) == [("hum", 40.0), ("temp", 21.5)]
    assert pts[0]["measurement"] == "temperature"
    assert pts[0]["tags"] == {"sensor_id": "7", "location": "roof"}
    assert pts[0]["time"] == dt.datetime(2023, 11, 14, 22, 13, 20)


@pytest.mark.parametrize("ts,want", [
    ('"2024-01-02T03:04:05Z"', dt.datetime(2024, 1, 2, 3, 4, 5)),
    ('"2024-01-02T03:04:05+02:00"', dt.datetime(2024, 1, 2, 1, 4, 5)),
    ("1700000000", dt.datetime(2023, 11, 14, 22, 13, 20)),
    ("1700000000500", dt.datetime(2023, 11, 14, 22, 13, 20, 500000)),
    ('"not a time"', RECV),
    ("true", RECV),
    (None, RECV),
])
def test_normalise_time(spark, ts, want):
    body = '{"v": 1' + ("" if ts is None else f', "timestamp": {ts}') + "}"
    ok, _ = ingest.decode_messages(_messages(spark, [body]))
    got = ok.select(ingest.normalise_time(F.col("body"), F.col("received_at")).alias("t")).first()["t"]
    assert got == want


def test_register_sources_rules(spark):
    new = spark.createDataFrame([(1, "a", "drone", None), (2, "a", "drone", None), (3, "b", "lake", None),
                                 (4, None, "drone", None), (5, "taken", "satellite", False), (6, "c", "iot_sensor", False)],
                                "id long, name string, type string, is_active boolean")
    existing = spark.createDataFrame([("taken",)], "name string")
    ok, bad = ingest.register_sources(new, existing)
    assert sorted((r["id"], r["is_active"]) for r in ok.collect()) == [(1, True), (6, False)]
    reasons = {r["id"]: r["reason"] for r in bad.collect()}
    assert reasons == {2: "duplicate name in batch", 3: "invalid type", 4: "missing name", 5: "duplicate name"}


def test_file_suffix(spark):
    df = spark.createDataFrame([("a.tif",), ("b.tar.gz",), ("noext",), (".hidden",), ("dir.x/file",)], "f string")
    assert [r[0] for r in df.select(ingest.file_suffix("f")).collect()] == [".tif", ".gz", "", "", ""]


def test_read_sensor_formats(spark, tmp_path):
    import pandas as pd
    pdf = pd.DataFrame({"timestamp": ["2024-01-01 00:00:00", "2024-01-01 01:00:00"], "t": [1.0, 2.0], "h": [3, 4]})
    pdf.to_csv(tmp_path / "s.csv", index=False)
    pdf.to_json(tmp_path / "s.json", orient="records", lines=True)
    pdf.to_parquet(tmp_path / "s.parquet")
    for ext in ("csv", "json", "parquet"):
        df = readers.read_sensor(spark, str(tmp_path / f"s.{ext}"), value_cols=["t"])
        assert df.columns == ["timestamp", "t"]
        assert [r["t"] for r in df.orderBy("timestamp").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError):
        readers.read_sensor(spark, str(tmp_path / "s.hdf"))
    with pytest.raises(ValueError):
        readers.read_sensor(spark, str(tmp_path / "s.csv"), time_col="when")


def test_scan_image_catalog(spark, tmp_path):
    for p in ["train/a.tif", "train/b.TIFF", "val/c.jp2", "test/d.png", "train/labels/a_mask.tif"]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"xx")
    rows = {r["image_id"]: r for r in readers.scan_image_catalog(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["split"] == "train" and rows["a"]["label_path"].endswith("labels/a_mask.tif")
    assert rows["b"]["label_path"] is None and rows["c"]["split"] == "val"
    assert readers.scan_image_catalog(spark, str(tmp_path), max_samples=2).count() == 2


def test_vectors_and_aoi(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [-1.5, 2.0]}},
        {"type": "Feature", "properties": {"n": 2},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [3, 0], [3, 4], [0, 0]]]}}]}
    (tmp_path / "v.geojson").write_text(json.dumps(fc))
    v = readers.read_vectors(spark, str(tmp_path / "v.geojson"))
    assert sorted(r["geometry_type"] for r in v.collect()) == ["Point", "Polygon"]
    b = readers.aoi_bounds(v).first()
    assert (b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"]) == (-1.5, 0.0, 3.0, 4.0)


def test_flight_outputs(spark, tmp_path):
    t = spark.createDataFrame([(1, 2.0)], "a long, b double")
    meta = readers.flight_outputs(spark, str(tmp_path / "out"), {"flight": "f1"}, {"lidar_points": t})
    assert os.path.isdir(meta["lidar_points_output_path"])
    text = spark.read.text(str(tmp_path / "out" / "metadata.json")).first()[0]
    assert json.loads(text)["flight"] == "f1"
