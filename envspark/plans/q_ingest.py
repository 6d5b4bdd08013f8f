"""Queries: message decoding, upload validation, flight summaries
(sections 2.1, 2.4 A10-A12/A15, 2.3 J8 of the survey)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from envspark.operators import flights, stats
from envspark.plans.catalog import register
from envspark.session import checkpoint_dir
from envspark.sources import ingest
from envspark.sources.readers import aoi_bounds
from envspark.sources.views import _read, view

AS_OF = "2024-01-31 00:00:00"
T = f"TIMESTAMP '{AS_OF}'"


def V(spark, sf, name):
    return view(spark, sf, name)


def _points(spark, sf):
    ok, _ = ingest.decode_messages(V(spark, sf, "messages"))
    return ingest.messages_to_points(ok)


@register("s3_decode_messages",
          "SELECT id, topic, string_split(topic, '/')[-1] AS measurement, qos, retain, received_at FROM messages "
          "WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END", ["messages"])
def s3(spark, sf):
    ok, _ = ingest.decode_messages(V(spark, sf, "messages"))
    return ok.select("id", "topic", ingest.measurement_of("topic").alias("measurement"), "qos", "retain",
                     "received_at")


@register("s3_rejected_messages",
          "SELECT id, topic FROM messages WHERE NOT CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' "
          "ELSE false END",
          ["messages"])
def s3r(spark, sf):
    _, bad = ingest.decode_messages(V(spark, sf, "messages"))
    return bad.select("id", "topic")


_S5 = ("SELECT id, string_split(topic, '/')[-1] AS measurement, json_extract_string(payload, '$.sensor_id') "
       "AS sensor_id, k AS field, CAST(json_extract(payload, '$.\"' || k || '\"') AS DOUBLE) AS value, "
       "received_at AS time FROM (SELECT *, unnest(json_keys(payload)) AS k FROM messages "
       "WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END) "
       "WHERE json_type(payload, '$.\"' || k || '\"') IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
       "AND NOT suffix(k, '_id') AND k <> 'timestamp'")


@register("s5_messages_to_points", _S5, ["messages"])
def s5(spark, sf):
    p = _points(spark, sf)
    return p.select("id", "measurement", F.col("tags")["sensor_id"].alias("sensor_id"), "field", "value", "time")


@register("s7_write_points",
          f"SELECT id, sensor_id, field, value, time FROM ({_S5}) WHERE measurement = 'click'", ["messages"])
def s7(spark, sf):
    """Sink partitioned by measurement/date in the shared checkpoint folder,
    read back with a measurement filter (directory pruning)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/points-{uuid.uuid4().hex}"
    ingest.write_points(_points(spark, sf), path, mode="overwrite")
    back = spark.read.parquet(path).where(F.col("measurement") == "click")
    return back.select("id", F.col("tags")["sensor_id"].alias("sensor_id"), "field", "value", "time")


_UPLOAD_TS = "CASE WHEN id % 11 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"


def _reading_uploads(spark, sf):
    r = V(spark, sf, "readings")
    text = F.when(F.col("id") % 11 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return r.select("id", "source_id", text.alias("timestamp"), "temperature", "humidity", "metadata")


@register("s8_ingest_readings",
          f"SELECT r.id, r.source_id, COALESCE(TRY_CAST({_UPLOAD_TS.replace('id %', 'r.id %').replace('(ts,', '(r.ts,')} AS TIMESTAMP), {T}) AS ts, s.lon, s.lat, "
          "r.temperature, r.humidity, CAST(NULL AS VARCHAR) AS air_quality, CAST(NULL AS VARCHAR) AS water_quality, "
          "COALESCE(r.metadata, '{}') AS metadata FROM readings r JOIN sources s ON r.source_id = s.id "
          "WHERE s.type = 'iot_sensor'", ["readings", "sources"])
def s8(spark, sf):
    ok, _ = ingest.ingest_readings(_reading_uploads(spark, sf), V(spark, sf, "sources"), AS_OF)
    return ok


@register("s9_reject_readings",
          "SELECT id, source_id FROM readings r WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.id = r.source_id "
          "AND s.type = 'iot_sensor')", ["readings", "sources"])
def s9(spark, sf):
    _, bad = ingest.ingest_readings(_reading_uploads(spark, sf), V(spark, sf, "sources"), AS_OF)
    return bad.select("id", "source_id")


_IMG_UP = ("SELECT id, concat('scene_', id, CASE id % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.jp2' ELSE '' END) AS filename, "
           "'image/tiff' AS content_type, id * 10 AS size, CASE WHEN id % 4 = 0 THEN NULL ELSE source_id END AS source_id, "
           "ts FROM images")


def _image_uploads(spark, sf):
    im = V(spark, sf, "images")
    ext = F.when(F.col("id") % 3 == 0, ".tif").when(F.col("id") % 3 == 1, ".jp2").otherwise("")
    return im.select("id", F.concat(F.lit("scene_"), F.col("id").cast("string"), ext).alias("filename"),
                     F.lit("image/tiff").alias("content_type"), (F.col("id") * 10).alias("size"),
                     F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("source_id")).alias("source_id"),
                     F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


@register("s10_register_images",
          f"SELECT u.id, u.source_id, u.ts, concat('satellite/', strftime(u.ts, '%Y-%m-%d'), '/', "
          "CAST(epoch(u.ts) AS BIGINT), '_', COALESCE(CAST(u.source_id AS VARCHAR), 'unknown'), "
          "regexp_extract(u.filename, '^.+(\\.[^.]+)$', 1)) AS storage_path, "
          "CAST(json_object('original_filename', u.filename, 'content_type', u.content_type, 'size', u.size) AS VARCHAR) "
          f"AS metadata FROM ({_IMG_UP}) u LEFT JOIN sources s ON u.source_id = s.id AND s.type = 'satellite' "
          "WHERE u.source_id IS NULL OR s.id IS NOT NULL", ["images", "sources"])
def s10(spark, sf):
    ok, _ = ingest.register_images(_image_uploads(spark, sf), V(spark, sf, "sources"), "2001-08-02")
    return ok


def _detection_bodies(spark, sf):
    d = V(spark, sf, "detections")
    threat = F.when(F.col("id") % 29 == 0, F.lit("meteor")).otherwise(F.col("threat_type"))
    conf = F.when(F.col("id") % 13 != 0, F.col("confidence"))
    box = F.when(F.col("id") % 3 == 0, F.concat(F.lit("box "), F.col("id").cast("string")))
    body = F.to_json(F.struct(threat.alias("threat_type"), box.alias("bbox"), conf.alias("confidence"),
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                              F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lng")).alias("location"),
                              "source_type", "source_id", "image_id", "sensor_reading_id", "is_verified"))
    return d.select("id", body.alias("body"))


@register("s11_ingest_detections",
          "SELECT id, threat_type, confidence, ts, lon, lat, concat('POINT(', lon, ' ', lat, ')') AS location, "
          "CASE WHEN id % 3 = 0 THEN concat('box ', id) END AS bbox, "
          "source_type, source_id, image_id, sensor_reading_id, '{}' AS metadata, is_verified FROM detections "
          "WHERE id % 13 <> 0 AND id % 29 <> 0", ["detections"])
def s11(spark, sf):
    ok, _ = ingest.ingest_detections(_detection_bodies(spark, sf), AS_OF)
    return ok


@register("s11_rejected_detections",
          "SELECT id, CASE WHEN id % 13 = 0 THEN 'missing confidence' ELSE 'invalid threat_type' END AS reason "
          "FROM detections WHERE id % 13 = 0 OR id % 29 = 0", ["detections"])
def s11r(spark, sf):
    _, bad = ingest.ingest_detections(_detection_bodies(spark, sf), AS_OF)
    return bad


_NEW_SRC = ("SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'satellite' WHEN 1 THEN 'drone' "
            "ELSE 'iot_sensor' END AS type FROM supplier "
            "UNION ALL SELECT s_suppkey + 1000000, s_name, 'drone' FROM supplier "
            "UNION ALL SELECT n_nationkey + 2000000, n_name, 'lake' FROM nation "
            "UNION ALL SELECT c_custkey + 3000000, c_name, 'drone' FROM customer WHERE c_mktsegment = 'BUILDING'")


@register("s12_register_sources",
          f"SELECT id, name, type, true AS is_active FROM ({_NEW_SRC}) n WHERE type IN ('satellite', 'drone', 'iot_sensor') "
          "AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.name = n.name) AND id < 1000000", ["sources"])
def s12(spark, sf):
    sup = _read(spark, sf, "supplier")
    nat = _read(spark, sf, "nation")
    cus = _read(spark, sf, "customer")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "satellite").when(F.col("s_suppkey") % 3 == 1, "drone") \
        .otherwise("iot_sensor")
    batch = (sup.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), kind.alias("type"))
             .unionByName(sup.select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"),
                                     F.lit("drone").alias("type")))
             .unionByName(nat.select((F.col("n_nationkey") + 2000000).cast("bigint").alias("id"),
                                     F.col("n_name").alias("name"), F.lit("lake").alias("type")))
             .unionByName(cus.where(F.col("c_mktsegment") == "BUILDING").select(
                 (F.col("c_custkey") + 3000000).alias("id"), F.col("c_name").alias("name"),
                 F.lit("drone").alias("type"))))
    ok, _ = ingest.register_sources(batch, V(spark, sf, "sources"))
    return ok


@register("s14_aoi_bounds",
          "SELECT min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat "
          "FROM images", ["images"])
def s14(spark, sf):
    im = V(spark, sf, "images")
    ring = F.format_string("[[[%s, %s], [%s, %s], [%s, %s], [%s, %s], [%s, %s]]]",
                           "min_lon", "min_lat", "max_lon", "min_lat", "max_lon", "max_lat", "min_lon", "max_lat",
                           "min_lon", "min_lat")
    geo = F.concat(F.lit('{"type": "Polygon", "coordinates": '), ring, F.lit("}"))
    return aoi_bounds(im.select(geo.alias("geometry")))


@register("a10_lidar_summary",
          "SELECT file_id, count(*) AS point_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, "
          "min(z) AS min_z, max(z) AS max_z, min(intensity) AS min_intensity, max(intensity) AS max_intensity, "
          "list_sort(list_distinct(list(CAST(classification AS INTEGER)))) AS classification_codes "
          "FROM lidar GROUP BY file_id", ["lidar"], rnd=["min_intensity", "max_intensity"])
def a10(spark, sf):
    return flights.lidar_summary(V(spark, sf, "lidar"))


_A11 = ("SELECT image_id, max(col) + 1 AS width, max(row) + 1 AS height, CAST(min(value) AS DOUBLE) AS min_temp, "
        "CAST(max(value) AS DOUBLE) AS max_temp, avg(value) AS mean_temp FROM thermal GROUP BY image_id")


@register("a11_thermal_summary", _A11, ["thermal"], rnd=["mean_temp"])
def a11(spark, sf):
    return flights.thermal_summary(V(spark, sf, "thermal"))


def _frames(df):
    i = F.col("image_id").cast("double")
    return df.select("image_id", "width", "height", (i * 0.01).alias("x0"), F.lit(0.001).alias("dx"),
                     F.lit(0.0002).alias("rx"), (50 - i * 0.01).alias("y0"), F.lit(0.0001).alias("ry"),
                     F.lit(-0.001).alias("dy"))


_A12 = (f"SELECT image_id, width, height, least(x0, x0 + width * 0.001, x0 + height * 0.0002, "
        f"x0 + width * 0.001 + height * 0.0002) AS min_x, greatest(x0, x0 + width * 0.001, x0 + height * 0.0002, "
        f"x0 + width * 0.001 + height * 0.0002) AS max_x, least(y0, y0 + width * 0.0001, y0 + height * -0.001, "
        f"y0 + width * 0.0001 + height * -0.001) AS min_y, greatest(y0, y0 + width * 0.0001, y0 + height * -0.001, "
        f"y0 + width * 0.0001 + height * -0.001) AS max_y FROM (SELECT image_id, width, height, "
        f"CAST(image_id AS DOUBLE) * 0.01 AS x0, 50 - CAST(image_id AS DOUBLE) * 0.01 AS y0 FROM ({_A11}))")


@register("a12_image_footprint", _A12, ["thermal"], rnd=["min_x", "max_x", "min_y", "max_y"])
def a12(spark, sf):
    fr = flights.image_footprint(_frames(flights.thermal_summary(V(spark, sf, "thermal"))))
    return fr.select("image_id", "width", "height", "min_x", "max_x", "min_y", "max_y")


@register("a15_mean_loss",
          "SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS mean_loss, sum(l_quantity) AS samples "
          "FROM lineitem GROUP BY l_returnflag", [], rnd=["mean_loss", "samples"])
def a15(spark, sf):
    li = _read(spark, sf, "lineitem")
    return stats.mean_loss(li.select("l_returnflag", F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n")),
                           keys=["l_returnflag"])


@register("j8_flight_metadata",
          "SELECT COALESCE(l.flight_id, t.flight_id) AS flight_id, l.point_count, l.max_z, t.width, t.max_temp FROM "
          "(SELECT file_id AS flight_id, count(*) AS point_count, max(z) AS max_z FROM lidar GROUP BY 1) l FULL OUTER JOIN "
          f"(SELECT image_id AS flight_id, width, max_temp FROM ({_A11})) t ON l.flight_id = t.flight_id",
          ["lidar", "thermal"])
def j8(spark, sf):
    lid = flights.lidar_summary(V(spark, sf, "lidar")).select(
        F.col("file_id").alias("flight_id"), "point_count", "max_z")
    th = flights.thermal_summary(V(spark, sf, "thermal")).select(
        F.col("image_id").alias("flight_id"), "width", "max_temp")
    return flights.flight_metadata(lid, th)

