"""Queries: listings, top-k, dashboard aggregates, joins, set ops, scalar
functions (sections 2.2-2.8 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.functions import geo
from envspark.functions.timefn import calendar_features, parse_iso
from envspark.operators import joins, listing, stats
from envspark.plans import dashboard
from envspark.plans.catalog import register
from envspark.sources.views import view

AS_OF = "2024-01-31 00:00:00"          # fixed clock for readings / detections
IMG_AS_OF = "2001-08-02 00:00:00"      # fixed clock for images
T = f"TIMESTAMP '{AS_OF}'"
TI = f"TIMESTAMP '{IMG_AS_OF}'"

RCOLS = "id, source_id, ts, sensor_type, temperature, humidity, metadata"
DCOLS = ("id, threat_type, confidence, ts, lon, lat, source_type, source_id, image_id, "
         "sensor_reading_id, is_verified")
ICOLS = "id, source_id, ts, min_lon, min_lat, max_lon, max_lat, cloud_cover, resolution"


def V(spark, sf, name):
    return view(spark, sf, name)


# ---------------------------------------------------------------- listings
@register("f1_list_readings",
          f"SELECT {RCOLS} FROM readings WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' "
          f"AND ts <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts DESC, id LIMIT 1000 OFFSET 10",
          ["readings"])
def f1(spark, sf):
    return listing.list_readings(V(spark, sf, "readings"), start="2024-01-10",
                                 end="2024-01-20 12:00:00", limit=1000, offset=10).items


@register("f1_list_readings_source",
          f"SELECT {RCOLS} FROM readings WHERE source_id = 7 ORDER BY ts DESC, id LIMIT 1000", ["readings"])
def f1b(spark, sf):
    return listing.list_readings(V(spark, sf, "readings"), source_id=7).items


@register("a7_total_count",
          "SELECT count(*) AS total FROM readings WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' "
          "AND ts <= TIMESTAMP '2024-01-20 12:00:00'", ["readings"])
def a7(spark, sf):
    return listing.list_readings(V(spark, sf, "readings"), start="2024-01-10",
                                 end="2024-01-20 12:00:00").total


@register("c4_json_path_eq",
          f"SELECT {RCOLS} FROM readings WHERE json_extract_string(metadata, '$.k') = '42' "
          "ORDER BY ts DESC, id LIMIT 1000", ["readings"])
def c4(spark, sf):
    return listing.list_readings(V(spark, sf, "readings"), metadata={"k": 42}).items


@register("f2_list_detections",
          f"SELECT {DCOLS} FROM detections WHERE threat_type = 'wildfire' AND ts >= TIMESTAMP '2024-01-05 00:00:00' "
          "AND lon >= -100 AND lon <= 100 AND lat >= -50 AND lat <= 50 ORDER BY ts DESC, id LIMIT 100",
          ["detections"])
def f2(spark, sf):
    return listing.list_detections(V(spark, sf, "detections"), threat_type="wildfire", start="2024-01-05",
                                   bbox="-100,-50,100,50").items


@register("f2_list_detections_total",
          "SELECT count(*) AS total FROM detections WHERE source_type = 'drone' "
          "AND lon >= -100 AND lon <= 100 AND lat >= -50 AND lat <= 50", ["detections"])
def f2t(spark, sf):
    return listing.list_detections(V(spark, sf, "detections"), source_type="drone",
                                   bbox="-100,-50,100,50").total


@register("f3_list_images",
          f"SELECT {ICOLS} FROM images WHERE ts >= TIMESTAMP '1998-01-01 00:00:00' AND "
          "min_lon <= 30 AND max_lon >= -10 AND min_lat <= 40 AND max_lat >= -10 "
          "ORDER BY ts DESC, id LIMIT 100 OFFSET 5", ["images"])
def f3(spark, sf):
    return listing.list_images(V(spark, sf, "images"), start="1998-01-01", bbox="-10,-10,30,40",
                               limit=100, offset=5).items


@register("f4_list_sources",
          "SELECT id, name, type, is_active, lon, lat FROM sources WHERE type = 'iot_sensor' AND is_active "
          "ORDER BY name, id LIMIT 100", ["sources"])
def f4(spark, sf):
    return listing.list_sources(V(spark, sf, "sources"), type="iot_sensor", is_active=True).items


@register("f5_get_image", f"SELECT {ICOLS} FROM images WHERE id = 1000", ["images"])
def f5(spark, sf):
    return listing.get_by_id(V(spark, sf, "images"), 1000)


@register("f6_latest_image",
          f"SELECT {ICOLS} FROM images WHERE ts >= {TI} - INTERVAL 30 DAY AND ts <= {TI} "
          "ORDER BY ts DESC, id LIMIT 1", ["images"])
def f6(spark, sf):
    return listing.latest_image(V(spark, sf, "images"), IMG_AS_OF, "30d")


@register("f6_latest_image_per_source",
          f"SELECT source_id, id, ts, cloud_cover FROM (SELECT source_id, id, ts, cloud_cover, "
          f"row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id) AS rn FROM images "
          f"WHERE ts >= {TI} - INTERVAL 365 DAY) WHERE rn = 1", ["images"])
def f6b(spark, sf):
    from envspark.functions.timefn import look_back, ts_lit
    start, _ = look_back(IMG_AS_OF, "365d")
    im = V(spark, sf, "images").where(F.col("ts") >= ts_lit(start)).select("source_id", "id", "ts", "cloud_cover")
    return listing.latest_per_key(im, ["source_id"])


@register("f8_parse_point_wkt", "SELECT id, lon AS plon, lat AS plat FROM detections", ["detections"])
def f8(spark, sf):
    d = V(spark, sf, "detections")
    lon, lat = geo.parse_point_wkt(geo.point_wkt("lon", "lat"))
    return d.select("id", lon.alias("plon"), lat.alias("plat"))


@register("f8_parse_point_wkt_malformed",
          "SELECT id, CAST(NULL AS DOUBLE) AS plon FROM detections WHERE id % 2 = 0 "
          "UNION ALL SELECT id, lon AS plon FROM detections WHERE id % 2 = 1", ["detections"])
def f8b(spark, sf):
    d = V(spark, sf, "detections")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(")"))) \
        .otherwise(geo.point_wkt("lon", "lat"))
    lon, _ = geo.parse_point_wkt(text)
    return d.select("id", lon.alias("plon"))


@register("f9_point_in_bbox",
          "SELECT id FROM detections WHERE lon >= -20.5 AND lon <= 45.25 AND lat >= -10 AND lat <= 60",
          ["detections"])
def f9(spark, sf):
    return V(spark, sf, "detections").where(geo.point_in_bbox("lon", "lat", "-20.5,-10,45.25,60")).select("id")


@register("f10_boxes_intersect",
          "SELECT id FROM images WHERE min_lon <= 10 AND max_lon >= 0 AND min_lat <= 5 AND max_lat >= -5",
          ["images"])
def f10(spark, sf):
    return V(spark, sf, "images").where(
        geo.boxes_intersect("min_lon", "min_lat", "max_lon", "max_lat", "0,-5,10,5")).select("id")


@register("f11_bbox_wkt",
          "SELECT id, concat('POLYGON((', min_lon, ' ', min_lat, ', ', max_lon, ' ', min_lat, ', ', max_lon, ' ', "
          "max_lat, ', ', min_lon, ' ', max_lat, ', ', min_lon, ' ', min_lat, '))') AS wkt FROM images",
          ["images"])
def f11(spark, sf):
    return V(spark, sf, "images").select("id", geo.bbox_wkt("min_lon", "min_lat", "max_lon", "max_lat").alias("wkt"))


@register("f13_scene_interval",
          f"SELECT {ICOLS} FROM images WHERE ts >= {TI} - INTERVAL 30 DAY AND ts <= {TI}", ["images"])
def f13(spark, sf):
    from envspark.functions.timefn import scene_interval, ts_lit
    s, e = scene_interval(IMG_AS_OF, 30)
    return V(spark, sf, "images").where((F.col("ts") >= ts_lit(s)) & (F.col("ts") <= ts_lit(e)))


# ---------------------------------------------------------------- top-k
@register("t1_latest_detections", f"SELECT {DCOLS} FROM detections ORDER BY ts DESC, id LIMIT 5", ["detections"])
def t1(spark, sf):
    return listing.latest(V(spark, sf, "detections"), 5)


@register("t2_latest_readings", f"SELECT {RCOLS} FROM readings ORDER BY ts DESC, id LIMIT 5", ["readings"])
def t2(spark, sf):
    return listing.latest(V(spark, sf, "readings"), 5)


@register("t3_alerts",
          f"SELECT {DCOLS} FROM detections WHERE confidence >= 0.7 ORDER BY ts DESC, id LIMIT 10", ["detections"])
def t3(spark, sf):
    return listing.alerts(V(spark, sf, "detections"), 0.7, 10)


@register("t4_page", f"SELECT {DCOLS} FROM detections ORDER BY ts DESC, id LIMIT 50 OFFSET 20", ["detections"])
def t4(spark, sf):
    return listing.page(V(spark, sf, "detections"), listing.newest_first(), 20, 50)


@register("t4_keyset_page",
          f"SELECT {DCOLS} FROM detections WHERE ts < TIMESTAMP '2024-01-20 00:00:00' "
          "ORDER BY ts DESC, id LIMIT 50", ["detections"])
def t4k(spark, sf):
    return listing.keyset_page(V(spark, sf, "detections"), "2024-01-20 00:00:00", -1, 50)


@register("t5_sort_by_time", "SELECT id, source_id, ts FROM readings", ["readings"])
def t5(spark, sf):
    return listing.sort_by_time(V(spark, sf, "readings").select("id", "source_id", "ts"), ["source_id"], "ts", "id")


@register("t6_least_cloud_mosaic",
          "SELECT cell_x, cell_y, id, source_id, ts, cloud_cover FROM (SELECT "
          "CAST(floor((min_lon + max_lon) / 2 / 10.0) AS BIGINT) AS cell_x, "
          "CAST(floor((min_lat + max_lat) / 2 / 10.0) AS BIGINT) AS cell_y, id, source_id, ts, cloud_cover, "
          "row_number() OVER (PARTITION BY floor((min_lon + max_lon) / 2 / 10.0), floor((min_lat + max_lat) / 2 / 10.0) "
          f"ORDER BY cloud_cover, id) AS rn FROM images WHERE ts >= {TI} - INTERVAL 365 DAY AND ts <= {TI}) WHERE rn = 1",
          ["images"], rnd=["cloud_cover"])
def t6(spark, sf):
    return listing.least_cloud_mosaic(V(spark, sf, "images"), IMG_AS_OF, "365d", 10.0)


# ---------------------------------------------------------------- aggregates
_LABEL = {"hour": "%Y-%m-%d %H:00:00", "day": "%Y-%m-%d", "week": "%G-%V", "month": "%Y-%m"}
_RANGE = {"hour": ("2d", "2 DAY"), "day": ("7d", "7 DAY"), "week": ("30d", "30 DAY"), "month": ("30d", "30 DAY")}


def _a1(unit):
    rng, sql_rng = _RANGE[unit]

    @register(f"a1_detection_stats_{unit}",
              f"SELECT date_trunc('{unit}', ts) AS time_period, threat_type, count(*) AS count, "
              f"avg(confidence) AS avg_confidence, strftime(date_trunc('{unit}', ts), '{_LABEL[unit]}') AS label "
              f"FROM detections WHERE ts >= {T} - INTERVAL {sql_rng} GROUP BY ALL", ["detections"],
              rnd=["avg_confidence"])
    def q(spark, sf):
        return stats.detection_stats(V(spark, sf, "detections"), AS_OF, rng, unit)
    return q


for _u in ("hour", "day", "week", "month"):
    _a1(_u)


@register("a2_detection_stats_nested",
          "SELECT label, '{' || string_agg('\"' || threat_type || '\":' || CAST(json_object('count', count, "
          "'avg_confidence', round(avg_confidence, 6)) AS VARCHAR), ',' ORDER BY threat_type) || '}' AS stats "
          "FROM (SELECT strftime(date_trunc('day', "
          f"ts), '%Y-%m-%d') AS label, threat_type, count(*) AS count, avg(confidence) AS avg_confidence FROM detections "
          f"WHERE ts >= {T} - INTERVAL 7 DAY GROUP BY ALL) GROUP BY label", ["detections"])
def a2(spark, sf):
    """The nested map as JSON text (entries in threat order, averages to 6 decimals)."""
    nested = stats.detection_stats_nested(V(spark, sf, "detections"), AS_OF, "7d", "day")
    rounded = F.transform_values("stats", lambda k, v: F.struct(v["count"].alias("count"),
                                                                F.round(v["avg_confidence"], 6).alias("avg_confidence")))
    return nested.select("label", F.to_json(rounded).alias("stats"))


_A3 = {"minute": ("24h", "24 HOUR"), "hour": ("7d", "7 DAY"), "day": ("30d", "30 DAY")}


def _a3(unit):
    rng, sql_rng = _A3[unit]

    @register(f"a3_sensor_stats_{unit}",
              f"SELECT date_trunc('{unit}', ts) AS time_period, source_id, avg(temperature) AS avg_temperature, "
              f"avg(humidity) AS avg_humidity, count(*) AS reading_count FROM readings "
              f"WHERE ts >= {T} - INTERVAL {sql_rng} GROUP BY ALL", ["readings"],
              rnd=["avg_temperature", "avg_humidity"])
    def q(spark, sf):
        return stats.sensor_stats(V(spark, sf, "readings"), AS_OF, rng, unit)
    return q


for _u in ("minute", "hour", "day"):
    _a3(_u)


@register("a3_sensor_stats_one_source",
          "SELECT date_trunc('hour', ts) AS time_period, source_id, avg(temperature) AS avg_temperature, "
          "avg(humidity) AS avg_humidity, count(*) AS reading_count FROM readings "
          f"WHERE ts >= {T} - INTERVAL 24 HOUR AND source_id = 3 GROUP BY ALL", ["readings"],
          rnd=["avg_temperature", "avg_humidity"])
def a3_one(spark, sf):
    return stats.sensor_stats(V(spark, sf, "readings"), AS_OF, "bogus", "hour", source_id=3)


@register("a4_detection_counts",
          f"SELECT threat_type, count(*) AS count FROM detections WHERE ts >= {T} - INTERVAL 7 DAY GROUP BY 1",
          ["detections"])
def a4(spark, sf):
    return stats.detection_counts(V(spark, sf, "detections"), AS_OF, "7d")


@register("a5_source_counts", "SELECT type, count(*) AS count FROM sources WHERE is_active GROUP BY 1", ["sources"])
def a5(spark, sf):
    return stats.source_counts(V(spark, sf, "sources"))


_OVERVIEW = f"""
SELECT 'detection_counts' AS section, threat_type AS key, count(*) AS count, CAST(NULL AS TIMESTAMP) AS ts,
       CAST(NULL AS DOUBLE) AS value FROM detections WHERE ts >= {T} - INTERVAL 7 DAY GROUP BY threat_type
UNION ALL SELECT 'sensor_counts', type, count(*), NULL, NULL FROM sources WHERE is_active GROUP BY type
UNION ALL SELECT * FROM (SELECT 'latest_detections', CAST(id AS VARCHAR), NULL, ts, confidence FROM detections
                         ORDER BY ts DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'latest_readings', CAST(id AS VARCHAR), NULL, ts, temperature FROM readings
                         ORDER BY ts DESC, id LIMIT 5)
UNION ALL SELECT 'time_range', 'start', NULL, {T} - INTERVAL 7 DAY, NULL
"""


@register("a6_overview", _OVERVIEW, ["detections", "sources", "readings"])
def a6(spark, sf):
    return dashboard.overview(V(spark, sf, "detections"), V(spark, sf, "readings"), V(spark, sf, "sources"),
                              AS_OF, "7d")


_MOM = " UNION ALL ".join(
    f"SELECT source_id, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, stddev_pop({c}) AS std_pop, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, quantile_cont({c}, 0.5) AS median, "
    f"count_if({c} IS NULL) AS nulls, count({c}) AS count FROM readings GROUP BY source_id"
    for c in ("temperature", "humidity"))


@register("a8_column_moments", _MOM, ["readings"], rnd=["mean", "std", "std_pop", "min", "max", "median"])
def a8(spark, sf):
    return stats.column_moments(V(spark, sf, "readings"), ["temperature", "humidity"])


@register("a9_quantiles",
          "SELECT source_id, " + ", ".join(
              f"quantile_cont({c}, {p}) AS {c}_q{int(p * 100):02d}"
              for c in ("temperature", "humidity") for p in (0.1, 0.5, 0.9)) + " FROM readings GROUP BY source_id",
          ["readings"], rnd=[f"{c}_q{q}" for c in ("temperature", "humidity") for q in ("10", "50", "90")])
def a9(spark, sf):
    return stats.quantiles(V(spark, sf, "readings"), ["temperature", "humidity"], (0.1, 0.5, 0.9))


# ---------------------------------------------------------------- joins
@register("j1_sensor_health",
          f"SELECT s.id, s.name, s.type, CASE WHEN l.last_seen IS NULL THEN 'offline' "
          f"WHEN epoch({T}) - epoch(l.last_seen) < 3600 THEN 'online' "
          f"WHEN epoch({T}) - epoch(l.last_seen) < 86400 THEN 'warning' ELSE 'error' END AS status, "
          f"l.last_seen, s.lon, s.lat FROM sources s LEFT JOIN (SELECT source_id, max(ts) AS last_seen "
          f"FROM readings GROUP BY source_id) l ON s.id = l.source_id "
          f"WHERE s.is_active AND s.type IN ('iot_sensor', 'drone')", ["sources", "readings"])
def j1(spark, sf):
    return joins.sensor_health(V(spark, sf, "sources"), V(spark, sf, "readings"), AS_OF)


@register("j2_join_sources",
          "SELECT r.id, r.source_id, r.ts, r.temperature, s.name AS source_name, s.type AS source_kind, "
          "s.lon AS source_lon, s.lat AS source_lat FROM readings r JOIN sources s ON r.source_id = s.id",
          ["readings", "sources"])
def j2(spark, sf):
    r = V(spark, sf, "readings").select("id", "source_id", "ts", "temperature")
    return joins.join_sources(r, V(spark, sf, "sources"))


@register("j3_detections_with_evidence",
          "SELECT d.id, d.threat_type, d.confidence, d.ts, d.image_id, d.sensor_reading_id, i.ts AS image_ts, "
          "i.cloud_cover AS image_cloud_cover, r.ts AS reading_ts, r.temperature AS reading_temperature "
          "FROM detections d LEFT JOIN images i ON d.image_id = i.id "
          "LEFT JOIN readings r ON d.sensor_reading_id = r.id", ["detections", "images", "readings"],
          rnd=["image_cloud_cover"])
def j3(spark, sf):
    return joins.detections_with_evidence(V(spark, sf, "detections"), V(spark, sf, "images"),
                                          V(spark, sf, "readings"))


@register("j7_detections_in_images",
          "SELECT d.id AS detection_id, i.id AS image_id FROM detections d JOIN images i "
          "ON d.lon >= i.min_lon AND d.lon <= i.max_lon AND d.lat >= i.min_lat AND d.lat <= i.max_lat",
          ["detections", "images"])
def j7(spark, sf):
    return joins.detections_in_images(V(spark, sf, "detections"), V(spark, sf, "images"))


@register("w5_latest_per_source",
          "SELECT source_id, id, ts, temperature FROM (SELECT source_id, id, ts, temperature, row_number() OVER "
          "(PARTITION BY source_id ORDER BY ts DESC, id) AS rn FROM readings) WHERE rn = 1", ["readings"])
def w5(spark, sf):
    return listing.latest_per_key(V(spark, sf, "readings").select("source_id", "id", "ts", "temperature"))


# ---------------------------------------------------------------- set ops
@register("u1_concat_tables",
          "SELECT id, source_id, ts, temperature, NULL::DOUBLE AS confidence FROM readings "
          "UNION ALL SELECT id, source_id, ts, NULL, confidence FROM detections", ["readings", "detections"])
def u1(spark, sf):
    from envspark.operators.setops import concat_tables
    return concat_tables([V(spark, sf, "readings").select("id", "source_id", "ts", "temperature"),
                          V(spark, sf, "detections").select("id", "source_id", "ts", "confidence")])


@register("u2_distinct_codes", "SELECT DISTINCT classification FROM lidar", ["lidar"])
def u2(spark, sf):
    from envspark.operators.setops import distinct_values
    return distinct_values(V(spark, sf, "lidar"), ["classification"])


# ---------------------------------------------------------------- scalar functions
@register("c1_calendar_features",
          "SELECT id, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, "
          "CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month, "
          "isodow(ts) >= 6 AS is_weekend FROM readings", ["readings"])
def c1(spark, sf):
    r = V(spark, sf, "readings")
    return r.select("id", "ts", *[c.alias(n) for n, c in calendar_features("ts").items()])


@register("c2_date_trunc_week",
          "SELECT date_trunc('week', ts) AS week, count(*) AS n FROM readings GROUP BY 1", ["readings"])
def c2(spark, sf):
    from envspark.functions.timefn import time_bucket
    return V(spark, sf, "readings").groupBy(time_bucket("ts", "week").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@register("c3_iso_format_parse",
          "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, ts AS parsed, "
          "ts AS parsed_z FROM readings", ["readings"])
def c3(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return V(spark, sf, "readings").select(
        "id", iso.alias("iso"), parse_iso(iso).alias("parsed"), parse_iso(F.concat(iso, F.lit("Z"))).alias("parsed_z"))


@register("c5_geojson_feature",
          "SELECT id, CAST(json_object('type', 'Feature', 'geometry', json_object('type', 'Point', 'coordinates', "
          "json_array(lon, lat)), 'properties', json_object('id', id, 'threat_type', threat_type, "
          "'confidence', confidence, 'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'source_type', source_type, "
          "'is_verified', is_verified)) AS VARCHAR) AS feature FROM detections", ["detections"])
def c5(spark, sf):
    return dashboard.geojson_feature(V(spark, sf, "detections"))


@register("c6_threat_map",
          f"SELECT id, threat_type, confidence, ts, source_type, is_verified, lon, lat, 'all' AS filter "
          f"FROM detections WHERE ts >= {T} - INTERVAL 7 DAY", ["detections"])
def c6(spark, sf):
    return dashboard.threat_map(V(spark, sf, "detections"), AS_OF, "7d")


@register("c6_threat_map_wildfire",
          f"SELECT id, threat_type, confidence, ts, source_type, is_verified, lon, lat, 'wildfire' AS filter "
          f"FROM detections WHERE ts >= {T} - INTERVAL 3 DAY AND threat_type = 'wildfire'", ["detections"])
def c6w(spark, sf):
    return dashboard.threat_map(V(spark, sf, "detections"), AS_OF, "3d", "wildfire")


@register("c7_reproject_3857",
          "SELECT file_id, degrees(x * 10 / 6378137.0) AS lon, "
          "degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2) AS lat FROM lidar", ["lidar"], rnd=["lon", "lat"])
def c7(spark, sf):
    lid = V(spark, sf, "lidar")
    lon, lat = geo.reproject(F.col("x") * 10, F.col("y"), "EPSG:3857")
    return lid.select("file_id", lon.alias("lon"), lat.alias("lat"))


@register("c8_clip_nan",
          "SELECT id, CASE WHEN isnan(r) THEN -1.0 WHEN r > 0.5 THEN 0.5 WHEN r < -0.5 THEN -0.5 ELSE r END AS c "
          "FROM (SELECT id, (temperature - humidity) / (temperature + humidity + 1e-10) AS r FROM readings "
          "WHERE temperature IS NOT NULL)", ["readings"], rnd=["c"])
def c8(spark, sf):
    from envspark.functions.raster import clip_nan
    r = V(spark, sf, "readings").where(F.col("temperature").isNotNull())
    ratio = (F.col("temperature") - F.col("humidity")) / (F.col("temperature") + F.col("humidity") + 1e-10)
    return r.select("id", clip_nan(ratio, -0.5, 0.5, nan=-1.0).alias("c"))


@register("c9_mosaic_dimensions",
          "SELECT id, CAST(ceil((max_lon - min_lon) * 111320.0 * cos(radians((min_lat + max_lat) / 2)) / resolution) "
          "AS BIGINT) AS width, CAST(ceil((max_lat - min_lat) * 111320.0 / resolution) AS BIGINT) AS height "
          "FROM images", ["images"])
def c9(spark, sf):
    im = V(spark, sf, "images")
    w, h = geo.mosaic_dimensions("min_lon", "min_lat", "max_lon", "max_lat", "resolution")
    return im.select("id", w.alias("width"), h.alias("height"))
