"""Dashboard answers composed from operators (A6 overview, C5/C6 threat map)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.timefn import look_back, ts_lit
from envspark.operators import listing, stats


def overview(detections: DataFrame, readings: DataFrame, sources: DataFrame, as_of,
             time_range="7d", n_latest: int = 5) -> DataFrame:
    """The overview as one long table
    ``(section, key, count, ts, value)``: detection counts by threat (A4),
    active sources by type (A5), latest detections (T1) and readings (T2)."""
    a4 = stats.detection_counts(detections, as_of, time_range).select(
        F.lit("detection_counts").alias("section"), F.col("threat_type").alias("key"), "count")
    a5 = stats.source_counts(sources).select(
        F.lit("sensor_counts").alias("section"), F.col("type").alias("key"), "count")
    t1 = listing.latest(detections, n_latest).select(
        F.lit("latest_detections").alias("section"), F.col("id").cast("string").alias("key"),
        "ts", F.col("confidence").alias("value"))
    t2 = listing.latest(readings, n_latest).select(
        F.lit("latest_readings").alias("section"), F.col("id").cast("string").alias("key"),
        "ts", F.col("temperature").alias("value"))
    out = a4.unionByName(a5, allowMissingColumns=True)
    out = out.unionByName(t1, allowMissingColumns=True).unionByName(t2, allowMissingColumns=True)
    start, end = look_back(as_of, time_range, "7d")
    rng = (detections.sparkSession.range(1)
           .select(F.lit("time_range").alias("section"), F.lit("start").alias("key"),
                   ts_lit(start).alias("ts")))
    return out.unionByName(rng, allowMissingColumns=True)


def geojson_feature(detections: DataFrame) -> DataFrame:
    """One GeoJSON Point feature per detection (``feature`` JSON text)."""
    props = F.struct("id", "threat_type", "confidence",
                     F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                     "source_type", "is_verified")
    geom = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return detections.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geom.alias("geometry"),
                                                      props.alias("properties"))).alias("feature"))


def threat_map(detections: DataFrame, as_of, time_range="7d", threat_type=None) -> DataFrame:
    """Features of the look-back (row per feature; scalable) with the
    threat label (``all`` when unfiltered)."""
    start, _ = look_back(as_of, time_range, "7d")
    df = detections.where(F.col("ts") >= ts_lit(start))
    if threat_type:
        df = df.where(F.col("threat_type") == threat_type)
    df = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return df.select("id", "threat_type", "confidence", "ts", "source_type", "is_verified", "lon", "lat",
                     F.lit(threat_type or "all").alias("filter"))

