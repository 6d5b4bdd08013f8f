"""Joins (J1-J5, J7-J9).

Strategy: pre-aggregate before joining wherever the reference does a
per-row lookup (J1 is an N+1 loop there), keep joins as equi-joins, and let
AQE pick broadcast vs sort-merge from runtime sizes - explicit broadcast
hints are only used for sides with a proven bound.  The spatial join (J7)
is turned into an equi-join on grid cells so it never becomes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.timefn import epoch_seconds, ts_lit

HEALTH_TYPES = ("iot_sensor", "drone")


def sensor_health(sources: DataFrame, readings: DataFrame, as_of) -> DataFrame:
    """Active IoT and drone sources with their last reading and status:
    never seen -> offline, < 1 h -> online, < 24 h -> warning, else error.
    The latest reading is a partial ``max`` per source, then one left join."""
    last = readings.groupBy("source_id").agg(F.max("ts").alias("last_seen"))
    active = sources.where(F.col("is_active") & F.col("type").isin(*HEALTH_TYPES))
    j = active.join(last, active["id"] == last["source_id"], "left")
    age = epoch_seconds(ts_lit(as_of)) - epoch_seconds(F.col("last_seen"))
    status = (F.when(F.col("last_seen").isNull(), "offline").when(age < 3600, "online")
              .when(age < 86400, "warning").otherwise("error"))
    return j.select(active["id"], "name", "type", status.alias("status"), "last_seen", "lon", "lat")


def join_sources(df: DataFrame, sources: DataFrame, how: str = "inner", fk: str = "source_id") -> DataFrame:
    """Enrich rows with their source (name, type, location)."""
    s = sources.select(F.col("id").alias("__sid"), F.col("name").alias("source_name"),
                       F.col("type").alias("source_kind"), F.col("lon").alias("source_lon"),
                       F.col("lat").alias("source_lat"))
    return df.join(s, df[fk] == s["__sid"], how).drop("__sid")


def detections_with_evidence(detections: DataFrame, images: DataFrame, readings: DataFrame) -> DataFrame:
    """Detection -> image and -> sensor reading (nullable FKs, left joins)."""
    img = images.select(F.col("id").alias("__iid"), F.col("ts").alias("image_ts"),
                        F.col("cloud_cover").alias("image_cloud_cover"))
    rd = readings.select(F.col("id").alias("__rid"), F.col("ts").alias("reading_ts"),
                         F.col("temperature").alias("reading_temperature"))
    d = detections.select("id", "threat_type", "confidence", "ts", "image_id", "sensor_reading_id")
    return (d.join(img, d["image_id"] == img["__iid"], "left")
            .join(rd, d["sensor_reading_id"] == rd["__rid"], "left").drop("__iid", "__rid"))


def semi(df: DataFrame, other: DataFrame, on, how="left_semi") -> DataFrame:
    """EXISTS / NOT EXISTS."""
    return df.join(other, on, how)


def grid_cells(min_x, min_y, max_x, max_y, cell) -> F.Column:
    """All (cx, cy) cells of size ``cell`` a closed box touches."""
    x0, x1 = F.floor(min_x / cell), F.floor(max_x / cell)
    y0, y1 = F.floor(min_y / cell), F.floor(max_y / cell)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda cx: F.transform(
        F.sequence(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def grid_candidates(points: DataFrame, x: str, y: str, boxes: DataFrame, min_x: str, min_y: str,
                    max_x: str, max_y: str, base_cell: float = 1.0) -> DataFrame:
    """Candidate (point, box) pairs of a point-in-box join by a multi-level
    grid equi-join.  Each box uses the level whose cell (base * 2^level) is
    at least its extent, so it touches at most 2 x 2 cells; each point gets
    one cell id per level that occurs among the boxes (a few integers).
    Work is O(points x levels + boxes), never points x boxes.  The caller
    refines the candidates with the exact predicate."""
    ext = F.greatest(F.col(max_x) - F.col(min_x), F.col(max_y) - F.col(min_y))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(ext, F.lit(1e-300)) / base_cell))).cast("int")
    bx = boxes.withColumn("__lvl", level).withColumn("__cell", F.lit(base_cell) * F.pow(F.lit(2.0), F.col("__lvl")))
    bx = bx.withColumn("__c", F.explode(grid_cells(F.col(min_x), F.col(min_y), F.col(max_x), F.col(max_y),
                                                  F.col("__cell"))))
    bx = bx.select("*", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy")).drop("__c", "__cell")
    # the levels present: a handful of small integers (bounded by log2 of the extent range)
    levels = [r[0] for r in bx.select("__lvl").distinct().collect()] or [0]
    pts = points.select("*", F.explode(F.array(*[F.lit(v) for v in levels])).alias("__lvl"))
    cell = F.lit(base_cell) * F.pow(F.lit(2.0), F.col("__lvl"))
    pts = pts.select("*", F.floor(F.col(x) / cell).alias("__cx"), F.floor(F.col(y) / cell).alias("__cy"))
    return pts.join(bx, ["__lvl", "__cx", "__cy"]).drop("__lvl", "__cx", "__cy")


def detections_in_images(detections: DataFrame, images: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs (detection, image) where the detection point lies in the
    image box (edges inclusive): multi-level grid equi-join (see
    ``grid_candidates``) refined with the exact box test."""
    img = images.select(F.col("id").alias("image_id"), "min_lon", "min_lat", "max_lon", "max_lat")
    pts = detections.select(F.col("id").alias("detection_id"), "lon", "lat")
    j = grid_candidates(pts, "lon", "lat", img, "min_lon", "min_lat", "max_lon", "max_lat", cell)
    return (j.where((F.col("lon") >= F.col("min_lon")) & (F.col("lon") <= F.col("max_lon"))
                    & (F.col("lat") >= F.col("min_lat")) & (F.col("lat") <= F.col("max_lat")))
            .select("detection_id", "image_id"))


def flight_metadata(lidar_summary: DataFrame, thermal_summary: DataFrame, on="flight_id") -> DataFrame:
    """Combine per-flight summaries; either side may be missing."""
    return lidar_summary.join(thermal_summary, on, "full_outer")


def mask_join(pixels: DataFrame, mask: DataFrame, keys=("image_id", "row", "col"), how="left") -> DataFrame:
    """Pixels x cloud/label mask by (image, row, col) - an equi-join on
    keys that both sides can be co-partitioned on (``image_id``)."""
    return pixels.join(mask, list(keys), how)
