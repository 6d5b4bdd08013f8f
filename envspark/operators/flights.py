"""Drone flight summaries.

Point clouds and thermal frames are tables here (one row per point / pixel),
so the per-file metadata the reference computes in memory becomes one
partially-aggregated ``groupBy`` per file or frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.geo import footprint


def lidar_summary(points: DataFrame, file_col: str = "file_id", acquisition_col: str | None = None) -> DataFrame:
    """A10 (+U2): per file - point count, x/y bounds, z range, intensity
    range, sorted distinct classification codes (at most 256 values:
    bounded), acquisition date passthrough."""
    aggs = [F.count(F.lit(1)).alias("point_count"),
            F.min("x").alias("min_x"), F.min("y").alias("min_y"),
            F.max("x").alias("max_x"), F.max("y").alias("max_y"),
            F.min("z").alias("min_z"), F.max("z").alias("max_z"),
            F.min("intensity").alias("min_intensity"), F.max("intensity").alias("max_intensity"),
            F.array_sort(F.collect_set(F.col("classification").cast("int"))).alias("classification_codes")]
    if acquisition_col:
        aggs.append(F.first(acquisition_col, True).alias("acquisition_date"))
    return points.groupBy(file_col).agg(*aggs)


def thermal_summary(pixels: DataFrame, frame_col: str = "image_id", value_col: str = "value") -> DataFrame:
    """Per frame - width, height (from the largest col/row index), min,
    max and mean temperature."""
    return pixels.groupBy(frame_col).agg(
        (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"),
        F.min(value_col).cast("double").alias("min_temp"), F.max(value_col).cast("double").alias("max_temp"),
        F.avg(value_col).alias("mean_temp"))


def image_footprint(frames: DataFrame, x0="x0", dx="dx", rx="rx", y0="y0", ry="ry", dy="dy",
                    width="width", height="height") -> DataFrame:
    """Bounds of each frame from its affine geotransform (four corners,
    so rotated grids are handled)."""
    fp = footprint(x0, dx, rx, y0, ry, dy, width, height)
    return frames.select("*", *[c.alias(n) for n, c in fp.items()])


def flight_metadata(lidar: DataFrame, thermal: DataFrame, on: str = "flight_id") -> DataFrame:
    """One row per flight with whichever summaries exist (full outer)."""
    return lidar.join(thermal, on, "full_outer")
