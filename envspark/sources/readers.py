"""File readers: sensor tables, image catalogs, vector layers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.operators.series import numeric_cols

FORMATS = ("csv", "json", "parquet")


def read_sensor(spark: SparkSession, path: str, fmt: str | None = None, time_col: str = "timestamp",
                value_cols: list[str] | None = None, schema: T.StructType | None = None, **options) -> DataFrame:
    """Csv / json / parquet by extension (or ``fmt``); the time column is
    parsed to ``timestamp_ntz``; ``value_cols`` is a projection (pushed into
    the parquet scan).  Unsupported formats and a missing time column raise
    ``ValueError``."""
    if fmt is None:
        fmt = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if fmt not in FORMATS:
        raise ValueError(f"cannot read {fmt!r} files, only {FORMATS}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true").option("inferSchema", "true" if schema is None else "false")
    for k, v in options.items():
        r = r.option(k, v)
    df = r.format(fmt).load(path)
    if time_col not in df.columns:
        raise ValueError(f"no time column {time_col!r} in {df.columns}")
    ts = F.col(time_col)
    tt = df.schema[time_col].dataType
    if isinstance(tt, T.StringType):
        ts = F.coalesce(F.try_to_timestamp(F.col(time_col)).cast("timestamp_ntz"),
                        F.to_timestamp_ntz(F.col(time_col)))
    elif not isinstance(tt, T.TimestampNTZType):
        ts = F.col(time_col).cast("timestamp_ntz")
    cols = [c for c in (value_cols if value_cols is not None else
                        [c for c in df.columns if c != time_col]) if c != time_col]
    return df.select(ts.alias(time_col), *cols)


def project_values(df: DataFrame, value_cols=None, time_col="ts", keys=()) -> DataFrame:
    """Time column kept; value columns default to all numeric ones."""
    cols = value_cols if value_cols is not None else numeric_cols(df, [*keys, time_col])
    return df.select(*keys, time_col, *[c for c in cols if c != time_col])


IMAGE_EXT = (".tif", ".tiff", ".jp2")


def scan_image_catalog(spark: SparkSession, root: str, max_samples: int | None = None) -> DataFrame:
    """Recursive image listing (``*.tif`` found), extension re-checked
    case-insensitively (tif, tiff, jp2); ``image_id`` = file stem; the
    paired label ``labels/<stem>_mask.tif`` next to the image's split folder
    (null when absent); split from a ``train``/``val``/``test`` directory.
    File contents are never read (only the file index)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[tTjJ][iIpP][fF2]*").load(root).select("path", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    lower = F.lower(name)
    ext_ok = lower.endswith(".tif") | lower.endswith(".tiff") | lower.endswith(".jp2")
    stem = F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)
    parts = F.split("path", "/")
    is_label = F.array_contains(parts, "labels")
    split = (F.when(F.array_contains(parts, "train"), "train").when(F.array_contains(parts, "val"), "val")
             .when(F.array_contains(parts, "test"), "test"))
    parent = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    images = (files.where(ext_ok & ~is_label)
              .select("path", stem.alias("image_id"), split.alias("split"), parent.alias("__dir"),
                      "length"))
    labels = (files.where(is_label & lower.endswith("_mask.tif"))
              .select(F.col("path").alias("label_path"),
                      F.regexp_extract(name, r"^(.*)_mask\.tif$", 1).alias("__stem"),
                      F.regexp_extract("path", r"^(.*)/labels/[^/]+$", 1).alias("__root")))
    # the folder beside the image goes before the one beside its parent
    labels = labels.groupBy("__stem", "__root").agg(F.min("label_path").alias("label_path"))
    up = labels.select(F.col("__stem").alias("__stem2"), F.col("__root").alias("__root2"), F.col("label_path").alias("__up"))
    j = (images.withColumn("__parent", F.regexp_extract("__dir", r"^(.*)/[^/]+$", 1))
         .join(labels, (F.col("image_id") == F.col("__stem")) & (F.col("__dir") == F.col("__root")), "left")
         .join(up, (F.col("image_id") == F.col("__stem2")) & (F.col("__parent") == F.col("__root2")), "left"))
    out = j.select("image_id", "path", F.coalesce("label_path", "__up").alias("label_path"), "split", "length")
    if max_samples is not None:
        out = out.orderBy("path").limit(max_samples)   # sampling operator: the limit is the feature
    return out


_PAIR = r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)\s*(?:,\s*-?[0-9.eE+-]+\s*)?\]"


def aoi_bounds(features: DataFrame, geometry_col: str = "geometry") -> DataFrame:
    """Bounding box of all geometries (GeoJSON geometry text of any
    nesting: Point, LineString, Polygon, Multi*).  The innermost coordinate
    pairs are extracted per row, then one global min/max aggregate."""
    coords = F.get_json_object(F.col(geometry_col), "$.coordinates")
    xs = F.regexp_extract_all(coords, F.lit(_PAIR), 1)
    ys = F.regexp_extract_all(coords, F.lit(_PAIR), 2)
    pts = features.select(F.explode(F.arrays_zip(xs.alias("x"), ys.alias("y"))).alias("p"))
    x, y = F.col("p.x").cast("double"), F.col("p.y").cast("double")
    return pts.agg(F.min(x).alias("min_lon"), F.min(y).alias("min_lat"),
                   F.max(x).alias("max_lon"), F.max(y).alias("max_lat"))


# GeoJSON collections with mixed geometry types defeat schema inference
# (coordinate nesting differs), so geometry and properties are read as raw
# JSON text through an explicit schema.
_GEOJSON = T.StructType([
    T.StructField("crs", T.StructType([T.StructField("properties", T.StructType([
        T.StructField("name", T.StringType())]))])),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("geometry", T.StringType()), T.StructField("properties", T.StringType())]))),
])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON FeatureCollection file(s) -> one row per feature:
    geometry type, geometry (JSON text), properties (JSON text), crs
    (EPSG:4326 unless the collection names another)."""
    raw = spark.read.schema(_GEOJSON).option("multiLine", "true").json(path)
    feats = raw.select(F.coalesce(F.col("crs.properties.name"), F.lit("EPSG:4326")).alias("crs"),
                       F.explode("features").alias("f"))
    return feats.select(F.get_json_object("f.geometry", "$.type").alias("geometry_type"),
                        F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"), "crs")


def flight_outputs(spark: SparkSession, out_dir: str, metadata: dict, tables: dict[str, DataFrame]) -> dict:
    """Write each table as parquet under ``out_dir`` and the flight
    metadata (with the written paths) as one JSON document; returns it."""
    meta = dict(metadata)
    for name, df in tables.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(p)
        meta[f"{name}_output_path"] = p
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(f"{out_dir.rstrip('/')}/metadata.json")
    return meta


__all__ = ["read_sensor", "project_values", "scan_image_catalog", "aoi_bounds", "read_vectors",
           "flight_outputs"]
