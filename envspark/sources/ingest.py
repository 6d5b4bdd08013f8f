"""Ingest and validation of messages and uploads.

Every validator returns the accepted rows and, where the reference answers
with an error, the rejected rows as a second DataFrame - both lazily, so a
batch of any size is validated in one distributed pass instead of one
request per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.functions.geo import point_wkt
from envspark.functions.timefn import parse_iso, ts_lit

# ---------------------------------------------------------------- messages


def measurement_of(topic) -> Column:
    """The last ``/`` segment of the topic."""
    t = F.col(topic) if isinstance(topic, str) else topic
    return F.element_at(F.split(t, "/"), -1)


def decode_messages(df: DataFrame, payload_col="payload") -> tuple[DataFrame, DataFrame]:
    """S3: parse the JSON payload (``variant``).  Malformed payloads are
    not dropped silently: they come back as the second DataFrame (their
    count is the reject counter)."""
    parsed = df.withColumn("body", F.try_parse_json(F.col(payload_col)))
    # valid JSON whose first token is '{' is an object (cheaper than typing the variant)
    is_obj = F.col("body").isNotNull() & F.ltrim(F.col(payload_col)).startswith("{")
    ok = parsed.where(is_obj)
    bad = parsed.where(~F.coalesce(is_obj, F.lit(False))).drop("body")
    return ok, bad


_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def normalise_time(body: Column, received: Column, key: str = "timestamp") -> Column:
    """Payload time as ISO text (``Z`` or offset allowed) or epoch number
    (seconds; values >= 1e11 are milliseconds); anything else - missing,
    unparsable, boolean - falls back to the receive time."""
    v = F.try_variant_get(body, f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    as_text = parse_iso(F.try_variant_get(v, "$", "string"))
    num = F.try_variant_get(v, "$", "double")
    is_num = kind.isin(*_NUMERIC) | kind.startswith("DECIMAL")
    secs = F.when(F.abs(num) >= 1e11, num / 1000.0).otherwise(num)
    as_epoch = F.timestamp_micros((secs * 1_000_000).cast("long")).cast("timestamp_ntz")
    return F.coalesce(F.when(kind == "STRING", as_text), F.when(is_num, as_epoch),
                      received.cast("timestamp_ntz"))


def messages_to_points(decoded: DataFrame, topic_col="topic", received_col="received_at") -> DataFrame:
    """S5 (+S4, S6): one row per numeric field of each message:
    ``(measurement, tags map, field, value, time)``.  Fields are the
    top-level JSON numbers whose key does not end in ``_id`` (booleans and
    the timestamp are not fields); tags are ``sensor_id`` and ``location`` as
    text."""
    fields = F.try_variant_get(F.col("body"), "$", "map<string,variant>")
    tag_entries = []
    for t in ("sensor_id", "location"):
        tv = F.try_variant_get(F.col("body"), f"$.{t}", "variant")
        txt = F.when(F.schema_of_variant(tv) == "STRING", F.try_variant_get(tv, "$", "string")) \
            .otherwise(F.to_json(tv))
        tag_entries.append(F.when(tv.isNotNull(), F.struct(F.lit(t).alias("key"), txt.alias("value"))))
    tags = F.map_from_entries(F.filter(F.array(*tag_entries), lambda e: e.isNotNull()))
    base = decoded.select(
        *([F.col("id")] if "id" in decoded.columns else []),
        measurement_of(topic_col).alias("measurement"), tags.alias("tags"),
        normalise_time(F.col("body"), F.col(received_col)).alias("time"),
        F.explode(F.map_entries(fields)).alias("e"))
    kind = F.schema_of_variant(F.col("e.value"))
    numeric = kind.isin(*_NUMERIC) | kind.startswith("DECIMAL")
    return (base.where(numeric & ~F.col("e.key").endswith("_id") & (F.col("e.key") != "timestamp"))
            .select(*([F.col("id")] if "id" in decoded.columns else []), "measurement", "tags",
                    F.col("e.key").alias("field"),
                    F.try_variant_get(F.col("e.value"), "$", "double").alias("value"), "time"))


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """Sink partitioned by measurement and day - later range and
    measurement filters prune whole directories."""
    (points.withColumn("date", F.to_date("time"))
     .write.mode(mode).partitionBy("measurement", "date").parquet(path))


# ---------------------------------------------------------------- uploads

def ingest_readings(uploads: DataFrame, sources: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """S8/S9 (+J4/J5): a reading is accepted when its source exists and is an
    IoT sensor.  Missing or unparsable timestamps become ``as_of``; missing
    optional fields are null; metadata defaults to ``{}``; the location is
    the source's.  Returns (accepted, rejected)."""
    iot = sources.where(F.col("type") == "iot_sensor").select(
        F.col("id").alias("__sid"), F.col("lon").alias("lon"), F.col("lat").alias("lat"))
    cols = set(uploads.columns)

    def opt(c, typ="double"):
        return F.col(c).cast(typ) if c in cols else F.lit(None).cast(typ)

    ts_text = F.col("timestamp").cast("string") if "timestamp" in cols else F.lit(None).cast("string")
    accepted = uploads.join(iot, uploads["source_id"] == iot["__sid"], "inner").select(
        *([F.col("id")] if "id" in cols else []), "source_id",
        F.coalesce(parse_iso(ts_text), ts_lit(as_of)).alias("ts"),
        "lon", "lat", opt("temperature").alias("temperature"), opt("humidity").alias("humidity"),
        opt("air_quality", "string").alias("air_quality"), opt("water_quality", "string").alias("water_quality"),
        F.coalesce(opt("metadata", "string"), F.lit("{}")).alias("metadata"))
    rejected = uploads.join(iot, uploads["source_id"] == iot["__sid"], "left_anti")
    return accepted, rejected


def file_suffix(name) -> Column:
    """Suffix of the last path component like ``pathlib``: from the last dot
    when it is neither the first nor the last character, else empty."""
    base = F.element_at(F.split(F.col(name) if isinstance(name, str) else name, "/"), -1)
    return F.regexp_extract(base, r"^.+(\.[^.]+)$", 1)


def register_images(uploads: DataFrame, sources: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """An upload names an optional source that must be a satellite;
    storage path ``satellite/<date>/<epoch>_<source or unknown><ext>``;
    metadata JSON of file name, content type and size."""
    sat = sources.where(F.col("type") == "satellite").select(F.col("id").alias("__sid"))
    j = uploads.join(sat, uploads["source_id"] == sat["__sid"], "left")
    valid = F.col("source_id").isNull() | F.col("__sid").isNotNull()
    ts = F.coalesce(parse_iso(F.col("timestamp").cast("string")), ts_lit(as_of))
    epoch = F.unix_seconds(ts.cast("timestamp"))
    path = F.concat(F.lit("satellite/"), F.date_format(ts, "yyyy-MM-dd"), F.lit("/"), epoch.cast("string"),
                    F.lit("_"), F.coalesce(F.col("source_id").cast("string"), F.lit("unknown")),
                    file_suffix("filename"))
    meta = F.to_json(F.struct(F.col("filename").alias("original_filename"), "content_type", "size"))
    accepted = j.where(valid).select(*([F.col("id")] if "id" in uploads.columns else []), "source_id",
                                     ts.alias("ts"), path.alias("storage_path"), meta.alias("metadata"))
    rejected = j.where(~valid).drop("__sid")
    return accepted, rejected


THREAT_TYPES = ("illegal_logging", "wildfire", "water_pollution", "air_quality", "other")
SOURCE_TYPES = ("satellite", "drone", "iot_sensor")

DETECTION_SCHEMA = T.StructType([
    T.StructField("threat_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("location", T.StructType([T.StructField("lat", T.DoubleType()),
                                            T.StructField("lng", T.DoubleType())])),
    T.StructField("bbox", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("image_id", T.LongType()),
    T.StructField("sensor_reading_id", T.LongType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("is_verified", T.BooleanType()),
])


def ingest_detections(bodies: DataFrame, as_of, body_col="body") -> tuple[DataFrame, DataFrame]:
    """JSON detection bodies.  Required: threat_type, confidence,
    location{lat,lng}, source_type (enums checked).  Defaults: timestamp =
    ``as_of``, metadata ``{}``, is_verified false.  Location becomes WKT
    ``POINT(lng lat)``; ``bbox`` is kept as given (text, null if
    absent).  Returns (accepted, rejected with reason)."""
    d = bodies.withColumn("__d", F.from_json(F.col(body_col), DETECTION_SCHEMA))
    reason = (F.when(F.col("__d").isNull(), "malformed")
              .when(F.col("__d.threat_type").isNull(), "missing threat_type")
              .when(F.col("__d.confidence").isNull(), "missing confidence")
              .when(F.col("__d.location.lat").isNull() | F.col("__d.location.lng").isNull(), "missing location")
              .when(F.col("__d.source_type").isNull(), "missing source_type")
              .when(~F.col("__d.threat_type").isin(*THREAT_TYPES), "invalid threat_type")
              .when(~F.col("__d.source_type").isin(*SOURCE_TYPES), "invalid source_type"))
    d = d.withColumn("__reason", reason)
    keep = [F.col("id")] if "id" in bodies.columns else []
    accepted = d.where(F.col("__reason").isNull()).select(
        *keep, F.col("__d.threat_type").alias("threat_type"), F.col("__d.confidence").alias("confidence"),
        F.coalesce(parse_iso(F.col("__d.timestamp")), ts_lit(as_of)).alias("ts"),
        F.col("__d.location.lng").alias("lon"), F.col("__d.location.lat").alias("lat"),
        point_wkt(F.col("__d.location.lng"), F.col("__d.location.lat")).alias("location"),
        F.col("__d.bbox").alias("bbox"), F.col("__d.source_type").alias("source_type"),
        F.col("__d.source_id").alias("source_id"), F.col("__d.image_id").alias("image_id"), F.col("__d.sensor_reading_id").alias("sensor_reading_id"),
        F.coalesce(F.col("__d.metadata"), F.lit("{}")).alias("metadata"),
        F.coalesce(F.col("__d.is_verified"), F.lit(False)).alias("is_verified"))
    rejected = d.where(F.col("__reason").isNotNull()).select(*keep, F.col("__reason").alias("reason"))
    return accepted, rejected


def register_sources(new: DataFrame, existing: DataFrame, order_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Name and type required, type from the enum, names unique (first
    occurrence in the batch wins, names already present are rejected),
    ``is_active`` defaults to true."""
    cols = set(new.columns)
    reason = (F.when(F.col("name").isNull(), "missing name").when(F.col("type").isNull(), "missing type")
              .when(~F.col("type").isin(*SOURCE_TYPES), "invalid type"))
    checked = new.withColumn("__reason", reason)
    # only valid rows compete for a name
    valid = checked.where(F.col("__reason").isNull())
    w = Window.partitionBy("name").orderBy(F.col(order_col))
    ranked = (valid.withColumn("__rank", F.row_number().over(w))
              .unionByName(checked.where(F.col("__reason").isNotNull()).withColumn("__rank", F.lit(None).cast("int"))))
    taken = existing.select(F.col("name").alias("__taken")).distinct()
    j = ranked.join(taken, ranked["name"] == taken["__taken"], "left")
    final_reason = F.coalesce(F.col("__reason"), F.when(F.col("__taken").isNotNull(), "duplicate name"),
                              F.when(F.col("__rank") > 1, "duplicate name in batch"))
    j = j.withColumn("__final", final_reason)
    active = F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in cols else F.lit(True)
    accepted = j.where(F.col("__final").isNull()).select(
        *[c for c in new.columns if c != "is_active"], active.alias("is_active"))
    rejected = j.where(F.col("__final").isNotNull()).select(*new.columns, F.col("__final").alias("reason"))
    return accepted, rejected
