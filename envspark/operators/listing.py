"""Filtered listings, paging, latest-N and top-k.

All filters are plain column predicates, so Catalyst pushes them into the
parquet scan (row-group min/max and, for partitioned sinks, directory
pruning).  Pages are ``orderBy(...).offset().limit()``, planned as a
TakeOrderedAndProject: each task keeps its own top ``offset + limit`` rows,
nothing else is shuffled.  Ties in any time order are broken by ``id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.functions.geo import boxes_intersect, point_in_bbox
from envspark.functions.timefn import look_back, ts_lit


@dataclass
class Listing:
    """Result of a listing: the page (lazy) and the total before paging."""
    items: DataFrame
    total: DataFrame  # one row, column ``total``
    offset: int
    limit: int

    def as_dict(self) -> dict:
        """Small, bounded response: at most ``limit`` rows are fetched."""
        items = [r.asDict() for r in self.items.collect()]
        return {"total": self.total.first()["total"], "count": len(items),
                "offset": self.offset, "limit": self.limit, "items": items}


def _time_range(df: DataFrame, start=None, end=None, time_col="ts") -> DataFrame:
    if start is not None:
        df = df.where(F.col(time_col) >= ts_lit(start))
    if end is not None:
        df = df.where(F.col(time_col) <= ts_lit(end))
    return df


def newest_first(time_col="ts", id_col="id") -> list[Column]:
    return [F.col(time_col).desc(), F.col(id_col).asc()]


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """T4: ordered page.  ``offset`` beyond a few thousand rows should use
    ``keyset_page`` instead (every task would keep offset+limit rows)."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must be >= 0")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def keyset_page(df: DataFrame, cursor_ts=None, cursor_id=None, limit: int = 100,
                time_col="ts", id_col="id") -> DataFrame:
    """T4 keyset variant: rows strictly after ``(cursor_ts, cursor_id)`` in
    newest-first order; constant cost per page regardless of depth."""
    if cursor_ts is not None:
        t = ts_lit(cursor_ts)
        df = df.where((F.col(time_col) < t) | ((F.col(time_col) == t) & (F.col(id_col) > F.lit(cursor_id))))
    return df.orderBy(*newest_first(time_col, id_col)).limit(limit)


def total_count(df: DataFrame) -> DataFrame:
    """Size of the filtered listing before paging (partial count)."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def json_path_eq(col: str, path: str, value) -> Column:
    """C4: JSON field equality, ``metadata->>'type' = value``."""
    return F.get_json_object(F.col(col), f"$.{path}") == F.lit(str(value))


def list_readings(readings: DataFrame, source_id=None, sensor_type=None, start=None, end=None,
                  limit: int = 1000, offset: int = 0, metadata: dict | None = None) -> Listing:
    """all filters optional and conjunctive, both time ends inclusive,
    ``sensor_type`` compares ``metadata.type``; newest first."""
    df = readings
    if source_id is not None:
        df = df.where(F.col("source_id") == F.lit(source_id))
    if sensor_type:
        df = df.where(json_path_eq("metadata", "type", sensor_type))
    for k, v in (metadata or {}).items():
        df = df.where(json_path_eq("metadata", k, v))
    df = _time_range(df, start, end)
    return Listing(page(df, newest_first(), offset, limit), total_count(df), offset, limit)


def list_detections(detections: DataFrame, threat_type=None, source_type=None, start=None, end=None,
                    bbox: str | None = None, limit: int = 100, offset: int = 0) -> Listing:
    """F2."""
    df = detections
    if threat_type:
        df = df.where(F.col("threat_type") == threat_type)
    if source_type:
        df = df.where(F.col("source_type") == source_type)
    df = _time_range(df, start, end)
    if bbox:
        df = df.where(point_in_bbox("lon", "lat", bbox))
    return Listing(page(df, newest_first(), offset, limit), total_count(df), offset, limit)


def list_images(images: DataFrame, source_id=None, start=None, end=None, bbox: str | None = None,
                limit: int = 100, offset: int = 0) -> Listing:
    """F3."""
    df = images
    if source_id is not None:
        df = df.where(F.col("source_id") == F.lit(source_id))
    df = _time_range(df, start, end)
    if bbox:
        df = df.where(boxes_intersect("min_lon", "min_lat", "max_lon", "max_lat", bbox))
    return Listing(page(df, newest_first(), offset, limit), total_count(df), offset, limit)


SOURCE_TYPES = ("satellite", "drone", "iot_sensor")


def list_sources(sources: DataFrame, type=None, is_active=None, limit: int = 100, offset: int = 0) -> Listing:
    """ordered by name (ties by id)."""
    df = sources
    if type is not None:
        if type not in SOURCE_TYPES:
            raise ValueError(f"unknown source type {type!r}")
        df = df.where(F.col("type") == type)
    if is_active is not None:
        df = df.where(F.col("is_active") == F.lit(bool(is_active)))
    return Listing(page(df, [F.col("name"), F.col("id")], offset, limit), total_count(df), offset, limit)


def get_by_id(df: DataFrame, id_value, id_col="id") -> DataFrame:
    """point lookup (parquet min/max statistics skip row groups)."""
    return df.where(F.col(id_col) == F.lit(id_value))


def latest_image(images: DataFrame, as_of, time_range="30d", source_id=None) -> DataFrame:
    """the most recent scene in the look-back window (one row)."""
    start, end = look_back(as_of, time_range, "30d")
    df = images.where((F.col("ts") >= ts_lit(start)) & (F.col("ts") <= ts_lit(end)))
    if source_id is not None:
        df = df.where(F.col("source_id") == F.lit(source_id))
    return df.orderBy(*newest_first()).limit(1)


def latest_per_key(df: DataFrame, keys=("source_id",), time_col="ts", id_col="id") -> DataFrame:
    """F6 many-source form / W5: newest row per key with ``max_by`` - a
    partial aggregate (map-side combine), skew-safe, no window sort."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col(time_col), -F.col(id_col)))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def latest(df: DataFrame, n: int = 5, time_col="ts", id_col="id") -> DataFrame:
    """Newest ``n`` rows."""
    return df.orderBy(*newest_first(time_col, id_col)).limit(n)


def alerts(detections: DataFrame, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """Confidence >= threshold, newest first, no time filter."""
    return latest(detections.where(F.col("confidence") >= F.lit(threshold)), limit)


def sort_by_time(df: DataFrame, keys=(), time_col="ts", id_col=None) -> DataFrame:
    """T5: global time order (range-partitioned sort), or with ``keys`` each
    series in time order: range partitioning on (keys, time) keeps a series
    contiguous and ordered across partitions while splitting a huge series
    over several of them (a hash repartition by key would put it in one)."""
    order = [F.col(time_col)] + ([F.col(id_col)] if id_col else [])
    if keys:
        return df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*keys, *order)
    return df.orderBy(*order)


def least_cloud_mosaic(images: DataFrame, as_of, time_range="30d", cell_deg: float = 10.0) -> DataFrame:
    """Per grid cell of the scene centre, the least cloudy scene of the
    interval (ties by id) - one partial ``min_by`` aggregate."""
    start, end = look_back(as_of, time_range, "30d")
    df = images.where((F.col("ts") >= ts_lit(start)) & (F.col("ts") <= ts_lit(end)))
    cx = F.floor((F.col("min_lon") + F.col("max_lon")) / 2 / cell_deg)
    cy = F.floor((F.col("min_lat") + F.col("max_lat")) / 2 / cell_deg)
    best = F.min_by(F.struct("id", "source_id", "ts", "cloud_cover"), F.struct("cloud_cover", "id"))
    return (df.groupBy(cx.alias("cell_x"), cy.alias("cell_y")).agg(best.alias("b"))
            .select("cell_x", "cell_y", F.col("b.id").alias("id"), F.col("b.source_id").alias("source_id"),
                    F.col("b.ts").alias("ts"), F.col("b.cloud_cover").alias("cloud_cover")))


def query_points(points: DataFrame, measurement: str, start, stop, tags: dict | None = None,
                 limit: int = 1000) -> DataFrame:
    """range ``[start, stop)``, tag equality, per-series limit in time
    order (a series = measurement + tags + field), ascending result.  The
    per-series limit is a ``row_number`` window over (series) which only
    sees rows that passed the pushed-down range filter."""
    df = points.where((F.col("measurement") == measurement)
                      & (F.col("time") >= ts_lit(start)) & (F.col("time") < ts_lit(stop)))
    if "date" in points.columns:        # the sink's partitions: prune them
        df = df.where((F.col("date") >= F.to_date(ts_lit(start))) & (F.col("date") <= F.to_date(ts_lit(stop))))
    for k, v in (tags or {}).items():
        df = df.where(F.col("tags")[k] == F.lit(str(v)))
    # maps are not hashable: the series key uses the sorted tag entries.
    # ``row_number() <= limit`` is planned with a partial WindowGroupLimit
    # before the shuffle, so a huge series is cut map-side.
    series_key = [F.col("measurement"), F.array_sort(F.map_entries("tags")), F.col("field")]
    w = Window.partitionBy(*series_key).orderBy(F.col("time"), F.col("value"))
    return (df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit)
            .drop("__rn").orderBy("time", "value"))
