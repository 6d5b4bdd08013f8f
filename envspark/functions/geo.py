"""Geometry as plain columns: points are (lon, lat) doubles, boxes are four
doubles, rings are ``array<struct<lon,lat>>``.  Everything is a Column
expression, so predicates are pushed to the scan and stay in codegen
(F8-F11, C7-C9, A12)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_bbox(bbox: str) -> tuple[float, float, float, float]:
    """``'min_lon,min_lat,max_lon,max_lat'`` -> floats; bad text -> ValueError."""
    try:
        parts = [float(p) for p in bbox.split(",")]
    except (AttributeError, ValueError) as e:
        raise ValueError("a box is four numbers: min_lon,min_lat,max_lon,max_lat") from e
    if len(parts) != 4:
        raise ValueError("a box is four numbers: min_lon,min_lat,max_lon,max_lat")
    return parts[0], parts[1], parts[2], parts[3]


def point_in_bbox(lon, lat, bbox) -> Column:
    """edges inclusive (a point on the boundary intersects)."""
    x0, y0, x1, y1 = parse_bbox(bbox) if isinstance(bbox, str) else bbox
    return (_c(lon) >= x0) & (_c(lon) <= x1) & (_c(lat) >= y0) & (_c(lat) <= y1)


def boxes_intersect(min_lon, min_lat, max_lon, max_lat, bbox) -> Column:
    """two closed boxes intersect."""
    x0, y0, x1, y1 = parse_bbox(bbox) if isinstance(bbox, str) else bbox
    return ((_c(min_lon) <= x1) & (_c(max_lon) >= x0)
            & (_c(min_lat) <= y1) & (_c(max_lat) >= y0))


def bbox_wkt(min_lon, min_lat, max_lon, max_lat) -> Column:
    """closed five-vertex polygon text."""
    x0, y0, x1, y1 = (_c(v).cast("string") for v in (min_lon, min_lat, max_lon, max_lat))
    sp, cm = F.lit(" "), F.lit(", ")
    return F.concat(F.lit("POLYGON(("), x0, sp, y0, cm, x1, sp, y0, cm, x1, sp, y1, cm,
                    x0, sp, y1, cm, x0, sp, y0, F.lit("))"))


def point_wkt(lon, lat) -> Column:
    return F.concat(F.lit("POINT("), _c(lon).cast("string"), F.lit(" "), _c(lat).cast("string"), F.lit(")"))


_NUM = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
_POINT = rf"^\s*POINT\s*\(\s*{_NUM}\s+{_NUM}\s*\)\s*$"


def parse_point_wkt(wkt) -> tuple[Column, Column]:
    """F8: ``POINT(lon lat)`` -> (lon, lat); null when malformed."""
    w = _c(wkt)
    ok = w.rlike(_POINT)
    lon = F.when(ok, F.regexp_extract(w, _POINT, 1).cast("double"))
    lat = F.when(ok, F.regexp_extract(w, _POINT, 2).cast("double"))
    return lon, lat


# EPSG:3857 (spherical Web Mercator) -> EPSG:4326.
EARTH_RADIUS_M = 6378137.0


def reproject(x, y, from_crs: str = "EPSG:4326") -> tuple[Column, Column]:
    """To lon/lat.  Closed form for Web Mercator; 4326 is the identity."""
    crs = from_crs.upper()
    if crs in ("EPSG:4326", "4326", "WGS84"):
        return _c(x), _c(y)
    if crs in ("EPSG:3857", "3857", "EPSG:900913"):
        lon = F.degrees(_c(x) / EARTH_RADIUS_M)
        lat = F.degrees(2 * F.atan(F.exp(_c(y) / EARTH_RADIUS_M)) - math.pi / 2)
        return lon, lat
    raise ValueError(f"Unsupported CRS {from_crs!r}: only EPSG:4326 and EPSG:3857")


# Metres per degree of latitude on the WGS84 mean sphere (approximation).
M_PER_DEG = 111_320.0


def mosaic_dimensions(min_lon, min_lat, max_lon, max_lat, resolution_m) -> tuple[Column, Column]:
    """Pixel width/height of a box at ``resolution_m`` metres per pixel
    (equirectangular approximation at the box's mid latitude)."""
    mid = F.radians((_c(min_lat) + _c(max_lat)) / 2)
    w = F.ceil((_c(max_lon) - _c(min_lon)) * M_PER_DEG * F.cos(mid) / _c(resolution_m))
    h = F.ceil((_c(max_lat) - _c(min_lat)) * M_PER_DEG / _c(resolution_m))
    return w.cast("bigint"), h.cast("bigint")


def footprint(x0, dx, rx, y0, ry, dy, width, height) -> dict[str, Column]:
    """Bounds of a raster from its affine geotransform
    ``X = x0 + col*dx + row*rx``, ``Y = y0 + col*ry + row*dy`` (GDAL order),
    over the four corners - correct for rotated grids too."""
    corners = [(0, 0), (width, 0), (0, height), (width, height)]
    xs = [_c(x0) + (_c(c) if not isinstance(c, int) else F.lit(c)) * _c(dx)
          + (_c(r) if not isinstance(r, int) else F.lit(r)) * _c(rx) for c, r in corners]
    ys = [_c(y0) + (_c(c) if not isinstance(c, int) else F.lit(c)) * _c(ry)
          + (_c(r) if not isinstance(r, int) else F.lit(r)) * _c(dy) for c, r in corners]
    return {"min_x": F.least(*xs), "max_x": F.greatest(*xs),
            "min_y": F.least(*ys), "max_y": F.greatest(*ys)}


def point_in_ring(lon, lat, ring) -> Column:
    """Even-odd ray casting over a ring ``array<struct<lon,lat>>`` with a
    native ``aggregate`` (no UDF).  Points on an edge count as inside."""
    n = F.size(ring)
    idx = F.sequence(F.lit(0), n - 1)
    px, py = _c(lon), _c(lat)

    def step(acc, i):
        a = F.get(ring, i)
        b = F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        ax, ay, bx, by = a["lon"], a["lat"], b["lon"], b["lat"]
        crosses = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        on_edge = ((F.least(ax, bx) <= px) & (px <= F.greatest(ax, bx))
                   & (F.least(ay, by) <= py) & (py <= F.greatest(ay, by))
                   & ((bx - ax) * (py - ay) == (by - ay) * (px - ax)))
        return F.struct(
            F.when(crosses, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"),
            (acc["edge"] | on_edge).alias("edge"))

    res = F.aggregate(idx, F.struct(F.lit(False).alias("inside"), F.lit(False).alias("edge")), step)
    return res["inside"] | res["edge"]


def ring_bounds(ring) -> dict[str, Column]:
    return {"min_lon": F.array_min(F.transform(ring, lambda p: p["lon"])),
            "max_lon": F.array_max(F.transform(ring, lambda p: p["lon"])),
            "min_lat": F.array_min(F.transform(ring, lambda p: p["lat"])),
            "max_lat": F.array_max(F.transform(ring, lambda p: p["lat"]))}
