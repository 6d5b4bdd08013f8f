"""Queries: raster products, masks, neighbourhood filters, clipping (2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.functions import raster as RF
from envspark.operators import raster
from envspark.plans.catalog import register
from envspark.sources.views import _read, view

PCOLS = "image_id, band, row, col, value"


def P(spark, sf):
    return view(spark, sf, "pixels")


_WIDE = ("SELECT image_id, row, col, max(CASE WHEN band = 'B02' THEN value END) AS B02, "
         "max(CASE WHEN band = 'B03' THEN value END) AS B03, max(CASE WHEN band = 'B04' THEN value END) AS B04, "
         "max(CASE WHEN band = 'B08' THEN value END) AS B08 FROM pixels GROUP BY ALL")


def _wide(spark, sf):
    return raster.pixel_bands(P(spark, sf), ["B02", "B03", "B04", "B08"], fallback=False)


@register("f14_pixel_bands", _WIDE, ["pixels"])
def f14(spark, sf):
    return _wide(spark, sf)


@register("f14_pixel_bands_fallback",
          "SELECT image_id, row, col, max(CASE WHEN band = 'B02' THEN value END) AS B02, "
          "max(CASE WHEN band = 'B03' THEN value END) AS B03, max(CASE WHEN band = 'B04' THEN value END) AS B04 "
          "FROM pixels GROUP BY ALL", ["pixels"])
def f14b(spark, sf):
    """Requested bands absent -> the first three bands."""
    return raster.pixel_bands(P(spark, sf), ["B11", "B12"])


def _nd(a, b):
    return f"least(greatest(({a} - {b}) / ({a} + {b} + 1e-10), -1.0), 1.0)"


@register("r1_ndvi", f"SELECT image_id, row, col, {_nd('B08', 'B04')} AS ndvi FROM ({_WIDE})", ["pixels"], rnd=["ndvi"])
def r1(spark, sf):
    return _wide(spark, sf).select("image_id", "row", "col", RF.ndvi("B08", "B04").alias("ndvi"))


@register("r2_ndvi_uint8",
          "SELECT image_id, row, col, CAST(floor(((B08 - B04) / (B08 + B04 + 1e-10) + 1) * 127.5) AS INTEGER) AS ndvi_u8 "
          f"FROM ({_WIDE})", ["pixels"])
def r2(spark, sf):
    return _wide(spark, sf).select("image_id", "row", "col", RF.ndvi_uint8("B08", "B04").alias("ndvi_u8"))


@register("r3_ndwi", f"SELECT image_id, row, col, {_nd('B03', 'B08')} AS ndwi FROM ({_WIDE})", ["pixels"], rnd=["ndwi"])
def r3(spark, sf):
    return _wide(spark, sf).select("image_id", "row", "col", RF.ndwi("B03", "B08").alias("ndwi"))


_MASK = ("SELECT image_id, row, col, CASE WHEN CAST(value AS BIGINT) % 12 IN (3, 8, 9) THEN 255 ELSE 0 END AS mask "
         "FROM pixels WHERE band = 'B02'")


@register("r4_cloud_mask", _MASK, ["pixels"])
def r4(spark, sf):
    return raster.scl_cloud_mask(P(spark, sf))


@register("a14_cloud_cover",
          f"SELECT image_id, avg(CASE WHEN mask = 255 THEN 1.0 ELSE 0.0 END) AS cloud_cover FROM ({_MASK}) GROUP BY 1",
          ["pixels"], rnd=["cloud_cover"])
def a14(spark, sf):
    return raster.cloud_cover(raster.scl_cloud_mask(P(spark, sf)))


@register("j9_mask_join",
          f"SELECT p.image_id, p.band, p.row, p.col, CASE WHEN m.mask = 255 THEN NULL ELSE p.value END AS value "
          f"FROM pixels p LEFT JOIN ({_MASK}) m ON p.image_id = m.image_id AND p.row = m.row AND p.col = m.col "
          f"WHERE p.band = 'B08'", ["pixels"])
def j9(spark, sf):
    p = P(spark, sf)
    return raster.apply_mask(p.where(F.col("band") == "B08"), raster.scl_cloud_mask(p))


_R6 = ("WITH v AS (SELECT image_id, band, row, col, CASE WHEN value = 5000 THEN NULL ELSE value END AS value FROM pixels), "
       "q AS (SELECT image_id, quantile_cont(value, 0.02) AS p2, quantile_cont(value, 0.98) AS p98 FROM v GROUP BY 1), "
       "c AS (SELECT v.image_id, band, row, col, least(greatest(value, p2), p98) AS value FROM v JOIN q USING (image_id)), "
       "m AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM c GROUP BY 1) "
       "SELECT image_id, band, row, col, COALESCE(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END, 0.0) "
       "AS value FROM c JOIN m USING (image_id)")


@register("r6_percentile_stretch", _R6, ["pixels"], rnd=["value"])
def r6(spark, sf):
    return raster.percentile_stretch(P(spark, sf), 2, 98, nodata=5000)


_R7 = ("SELECT image_id, band, row, col, (value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w "
       "THEN 1.0 ELSE max(value) OVER w - min(value) OVER w END AS value FROM pixels "
       "WINDOW w AS (PARTITION BY image_id, band)")


@register("r7_band_minmax", _R7, ["pixels"], rnd=["value"])
def r7(spark, sf):
    return raster.band_minmax(P(spark, sf))


@register("r8_band_standardise",
          "SELECT image_id, band, row, col, CASE band WHEN 'B04' THEN (value - 0.485) / 0.229 "
          "WHEN 'B03' THEN (value - 0.456) / 0.224 WHEN 'B02' THEN (value - 0.406) / 0.225 ELSE value END AS value "
          f"FROM ({_R7})", ["pixels"], rnd=["value"])
def r8(spark, sf):
    return raster.band_standardise(raster.band_minmax(P(spark, sf)))


@register("r10_downsample",
          "SELECT image_id, band, CAST(floor(row / 2) AS BIGINT) AS row, CAST(floor(col / 2) AS BIGINT) AS col, "
          "avg(value) AS value FROM pixels GROUP BY ALL", ["pixels"], rnd=["value"])
def r10(spark, sf):
    return raster.downsample(P(spark, sf), 2)


def _blur_sql(src, along, across):
    w = f"(PARTITION BY image_id, band, {across} ORDER BY {along})"
    x = "value"
    lag1, lag2, lead1, lead2 = (f"lag({x}, 1) OVER {w}", f"lag({x}, 2) OVER {w}",
                                f"lead({x}, 1) OVER {w}", f"lead({x}, 2) OVER {w}")
    l1 = f"COALESCE({lag1}, {lead1})"
    l2 = f"COALESCE({lag2}, CASE WHEN {lag1} IS NOT NULL THEN {x} END, {lead2})"
    r1 = f"COALESCE({lead1}, {lag1})"
    r2 = f"COALESCE({lead2}, CASE WHEN {lead1} IS NOT NULL THEN {x} END, {lag2})"
    expr = f"{l2} * 0.0625 + {l1} * 0.25 + {x} * 0.375 + {r1} * 0.25 + {r2} * 0.0625"
    return f"SELECT image_id, band, row, col, {expr} AS value FROM ({src})"


@register("w9_gaussian_blur5", _blur_sql(_blur_sql(f"SELECT {PCOLS} FROM pixels", "col", "row"), "row", "col"),
          ["pixels"], rnd=["value"])
def w9(spark, sf):
    return raster.gaussian_blur5(P(spark, sf))


_W10 = ("WITH d AS (SELECT image_id, band, max(row) AS h, max(col) AS w FROM pixels GROUP BY 1, 2), "
        "t AS (SELECT p.image_id, p.band, p.row, p.col, least(greatest(p.row + o.dr, 0), d.h) AS sr, "
        "least(greatest(p.col + o.dc, 0), d.w) AS sc FROM pixels p JOIN d USING (image_id, band) "
        "CROSS JOIN (SELECT * FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)) o) "
        "SELECT t.image_id, t.band, t.row, t.col, quantile_cont(s.value, 0.5) AS value FROM t JOIN pixels s "
        "ON s.image_id = t.image_id AND s.band = t.band AND s.row = t.sr AND s.col = t.sc GROUP BY ALL")


@register("w10_median_filter3", _W10, ["pixels"], rnd=["value"])
def w10(spark, sf):
    return raster.median_filter3(P(spark, sf))


def _polygons(spark, sf):
    """Rectangles in pixel space derived from the region table."""
    k = F.col("r_regionkey").cast("double")
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(pt(k, k), pt(k + 3, k), pt(k + 3, k + 2), pt(k, k + 2))
    return _read(spark, sf, "region").select(F.col("r_regionkey").alias("polygon_id"), ring.alias("ring"))


_INSIDE = ("EXISTS (SELECT 1 FROM region r WHERE p.col + 0.5 >= r.r_regionkey AND p.col + 0.5 <= r.r_regionkey + 3 "
           "AND p.row + 0.5 >= r.r_regionkey AND p.row + 0.5 <= r.r_regionkey + 2)")


@register("j6_clip_pixels",
          f"SELECT image_id, band, row, col, CASE WHEN {_INSIDE} THEN value END AS value FROM pixels p "
          "WHERE col + 1 > (SELECT min(r_regionkey) FROM region) AND col < (SELECT max(r_regionkey) + 3 FROM region) "
          "AND row + 1 > (SELECT min(r_regionkey) FROM region) AND row < (SELECT max(r_regionkey) + 2 FROM region)",
          ["pixels"])
def j6(spark, sf):
    return raster.clip_pixels(P(spark, sf), _polygons(spark, sf), nodata=None, crop=True)


@register("j6_clip_pixels_nocrop",
          f"SELECT image_id, band, row, col, CASE WHEN {_INSIDE} THEN value ELSE -1.0 END AS value FROM pixels p",
          ["pixels"])
def j6n(spark, sf):
    return raster.clip_pixels(P(spark, sf), _polygons(spark, sf), nodata=-1.0, crop=False)


@register("r9_tile_equalise")
def r9(spark, sf):
    return raster.tile_equalise(P(spark, sf), 0.03)


@register("r11_preprocess_raster")
def r11(spark, sf):
    return raster.preprocess_raster(P(spark, sf), 0.03, k=2)
