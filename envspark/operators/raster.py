"""Raster operators on pixel tables.

A raster is a band-long pixel table ``(image_id, band, row, col, value)``
(or wide, one column per band, after ``pixel_bands``).  Neighbourhood
operators are window functions over one pixel row or column of one image
(``partitionBy(image, band, row)``): partitions are bounded by the image
width, never by the number of images, so thousands of scenes spread over the
cluster and a huge scene is cut into many row partitions.  Per-image
statistics are partial aggregates joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.functions.geo import point_in_ring, ring_bounds
from envspark.functions.raster import cloud_mask
from envspark.operators.quantiles import exact_quantiles
from envspark.session import stored

IMG = "image_id"
PIX = [IMG, "band", "row", "col"]


def pixel_bands(pixels: DataFrame, bands: Sequence[str] = ("B04", "B03", "B02"),
                fallback: bool = True) -> DataFrame:
    """wide table ``(image_id, row, col, <band>...)`` for the requested
    band names.  When none of them exists the first three bands (by name)
    are used instead.  One conditional aggregate: one shuffle."""
    bands = list(bands)
    if fallback:
        names = pixels.select("band").where(F.col("band").isNotNull())
        if names.where(F.col("band").isin(*bands)).isEmpty():
            bands = [r["band"] for r in names.distinct().orderBy("band").limit(3).collect()]
    return pixels.groupBy(IMG, "row", "col").agg(
        *[F.first(F.when(F.col("band") == b, F.col("value")), ignorenulls=True).alias(b) for b in bands])


def scl_cloud_mask(pixels: DataFrame, scl_band: str = "B02", scl_expr=None) -> DataFrame:
    """255/0 cloud mask per pixel from the scene classification layer
    (here derived from a band as ``dn % 12`` when ``scl_expr`` is None)."""
    src = pixels.where(F.col("band") == scl_band)
    scl = scl_expr if scl_expr is not None else (F.col("value").cast("bigint") % 12)
    return src.select(IMG, "row", "col", cloud_mask(scl).alias("mask"))


def cloud_cover(mask: DataFrame) -> DataFrame:
    """Share of cloudy pixels per image."""
    return mask.groupBy(IMG).agg(F.avg((F.col("mask") == 255).cast("double")).alias("cloud_cover"))


def apply_mask(pixels: DataFrame, mask: DataFrame, nodata=None) -> DataFrame:
    """Pixel values where the mask is clear, ``nodata`` under cloud
    (equi-join on image/row/col; both sides hash-partitioned by image)."""
    j = pixels.join(mask, [IMG, "row", "col"], "left")
    val = F.when(F.col("mask") == 255, F.lit(nodata)).otherwise(F.col("value"))
    return j.select(*[c for c in pixels.columns if c != "value"], val.alias("value"))


def _image_stats(pixels: DataFrame, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Per-group statistics joined back (AQE broadcasts the small side)."""
    st = pixels.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])
    return pixels.join(st, list(by), "left")


def percentile_stretch(pixels: DataFrame, low: float = 2.0, high: float = 98.0, nodata=None) -> DataFrame:
    """R5 + R6: nodata -> null; clip to the [low, high] percentiles over all
    bands of the image; min-max to [0, 1] when the range is non-zero
    (constant images unchanged); remaining nulls -> 0."""
    v = F.col("value").cast("double")
    if nodata is not None:
        v = F.when(v == F.lit(float(nodata)), F.lit(None).cast("double")).otherwise(v)
    p = pixels.withColumn("value", v)
    # exact per-image percentiles by rank selection (a float scene can have
    # as many distinct values as pixels; no per-image value buffer)
    q = exact_quantiles(p, "value", [low / 100, high / 100], [IMG], prefix="__p")
    j = p.join(q, [IMG], "left")
    clipped = F.least(F.greatest(F.col("value"), F.col("__p_q0")), F.col("__p_q1"))
    c = j.select(*[x for x in pixels.columns if x != "value"], clipped.alias("value"))
    c = _image_stats(c, [IMG], {"__lo": F.min("value"), "__hi": F.max("value")})
    lo, hi = F.col("__lo"), F.col("__hi")
    scaled = F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.col("value"))
    return c.select(*[x for x in pixels.columns if x != "value"], F.coalesce(scaled, F.lit(0.0)).alias("value"))


def band_minmax(pixels: DataFrame) -> DataFrame:
    """Per image and band (x - min) / range, a zero range divides by 1."""
    j = _image_stats(pixels, [IMG, "band"], {"__lo": F.min("value"), "__hi": F.max("value")})
    rng = F.col("__hi") - F.col("__lo")
    return j.select(*[c for c in pixels.columns if c != "value"],
                    ((F.col("value") - F.col("__lo")) / F.when(rng == 0, 1.0).otherwise(rng)).alias("value"))


# ImageNet statistics keyed by the RGB band names (red, green, blue).
IMAGENET = {"B04": (0.485, 0.229), "B03": (0.456, 0.224), "B02": (0.406, 0.225)}


def band_standardise(pixels: DataFrame, stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(x - mean[band]) / std[band]; bands without statistics unchanged."""
    stats = stats or IMAGENET
    expr = F.col("value")
    m = F.create_map(*[x for b, (mu, _) in stats.items() for x in (F.lit(b), F.lit(float(mu)))])
    s = F.create_map(*[x for b, (_, sd) in stats.items() for x in (F.lit(b), F.lit(float(sd)))])
    out = F.when(F.col("band").isin(*stats.keys()), (expr - m[F.col("band")]) / s[F.col("band")]).otherwise(expr)
    return pixels.select(*[c for c in pixels.columns if c != "value"], out.alias("value"))


def downsample(pixels: DataFrame, k: int = 2) -> DataFrame:
    """Overview level - mean of each k x k block (partial aggregate)."""
    return (pixels.groupBy(IMG, "band", F.floor(F.col("row") / k).alias("row"),
                           F.floor(F.col("col") / k).alias("col"))
            .agg(F.avg("value").alias("value")))


# ---------------------------------------------------------------- neighbourhoods

# The 5-tap binomial kernel (Gaussian of size 5 with sigma 0).
GAUSS5 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def _blur_pass(df: DataFrame, along: str, across: str, value: str = "value") -> DataFrame:
    """One separable pass with reflect-101 borders along ``along``."""
    w = Window.partitionBy(IMG, "band", across).orderBy(along)
    x = F.col(value)
    lag1, lag2 = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
    lead1, lead2 = F.lead(x, 1).over(w), F.lead(x, 2).over(w)
    l1 = F.coalesce(lag1, lead1)
    l2 = F.coalesce(lag2, F.when(lag1.isNotNull(), x), lead2)
    r1 = F.coalesce(lead1, lag1)
    r2 = F.coalesce(lead2, F.when(lead1.isNotNull(), x), lag2)
    k = GAUSS5
    out = l2 * k[0] + l1 * k[1] + x * k[2] + r1 * k[3] + r2 * k[4]
    return df.select(*[c for c in df.columns if c != value], out.alias(value))


def gaussian_blur5(pixels: DataFrame, value: str = "value") -> DataFrame:
    """5x5 Gaussian (binomial kernel, sigma 0) with reflect-101 borders,
    as a horizontal then a vertical pass of lag/lead windows."""
    return _blur_pass(_blur_pass(pixels, "col", "row", value), "row", "col", value)


# Pixels of a block's side, rows a task is dealt, and the
# occupied bins of a tile up to which they are looked up one by one.
BLOCK, TASK_PIXELS, DENSE = 256, 400_000, 32
BLK = [IMG, "band", "__br", "__bc"]


def _dealt(pixels: DataFrame, halo: int = 0) -> tuple[DataFrame, int]:
    """Pixels dealt by block of their image band (``__br``, ``__bc``), with
    copies for blocks less than ``halo`` pixels away, and the number of
    partitions.  That number follows the pixels, so a task holds about
    ``TASK_PIXELS`` of them however large the table is; a block is at most
    ``BLOCK`` x ``BLOCK`` pixels, whatever the size of the image.  Joins with
    it ask for a merge: a small file of pixels is many rows to broadcast."""
    rows = pixels.select(*PIX, "value").where(F.col(IMG).isNotNull() & F.col("band").isNotNull())
    parts = max(pixels.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_PIXELS))
    for axis, name in (("row", "__br"), ("col", "__bc")):
        own = F.coalesce(F.floor(F.col(axis) / BLOCK), F.lit(-1))
        near = F.array_distinct(F.array(own, *[F.coalesce(F.floor((F.col(axis) + d) / BLOCK), own) for d in (-halo, halo)]))
        rows = rows.withColumn(name, F.explode(F.filter(near, lambda b: (b == own) | (b >= 0))) if halo else own)
    return rows.repartition(parts, *BLK), parts


def _block_stats(dealt: DataFrame) -> DataFrame:
    """One row per block with range (``__lo``, ``__hi``) and size (``__H``,
    ``__W``) of its whole image band."""
    block = dealt.groupBy(*BLK).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"),
                                    F.max("row").alias("__r"), F.max("col").alias("__c"))
    image = block.groupBy(IMG, "band").agg(
        F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"),
        (F.max("__r") + 1).cast("int").alias("__H"), (F.max("__c") + 1).cast("int").alias("__W"))
    return block.select(*BLK).join(image.hint("merge"), [IMG, "band"])


def median_filter3(pixels: DataFrame) -> DataFrame:
    """3x3 median per band with replicated borders (the exact median).
    A pixel is moved once to its block (and to the next ones at a block's
    edge); there it is given to the targets around it, as often as the border
    repeats it."""
    dealt, _ = _dealt(pixels, halo=1)
    st = _block_stats(dealt).select(*BLK, (F.col("__H") - 1).alias("__h"), (F.col("__W") - 1).alias("__w"))

    def targets(at, last):
        # places beside the pixel within the image; a border row counts for the one outside it
        near = F.transform(F.array(at - 1, at, at + 1), lambda p: F.struct(
            p.alias("p"), (F.lit(1) + ((p == at) & (p == 0)).cast("int") + ((p == at) & (p == last)).cast("int")).alias("n")))
        return F.filter(near, lambda t: (t["p"] >= 0) & (t["p"] <= last))
    given = (dealt.join(st.hint("merge"), BLK).select(*BLK, "col", "value", "__w", "row", F.explode(targets(F.col("row"), F.col("__h"))).alias("__tr"))
             .where(F.floor(F.col("__tr.p") / BLOCK) == F.col("__br"))
             .select(*BLK, "row", "col", "value", "__tr", F.explode(targets(F.col("col"), F.col("__w"))).alias("__tc"))
             .where(F.floor(F.col("__tc.p") / BLOCK) == F.col("__bc"))
             .select(*BLK, F.col("__tr.p").alias("tr"), F.col("__tc.p").alias("tc"), "value",
                     (F.col("__tr.n") * F.col("__tc.n")).alias("n"),
                     ((F.col("__tr.p") == F.col("row")) & (F.col("__tc.p") == F.col("col"))).alias("own")))
    return (given.groupBy(*BLK, "tr", "tc").agg(F.percentile("value", 0.5, F.col("n")).alias("value"), F.max("own").alias("own"))
            .where("own").select(IMG, "band", F.col("tr").alias("row"), F.col("tc").alias("col"), "value"))


# ---------------------------------------------------------------- clipping

def clip_pixels(pixels: DataFrame, polygons: DataFrame, nodata=None, crop: bool = True,
                cell: float = 4.0, x_expr: Column | None = None, y_expr: Column | None = None) -> DataFrame:
    """Mask pixels by the union of polygons (``polygon_id``, ``ring``
    ``array<struct<lon,lat>>``) in pixel coordinates (centre = col + 0.5,
    row + 0.5 unless ``x_expr``/``y_expr`` map to world coordinates).
    Inside -> value, outside -> ``nodata`` (null by default).  ``crop``
    keeps only the window of the polygons' bounding box and shifts row/col
    to its origin.

    Pixel x polygon candidates come from an equi-join on grid cells (each
    polygon box exploded to its cells, each pixel to one cell), refined with
    an exact ray-casting expression - never a nested-loop join."""
    x = x_expr if x_expr is not None else F.col("col") + 0.5
    y = y_expr if y_expr is not None else F.col("row") + 0.5
    pb = ring_bounds(F.col("ring"))
    polys = polygons.select("polygon_id", "ring", *[v.alias(k) for k, v in pb.items()])
    px = pixels.withColumn("__x", x).withColumn("__y", y)
    from envspark.operators.joins import grid_candidates
    cand = grid_candidates(px, "__x", "__y", polys, "min_lon", "min_lat", "max_lon", "max_lat", cell) \
        .where(point_in_ring(F.col("__x"), F.col("__y"), F.col("ring")))
    inside = cand.select(*PIX).distinct().withColumn("__in", F.lit(True))
    j = pixels.join(inside, PIX, "left")
    val = F.when(F.col("__in"), F.col("value")).otherwise(F.lit(nodata))
    out = j.select(*[c for c in pixels.columns if c != "value"], val.alias("value"))
    if not crop:
        return out
    # the crop window is the bounding box of the polygon set: four numbers
    # aggregated from the (small, user-supplied) polygon table
    b = polys.agg(F.min("min_lon").alias("x0"), F.max("max_lon").alias("x1"),
                  F.min("min_lat").alias("y0"), F.max("max_lat").alias("y1")).first()
    c0, r0 = F.floor(F.lit(b["x0"])), F.floor(F.lit(b["y0"]))
    keep = ((F.col("col") + 1 > F.lit(b["x0"])) & (F.col("col") < F.lit(b["x1"]))
            & (F.col("row") + 1 > F.lit(b["y0"])) & (F.col("row") < F.lit(b["y1"])))
    return out.where(keep).select(*[c for c in pixels.columns if c not in ("row", "col", "value")],
                                  (F.col("row") - r0).cast("bigint").alias("row"),
                                  (F.col("col") - c0).cast("bigint").alias("col"), "value")


# ---------------------------------------------------------------- contrast

def to_uint8(pixels: DataFrame) -> DataFrame:
    """Band min-max to 0..255 integers (truncation); a constant band is
    truncated as is (wrapped modulo 256 like an unsigned byte cast)."""
    j = _image_stats(pixels, [IMG, "band"], {"__lo": F.min("value"), "__hi": F.max("value")})
    lo, hi, v = F.col("__lo"), F.col("__hi"), F.col("value")
    u = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * 255)).otherwise(F.pmod(F.floor(v).cast("bigint"), F.lit(256)))
    return j.select(*[c for c in pixels.columns if c != "value"], u.cast("int").alias("value"))


def _mirrored(i: Column, n: Column, padded: Column) -> Column:
    """Places of pixel ``i`` in an axis padded by reflection (101) from ``n`` to ``padded``."""
    m = 2 * (n - 1) - i
    return F.when((m >= n) & (m < padded), F.array(i, m)).otherwise(F.array(i))


def tile_equalise(pixels: DataFrame, clip_limit: float = 0.03, tiles: int = 8) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation per image band.

    1. band min-max to 0..255 integers;
    2. the image is padded (reflect-101) to a multiple of ``tiles`` and cut
       into ``tiles x tiles`` tiles;
    3. per tile a 256-bin histogram is clipped at max(1, clip * area / 256),
       the excess spread evenly and the remainder one per step over the bins;
    4. the cumulative histogram scaled by 255 / area is the tile LUT;
    5. every pixel blends the LUTs of its four nearest tile centres
       bilinearly; result / 255.
    A tile keeps its occupied bins (all 256 LUT entries where many are
    occupied), so the tables follow the pixels, not tiles x 256 bins.  Pixels
    stay one row each: they are dealt once by block (``_dealt``), and the tiles
    of their image (at most ``tiles`` x ``tiles`` x 256 entries) meet them there."""
    dealt, parts = _dealt(pixels)
    # one row per block with the value range (for the byte scaling) and the
    # size (for tiles and padding) of its image band
    st = _block_stats(dealt)
    st = st.select("*", F.ceil(F.col("__H") / tiles).cast("int").alias("__th"),
                   F.ceil(F.col("__W") / tiles).cast("int").alias("__tw"))
    lo, hi, v = F.col("__lo"), F.col("__hi"), F.col("value")
    byte = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * 255)).otherwise(
        F.pmod(F.floor(v).cast("bigint"), F.lit(256))).cast("int").alias("value")
    size = ["__H", "__W", "__th", "__tw"]
    tiled = (dealt.join(st.hint("merge"), BLK).select(*BLK, "row", "col", byte, *size)
             .select(*BLK, "col", "value", *size, F.explode(
                 _mirrored(F.col("row"), F.col("__H"), F.col("__th") * tiles)).alias("prow"))
             .select(*BLK, "value", *size, "prow", F.explode(
                 _mirrored(F.col("col"), F.col("__W"), F.col("__tw") * tiles)).alias("pcol"))
             .where(F.col("prow").isNotNull() & F.col("pcol").isNotNull())
             .select(*BLK, ((F.col("prow") / F.col("__th")).cast("int") * tiles
                            + (F.col("pcol") / F.col("__tw")).cast("int")).alias("tile"),
                     (F.col("__th") * F.col("__tw")).alias("area"), F.coalesce("value", F.lit(-1)).alias("bin")))
    lim = (F.greatest((F.lit(clip_limit) * F.col("area") / 256).cast("int"), F.lit(1)) if clip_limit > 0
           else F.lit(2 ** 62))
    hist = (tiled.groupBy(*BLK, "tile", "area", "bin").agg(F.count(F.lit(1)).alias("h"))
            .repartition(parts, IMG, "band")
            .groupBy(IMG, "band", "tile", "area", "bin").agg(F.sum("h").alias("h"))
            .withColumn("__c", F.least(F.col("h"), lim)))
    # per tile: clipped excess -> evenly spread batch + remainder on every step-th
    # bin; an occupied bin and its clipped count are one number
    tile = hist.groupBy(IMG, "band", "tile", "area").agg(
        F.sum(F.col("h") - F.col("__c")).alias("__ex"),
        F.collect_list(F.col("__c") * 512 + F.col("bin") + 1).alias("bins"))
    tile = tile.select(IMG, "band", "tile", "area", "bins", (F.col("__ex") / 256).cast("long").alias("batch"),
                       (F.col("__ex") - (F.col("__ex") / 256).cast("long") * 256).alias("res"))

    def entry(at, bins, batch, res, area):
        # the clipped cumulative histogram at a bin = counts of occupied bins
        # up to it + (bin + 1) * batch + number of remainder bins up to it
        cum = F.aggregate(bins, F.lit(0).cast("long"), lambda n, e: n + F.when(
            e.bitwiseAND(511) - 1 <= at, F.shiftright(e, 9)).otherwise(F.lit(0).cast("long")))
        step = F.greatest((F.lit(256) / F.when(res > 0, res).otherwise(1)).cast("long"), F.lit(1))
        nres = F.when(res > 0, F.least(res, F.floor(at / step) + 1)).otherwise(F.lit(0))
        total = cum + (at + 1) * batch + nres
        return F.least(F.greatest(F.bround(total * (F.lit(255.0) / area), 0), F.lit(0.0)), F.lit(255.0))
    tile = tile.withColumn("lut", F.when(F.size("bins") > DENSE, F.transform(
        F.sequence(F.lit(0), F.lit(255)), lambda i: entry(i, F.col("bins"), F.col("batch"), F.col("res"), F.col("area")))))
    luts = tile.groupBy(IMG, "band").agg(F.map_from_entries(F.collect_list(F.struct("tile", F.struct(
        F.when(F.col("lut").isNull(), F.col("bins")).alias("bins"), "batch", "res", "lut")))).alias("__luts"))
    # bilinear blend: each pixel reads the LUT of its four nearest tile centres
    tables = st.repartition(parts, IMG, "band").join(luts.hint("merge"), [IMG, "band"])
    met = dealt.join(tables.hint("merge"), BLK)
    met = met.select(*BLK, "row", "col", byte, "__luts", (F.col("__th") * F.col("__tw")).alias("__area"),
                     (F.col("col") / F.col("__tw") - 0.5).alias("__x"), (F.col("row") / F.col("__th") - 0.5).alias("__y"))
    x, y = F.col("__x"), F.col("__y")

    def corner(dy, dx):
        near = [F.least(F.greatest(F.floor(f) + d, F.lit(0)), F.lit(tiles - 1)) for f, d in ((y, dy), (x, dx))]
        share = [f - F.floor(f) if d else 1 - (f - F.floor(f)) for f, d in ((y, dy), (x, dx))]
        return F.struct((share[1] * share[0]).alias("w"),
                        F.element_at("__luts", (near[0] * tiles + near[1]).cast("int")).alias("t"))

    def looked_up(t):
        return F.when(t.isNull(), F.lit(0.0)).when(t["lut"].isNotNull(), F.get(t["lut"], F.col("value"))).otherwise(
            entry(F.col("value"), t["bins"], t["batch"], t["res"], F.col("__area")))
    blend = F.aggregate(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)]), F.lit(0.0),
                        lambda a, k: a + k["w"] * looked_up(k["t"]))
    blended = (met.where(F.col("value").isNotNull()).select(*BLK, "row", "col", blend.alias("__v"))
               .groupBy(*BLK, "row", "col").agg(F.sum("__v").alias("__v")))
    return blended.select(*PIX, (F.least(F.greatest(F.bround("__v", 0), F.lit(0.0)), F.lit(255.0)) / 255.0)
                          .alias("value"))


def preprocess_raster(pixels: DataFrame, clip_limit: float = 0.03, k: int | None = None,
                      normalize: bool = True) -> DataFrame:
    """Median filter -> tile equalisation -> optional k x k overview ->
    per-band min-max."""
    out = tile_equalise(stored(median_filter3(pixels)), clip_limit)      # read four times
    if k:
        out = downsample(out, k)
    return band_minmax(stored(out)) if normalize else out               # read twice
