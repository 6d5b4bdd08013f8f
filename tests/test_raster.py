"""Raster operators against NumPy references on small hand-made tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.functions.raster import ndvi_uint8, normalized_difference
from envspark.operators import raster

RNG = np.random.default_rng(7)


def _tile(spark, arr: np.ndarray, image_id=0, band="B08"):
    rows = [(image_id, band, r, c, float(arr[r, c])) for r in range(arr.shape[0]) for c in range(arr.shape[1])]
    return spark.createDataFrame(rows, "image_id long, band string, row long, col long, value double")


def _to_array(df, h, w, col="value"):
    out = np.full((h, w), np.nan)
    for r in df.select("row", "col", col).collect():
        out[r["row"], r["col"]] = r[col]
    return out


def _np_blur(a):
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(a, 2, mode="reflect")            # numpy 'reflect' == reflect-101
    h = np.array([[np.dot(p[i, j:j + 5], k) for j in range(a.shape[1])] for i in range(p.shape[0])])
    return np.array([[np.dot(h[i:i + 5, j], k) for j in range(a.shape[1])] for i in range(a.shape[0])])


@pytest.mark.parametrize("shape", [(8, 8), (5, 9)])
def test_gaussian_blur_reflect101(spark, shape):
    a = RNG.random(shape) * 100
    got = _to_array(raster.gaussian_blur5(_tile(spark, a)), *shape)
    assert np.allclose(got, _np_blur(a))


def test_median_filter_replicate(spark):
    a = RNG.integers(0, 50, (6, 7)).astype(float)
    got = _to_array(raster.median_filter3(_tile(spark, a)), 6, 7)
    p = np.pad(a, 1, mode="edge")
    want = np.array([[np.median(p[i:i + 3, j:j + 3]) for j in range(7)] for i in range(6)])
    assert np.allclose(got, want)


def test_median_filter_of_blocks(spark, monkeypatch):
    """Targets on both sides of a block's edge, partitions that follow the pixels, and the join that copied
    every pixel nine times before its shuffle gone."""
    monkeypatch.setattr(raster, "BLOCK", 4)
    monkeypatch.setattr(raster, "TASK_PIXELS", 20)
    a = RNG.integers(0, 50, (9, 13)).astype(float)
    df = _tile(spark, a)
    assert raster._dealt(df, halo=1)[0].count() < 3 * 9 * 13
    p = np.pad(a, 1, mode="edge")
    want = np.array([[np.median(p[i:i + 3, j:j + 3]) for j in range(13)] for i in range(9)])
    assert np.allclose(_to_array(raster.median_filter3(df), 9, 13), want)


def _np_clahe(u8: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Independent NumPy CLAHE following the published algorithm."""
    H, W = u8.shape
    Hp, Wp = -(-H // tiles) * tiles, -(-W // tiles) * tiles
    pad = np.pad(u8, ((0, Hp - H), (0, Wp - W)), mode="reflect") if (Hp > H or Wp > W) else u8
    th, tw = Hp // tiles, Wp // tiles
    area = th * tw
    lim = max(int(clip * area / 256), 1)
    luts = np.zeros((tiles, tiles, 256))
    for ty in range(tiles):
        for tx in range(tiles):
            h = np.bincount(pad[ty * th:(ty + 1) * th, tx * tw:(tx + 1) * tw].ravel(), minlength=256)
            ex = np.maximum(h - lim, 0).sum()
            h = np.minimum(h, lim) + ex // 256
            res = ex - (ex // 256) * 256
            if res:
                step = max(256 // res, 1)
                for i in range(0, 256, step):
                    if res <= 0:
                        break
                    h[i] += 1
                    res -= 1
            luts[ty, tx] = np.clip(np.round(np.cumsum(h) * 255.0 / area), 0, 255)
    out = np.zeros((H, W))
    for y in range(H):
        tyf = y / th - 0.5
        ty1 = int(np.floor(tyf))
        ya = tyf - ty1
        ty2 = min(ty1 + 1, tiles - 1)
        ty1 = max(ty1, 0)
        for x in range(W):
            txf = x / tw - 0.5
            tx1 = int(np.floor(txf))
            xa = txf - tx1
            tx2 = min(tx1 + 1, tiles - 1)
            tx1 = max(tx1, 0)
            v = u8[y, x]
            res = ((luts[ty1, tx1, v] * (1 - xa) + luts[ty1, tx2, v] * xa) * (1 - ya)
                   + (luts[ty2, tx1, v] * (1 - xa) + luts[ty2, tx2, v] * xa) * ya)
            out[y, x] = np.clip(np.round(res), 0, 255)
    return out / 255.0


@pytest.mark.parametrize("shape,clip", [((16, 16), 0.03), ((16, 16), 40.0), ((12, 20), 2.0)])
def test_tile_equalise_matches_numpy(spark, shape, clip):
    a = RNG.integers(0, 256, shape).astype(float)
    a[0, 0], a[-1, -1] = 0.0, 255.0            # band min-max is the identity
    got = _to_array(raster.tile_equalise(_tile(spark, a), clip), *shape)
    want = _np_clahe(a.astype(np.uint8), clip)
    assert np.abs(got - want).max() <= 1 / 255 + 1e-9   # at most one grey level (float32 vs double rounding)
    assert (np.abs(got - want) > 1e-9).mean() < 0.02


@pytest.mark.parametrize("clip", [0.03, 40.0])
def test_tile_equalise_of_blocks_moves_a_row_a_pixel(spark, monkeypatch, clip):
    """Images of many blocks and partitions that follow the pixels; no operator of the plan copies pixels
    (only the few that the padding mirrors)."""
    monkeypatch.setattr(raster, "BLOCK", 5)
    monkeypatch.setattr(raster, "TASK_PIXELS", 40)
    a = RNG.integers(0, 256, (21, 30)).astype(float)
    a[0, 0], a[-1, -1] = 0.0, 255.0
    df = _tile(spark, a)
    dealt, parts = raster._dealt(df)
    assert parts == dealt.rdd.getNumPartitions() == -(-21 * 30 // 40)
    out = raster.tile_equalise(df, clip)
    got, want = _to_array(out, 21, 30), _np_clahe(a.astype(np.uint8), clip)
    assert np.abs(got - want).max() <= 1 / 255 + 1e-9 and (np.abs(got - want) > 1e-9).mean() < 0.02
    exploded = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x]
    assert exploded and all("prow" in x or "pcol" in x for x in exploded)


def test_percentile_stretch(spark):
    a = np.arange(100, dtype=float).reshape(10, 10)
    a[3, 3] = 5000.0                            # nodata
    got = _to_array(raster.percentile_stretch(_tile(spark, a), 2, 98, nodata=5000), 10, 10)
    valid = np.delete(a.ravel(), 33)
    p2, p98 = np.percentile(valid, [2, 98])
    want = (np.clip(a, p2, p98) - p2) / (p98 - p2)
    want[3, 3] = 0.0
    assert np.allclose(got, want)


def test_constant_image_unchanged(spark):
    a = np.full((4, 4), 7.0)
    got = _to_array(raster.percentile_stretch(_tile(spark, a)), 4, 4)
    assert np.allclose(got, 7.0)


def test_clip_pixels_concave_polygon(spark):
    a = RNG.random((8, 8))
    ring = [(1.0, 1.0), (7.0, 1.0), (7.0, 7.0), (4.0, 3.0), (1.0, 7.0)]      # concave "arrow"
    polys = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in ring])],
                                  "polygon_id int, ring array<struct<lon:double,lat:double>>")
    got = raster.clip_pixels(_tile(spark, a), polys, nodata=None, crop=False, cell=2.0)
    inside = {(r["row"], r["col"]) for r in got.where(F.col("value").isNotNull()).collect()}

    def pip(x, y):
        c = False
        for i in range(len(ring)):
            (ax, ay), (bx, by) = ring[i], ring[i - 1]
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                c = not c
        return c
    want = {(r, c) for r in range(8) for c in range(8) if pip(c + 0.5, r + 0.5)}
    assert inside == want


def test_indices_and_uint8(spark):
    df = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0), (1.0, 3.0)], "nir double, red double")
    got = df.select(normalized_difference("nir", "red").alias("v"), ndvi_uint8("nir", "red").alias("u")).collect()
    assert [round(r["v"], 6) for r in got] == [0.5, 0.0, -0.5]
    assert [r["u"] for r in got] == [191, 127, 63]


def test_pixel_bands_fallback(spark):
    df = _tile(spark, np.ones((2, 2)), band="X1").unionByName(_tile(spark, np.zeros((2, 2)), band="X2"))
    wide = raster.pixel_bands(df, ["B04"])
    assert set(wide.columns) == {"image_id", "row", "col", "X1", "X2"}
