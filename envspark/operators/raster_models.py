"""Pixel-level models.

R12 composes the multivariate detectors with the Gaussian blur; R15 runs
mean shift on a quantised, weighted cell table (cells of one bandwidth,
neighbours found by an equi-join on cell offsets); R16 grows SLIC
superpixels by iterating assignment/update as joins between pixels and the
seeds of their neighbouring grid cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.operators import blocks, detectors, models
from envspark.operators.common import join_on
from envspark.operators.raster import gaussian_blur5
from envspark.session import cut_lineage, stored

IMG = "image_id"


def pixel_anomaly(pixels_wide: DataFrame, bands: Sequence[str], method: str = "isolation_forest",
                  **kw) -> DataFrame:
    """Anomaly map per pixel (0/1, or the [0, 1] reconstruction score)
    smoothed by the 5x5 Gaussian: ``(image_id, band='anomaly', row, col, value)``.
    Forest, components and thresholds are those of the image alone; the
    one-class SVM is one model for all images."""
    bands = list(bands)
    if method == "isolation_forest":
        m = detectors.isolation_forest(pixels_wide, bands, contamination=kw.get("contamination", 0.01),
                                       seed=kw.get("seed", 42), keys=[IMG])
        val = F.col("anomaly").cast("double")
    elif method == "one_class_svm":
        m = detectors.one_class_svm(pixels_wide, bands, nu=kw.get("nu", 0.01), seed=kw.get("seed", 42),
                                    iterations=kw.get("iterations", 40))
        val = F.col("anomaly").cast("double")
    elif method in ("autoencoder", "reconstruction"):
        m = models.reconstruction_score(pixels_wide, bands, kw.get("k", 2))
        val = F.col("score")
    else:
        raise ValueError(f"no pixel anomaly method called {method!r}")
    amap = m.select(IMG, F.lit("anomaly").alias("band"), "row", "col", val.alias("value"))
    return gaussian_blur5(amap)


REACH = 2       # cell coordinates by which rows are dealt out; distances decide over the others


def _offsets(d: int):
    """All steps to a cell and its neighbours in ``d`` dimensions."""
    return F.array(*[F.array(*[F.lit(o) for o in step]) for step in itertools.product((-1, 0, 1), repeat=d)])


def _steps_to(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rows once for their cell and each neighbouring one."""
    probe = df.withColumn("__o", F.explode(_offsets(len(cell))))
    return probe.select(*[c for c in df.columns if c not in cell],
                        *[(F.col(c) + F.col("__o")[i]).alias(c) for i, c in enumerate(cell)])


def separate_modes(seeds: DataFrame, dims: int, bandwidth: float, tol: float = 1e-3,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Seeds ``(keys, y0.., strength)`` -> modes at least one bandwidth apart:
    the strongest seed (ties: smallest coordinates) is a mode, seeds closer
    than a bandwidth to it go, the strongest of the rest is the next one.

    Rounds in place of that order: the best seed of a cell is a mode when no
    better one lies within a bandwidth, and all such modes clear their
    surroundings at once; the outcome is the same.  Seeds meet the best ones
    of their own and the neighbouring cells only, never one another; there are
    as many rounds as the longest chain of ever stronger neighbours.  Seeds of
    one cell of ``tol`` bandwidths count as one, the strongest."""
    keys, ys = list(keys), [f"y{i}" for i in range(dims)]
    cell = [f"k{i}" for i in range(dims)]
    best = F.struct((-F.col("strength")).alias("w"), *ys)
    fine = [F.floor(F.col(y) / (tol * bandwidth)).alias(f"__f{i}") for i, y in enumerate(ys)]
    left = (seeds.groupBy(*keys, *fine).agg(F.min(best).alias("m"))
            .select(*keys, "m", *[F.floor(F.col("m")[y] / bandwidth).cast("long").alias(c) for y, c in zip(ys, cell)]))
    left = stored(left)
    found = left.limit(0)
    dist2 = sum((F.col("m")[y] - F.col("__top")[y]) ** 2 for y in ys)

    def within_reach(tops: DataFrame) -> DataFrame:
        steps = _steps_to(tops.withColumnRenamed("m", "__top").drop(*cell[REACH:]), cell[:REACH])
        return join_on(left, steps, [*keys, *cell[:REACH]], "inner").where(dist2 < bandwidth * bandwidth)

    while not left.isEmpty():
        # a seed always meets its own row, so every top has a nearest best
        tops = left.groupBy(*keys, *cell).agg(F.min("m").alias("m"))
        best_near = within_reach(tops).groupBy(*keys, "__top").agg(F.min("m").alias("m"))
        modes = stored(best_near.where(F.col("m") == F.col("__top")).select(*keys, "m", *[
            F.floor(F.col("m")[y] / bandwidth).cast("long").alias(c) for y, c in zip(ys, cell)]))
        found = found.unionByName(modes)
        gone = within_reach(modes).select(*keys, "m", F.lit(True).alias("__gone")).distinct()
        left = stored(join_on(left, gone, [*keys, "m"]).where(F.col("__gone").isNull()).drop("__gone"))
    return found.select(*keys, (-F.col("m")["w"]).alias("strength"), *[F.col("m")[y].alias(y) for y in ys])


def _nearest_modes(cells: DataFrame, modes: DataFrame, dims: int, bandwidth: float,
                   keys: Sequence[str]) -> DataFrame:
    """Occupied cells ``(keys, k0..)`` of one bandwidth with ``near``, the
    modes that can be nearest to some point of the cell: those whose least
    distance to the box is not above the smallest greatest distance.  Modes
    are looked for in neighbouring cells of 2, 4, 8 .. bandwidths until that
    bound lies within the width, so none further away can count."""
    keys, ys = list(keys), [f"y{i}" for i in range(dims)]
    cell, big = [f"k{i}" for i in range(dims)], [f"g{i}" for i in range(min(dims, REACH))]
    low = [F.col(c) * bandwidth for c in cell]
    least = sum(F.greatest(lo - F.col(y), F.col(y) - (lo + bandwidth), F.lit(0.0)) ** 2 for lo, y in zip(low, ys))
    most = sum(F.greatest(F.abs(F.col(y) - lo), F.abs(F.col(y) - (lo + bandwidth))) ** 2 for lo, y in zip(low, ys))
    entry = F.struct("segment", *ys)
    todo, out, width = cells, None, 1
    while not todo.isEmpty():
        width *= 2
        spread = _steps_to(modes.select(*keys, "segment", *ys, *[
            F.floor(F.col(y) / (bandwidth * width)).cast("long").alias(g) for y, g in zip(ys, big)]), big)
        at = todo.select(*keys, *cell, *[F.floor(F.col(c) / width).cast("long").alias(g) for c, g in zip(cell, big)])
        met = join_on(at, spread, [*keys, *big], "inner").select(*keys, *cell, "segment", *ys, least.alias("__least"),
                                                                  most.alias("__most"))
        bound = met.groupBy(*keys, *cell).agg(F.min("__most").alias("__bound"))
        bound = bound.where(F.col("__bound") <= (bandwidth * width) ** 2)
        # a hair of slack, so that rounding of a distance loses no mode
        near = (join_on(met, bound, [*keys, *cell], "inner").where(F.col("__least") <= F.col("__bound") * (1 + 1e-9))
                .groupBy(*keys, *cell).agg(F.array_sort(F.collect_list(entry)).alias("near")))
        near = stored(near)
        out = near if out is None else out.unionByName(near)
        done = near.select(*keys, *cell, F.lit(True).alias("__done"))
        todo = stored(join_on(todo, done, [*keys, *cell]).where(F.col("__done").isNull()).drop("__done"))
    if out is None:      # no cells
        kind = ",".join(f"{y}:double" for y in ys)
        return cells.withColumn("near", F.array().cast(f"array<struct<segment:int,{kind}>>"))
    return out


def segment_meanshift(pixels_wide: DataFrame, bands: Sequence[str], bandwidth: float = 0.5,
                      max_iter: int = 50, tol: float = 1e-3, keys: Sequence[str] = (IMG,)) -> DataFrame:
    """Flat-kernel mean shift, each image by itself (``keys=[]`` pools
    all).  Pixels are quantised to cells of one bandwidth (weighted cell table;
    a cell's seed is its centroid); every iteration moves each seed to the
    weighted mean of the cells within one bandwidth, found by an equi-join on
    neighbouring cell ids.  Converged seeds closer than a bandwidth are merged
    (``separate_modes``); pixels take the label of the nearest mode (ties: the
    stronger one).  Labels count an image's modes from the strongest, pixels
    with a missing, NaN or infinite band have -1.  Neither seeds nor modes pass the driver."""
    bands, keys = list(bands), list(keys)
    d = len(bands)
    ys, cell = [f"y{i}" for i in range(d)], [f"k{i}" for i in range(d)]
    whole = F.lit(True)
    for b in bands:
        whole = whole & F.coalesce(F.abs(F.col(b).cast("double")) < float("inf"), F.lit(False))
    place = [F.floor(F.col(b) / bandwidth).cast("long").alias(c) for b, c in zip(bands, cell)]
    cells = stored(pixels_wide.where(whole).groupBy(*keys, *place)
                        .agg(F.count(F.lit(1)).alias("w"), *[F.avg(b).alias(f"x{i}") for i, b in enumerate(bands)]))
    seeds = cells.select(*keys, F.monotonically_increasing_id().alias("sid"), F.col("w").cast("double").alias("strength"),
                         *[F.col(f"x{i}").alias(y) for i, y in enumerate(ys)])
    gap2 = sum((F.col(f"x{i}") - F.col(y)) ** 2 for i, y in enumerate(ys))
    moving, still = seeds, None
    for _ in range(max_iter):
        probe = _steps_to(moving.select(*keys, "sid", *ys, *[
            F.floor(F.col(y) / bandwidth).cast("long").alias(c) for y, c in zip(ys, cell[:REACH])]), cell[:REACH])
        near = join_on(probe, cells, [*keys, *cell[:REACH]], "inner").where(gap2 <= bandwidth * bandwidth)
        moved = near.groupBy(*keys, "sid", *ys).agg(
            *[(F.sum(F.col(f"x{i}") * F.col("w")) / F.sum("w")).alias(f"n{i}") for i in range(d)],
            F.sum("w").cast("double").alias("strength"))
        step = F.sqrt(sum((F.col(f"n{i}") - F.col(y)) ** 2 for i, y in enumerate(ys)))
        moved = stored(moved.select(*keys, "sid", "strength", step.alias("__step"),
                                         *[F.col(f"n{i}").alias(y) for i, y in enumerate(ys)]))
        # a seed that came back to its own place has the same cells around it from now on
        rest = moved.where("__step = 0").drop("__step")
        still = rest if still is None else still.unionByName(rest)
        moving = moved.where("__step > 0").drop("__step")
        if (moved.agg(F.max("__step").alias("s")).first()["s"] or 0.0) < tol * bandwidth:
            break
    seeds = moving if still is None else still.unionByName(moving)
    modes = separate_modes(seeds, d, bandwidth, tol, keys).withColumn("__weak", -F.col("strength"))
    order = ["__weak", *ys]
    modes = stored(blocks.with_index(blocks.ranges(modes, keys, order), keys, order, "segment")
                        .select(*keys, F.col("segment").cast("int").alias("segment"), *ys))
    near = _nearest_modes(cells.select(*keys, *cell), modes, d, bandwidth, keys)
    placed = join_on(pixels_wide.where(whole).select("*", *place), near, [*keys, *cell], "inner")
    nearest = F.array_min(F.transform("near", lambda m: F.struct(
        sum((F.col(b) - m[y]) ** 2 for b, y in zip(bands, ys)).alias("d"), m["segment"].alias("segment"))))["segment"]
    return (placed.select(*pixels_wide.columns, nearest.alias("segment"))
            .unionByName(pixels_wide.where(~whole).withColumn("segment", F.lit(-1))))


def segment_slic(pixels_wide: DataFrame, bands: Sequence[str], n_segments: int = 5, compactness: float = 10.0,
                 iterations: int = 10) -> DataFrame:
    """SLIC superpixels per image.  Seeds start on a regular grid of
    step S = sqrt(H*W / n); each iteration assigns every pixel to the
    nearest seed (colour distance + (spatial distance / S) * compactness)
    among the seeds whose grid cell neighbours the pixel's cell (equi-join
    on cell ids, nine candidate cells), then moves seeds to the mean of
    their pixels.  Labels are 0-based seed ids per image."""
    bands = list(bands)
    px = pixels_wide.na.drop(subset=bands)
    dims = px.groupBy(IMG).agg((F.max("row") + 1).alias("H"), (F.max("col") + 1).alias("W"))
    dims = dims.withColumn("S", F.greatest(F.sqrt(F.col("H") * F.col("W") / F.lit(float(n_segments))), F.lit(1.0)))
    px = px.join(dims, IMG)
    # initial seeds: pixel means of each grid cell
    gy, gx = F.floor(F.col("row") / F.col("S")).cast("long"), F.floor(F.col("col") / F.col("S")).cast("long")
    seeds = (px.groupBy(IMG, gy.alias("gy"), gx.alias("gx"), "S")
             .agg(F.avg("row").alias("sr"), F.avg("col").alias("sc"), *[F.avg(b).alias(f"s_{b}") for b in bands]))
    seeds = seeds.withColumn("seed", F.dense_rank().over(Window.partitionBy(IMG).orderBy("gy", "gx")) - 1)
    seeds = cut_lineage(seeds)
    offs = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    base = px.select(IMG, "row", "col", "S", *bands, gy.alias("py"), gx.alias("px"))
    assigned = None
    for _ in range(iterations):
        cand = base.select("*", F.explode(offs).alias("o")).select(
            IMG, "row", "col", "S", *bands, (F.col("py") + F.col("o.dy")).alias("gy"),
            (F.col("px") + F.col("o.dx")).alias("gx"))
        j = cand.join(seeds.select(IMG, "gy", "gx", "seed", "sr", "sc", *[f"s_{b}" for b in bands]),
                      [IMG, "gy", "gx"])
        dc = sum((F.col(b) - F.col(f"s_{b}")) ** 2 for b in bands)
        ds = (F.col("row") - F.col("sr")) ** 2 + (F.col("col") - F.col("sc")) ** 2
        dist = dc + ds / (F.col("S") * F.col("S")) * (compactness ** 2)
        best = j.groupBy(IMG, "row", "col").agg(F.min_by("seed", F.struct(dist, F.col("seed"))).alias("seed"))
        assigned = px.select(IMG, "row", "col", *bands).join(best, [IMG, "row", "col"])
        upd = assigned.groupBy(IMG, "seed").agg(F.avg("row").alias("sr"), F.avg("col").alias("sc"),
                                                *[F.avg(b).alias(f"s_{b}") for b in bands])
        seeds = cut_lineage(seeds.select(IMG, "seed", "gy", "gx", "S").join(upd, [IMG, "seed"]))
    return assigned.select(IMG, "row", "col", *bands, F.col("seed").cast("int").alias("segment"))

