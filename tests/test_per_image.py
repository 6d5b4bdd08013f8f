"""One model per image: an image's result does not depend on other images, on
the partitioning, or on the order of rows."""

import numpy as np
import pytest

from envspark.operators import detectors, models, raster_models

RNG = np.random.default_rng(12)
SCHEMA = "image_id long, row long, col long, a double, b double, c double"


def _image(i, scale, n=20):
    x = RNG.normal(scale, 0.05 * scale, (n * n, 3))
    x[: n * n // 2] += scale
    x[7] = [9 * scale, -4 * scale, 5 * scale]
    rows = [(i, k // n, k % n, *map(float, p)) for k, p in enumerate(x)]
    return [(*r[:3], None, *r[4:]) if r[1:3] == (3, 3) else r for r in rows]


ONE = _image(1, 1.0)
MORE = _image(2, 100.0) + [r for i in (3, None) for r in _image(i, 0.01)] + [(4, 0, 0, 1.0, 1.0, 1.0)] * 3


def _by_place(df, value):
    return {(r.row, r.col): r[value] for r in df.where("image_id = 1").collect()}


OPERATORS = {
    "kmeans": (lambda df: models.segment_kmeans(df, ["a", "b", "c"], 3)[0], "segment"),
    "reconstruction": (lambda df: models.reconstruction_score(df, ["a", "b", "c"], 1), "score"),
    "forest": (lambda df: detectors.isolation_forest(df, ["a", "b", "c"], 0.01, n_trees=30, keys=["image_id"]), "score"),
    "forest_flags": (lambda df: detectors.isolation_forest(df, ["a", "b", "c"], 0.01, n_trees=30, keys=["image_id"]), "anomaly"),
    "pixel_anomaly": (lambda df: raster_models.pixel_anomaly(df, ["a", "b", "c"], "reconstruction"), "value"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_an_image_stands_alone(spark, name):
    run, value = OPERATORS[name]
    alone = _by_place(run(spark.createDataFrame(ONE, SCHEMA).repartition(3)), value)
    both = run(spark.createDataFrame(MORE + ONE[::-1], SCHEMA).repartition(9))
    among = _by_place(both, value)
    assert alone.keys() == among.keys()
    for at, v in alone.items():
        w = among[at]
        assert (v is None) == (w is None) and (v is None or v == w or abs(v - w) < 1e-9), (at, v, w)
    assert both.where("image_id is null").count() == 400 or name == "pixel_anomaly"


def test_forest_does_not_depend_on_partitions(spark):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(RNG.normal(0, 1, (3000, 2)))] + [(5000, None, 1.0)]
    rows += [(6000 + i, 0.5, 0.5) for i in range(600)]           # many equal points
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = [{r["id"]: (r["score"], r["anomaly"]) for r in detectors.isolation_forest(
        df.repartition(n, "b") if n > 1 else df.coalesce(1), ["a", "b"], 0.02, n_trees=20).collect()} for n in (1, 50)]
    assert got[0] == got[1] and got[0][5000] == (None, False) and len(got[0]) == len(rows)
    trees = detectors.fit_isolation_forest(df, ["a", "b"], 20).collect()
    assert len(trees) == 20 and all(t["size"][0] == 256 for t in trees)


def test_kmeans_is_lloyd_and_restarts_do_not_hurt(spark):
    df = spark.createDataFrame(ONE, SCHEMA)
    out, cost = models.segment_kmeans(df, ["a", "b", "c"], 4, max_iter=60, n_init=6, tol=1e-9)
    p = out.toPandas()
    assert p.segment.isna().sum() == 1
    p = p.dropna()
    x, lab = p[["a", "b", "c"]].to_numpy(), p.segment.to_numpy(int)
    centres = np.array([x[lab == s].mean(0) for s in range(4)])
    far = ((x[:, None] - centres) ** 2).sum(2)
    assert (far.argmin(1) == lab).all()                          # a fixed point of Lloyd's step
    assert np.isclose(cost.first()["cost"], far.min(1).sum())
    single = models.segment_kmeans(df, ["a", "b", "c"], 4, max_iter=60, n_init=1, tol=1e-9)[1].first()["cost"]
    assert cost.first()["cost"] <= single + 1e-9


def test_kmeans_of_small_images_settles_where_their_pixels_are(spark, monkeypatch):
    """Images of one block take no rounds of jobs; blocks do not change the
    segments, the keys or the pixels without one."""
    rows = MORE + [(2 ** 60 + 1, *r[1:]) for r in ONE]
    df, bands = spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"]
    dealt, costs = models.segment_kmeans(df, bands, 4, block=60)
    monkeypatch.setattr(models, "_start_centres", None)          # not called
    whole, cost = models.segment_kmeans(df, bands, 4)
    assert whole.count() == len(rows) and whole.where("image_id = 1152921504606846977").count() == 400
    assert sorted(map(str, whole.collect())) == sorted(map(str, dealt.collect()))
    a, b = ({r.image_id: r.cost for r in c.collect()} for c in (cost, costs))
    assert a.keys() == b.keys() == {2, 3, 4, None, 2 ** 60 + 1} and all(np.isclose(a[i], b[i]) for i in a)


def test_reconstruction_matches_numpy(spark):
    p = models.reconstruction_score(spark.createDataFrame(ONE, SCHEMA), ["a", "b", "c"], 2).toPandas()
    assert p.score.isna().sum() == 1
    p = p.dropna()
    x = p[["a", "b", "c"]].to_numpy() - p[["a", "b", "c"]].to_numpy().mean(0)
    v = np.linalg.svd(x, full_matrices=False)[2][:2]
    mse = ((x - x @ v.T @ v) ** 2).mean(1)
    assert np.allclose(p.score, (mse - mse.min()) / (mse.max() - mse.min() + 1e-10), atol=1e-8)


def test_forest_of_small_images_is_grown_where_their_rows_are(spark, monkeypatch):
    """Images of up to psi rows need no copies of rows per tree; scores are
    those of the trees of ``fit_isolation_forest``."""
    rows = [r for i in range(6) for r in _image(i, 1.0 + i, 7)] + [r for r in _image(None, 2.0, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    cols = ["a", "b", "c"]
    trees = detectors.fit_isolation_forest(df, cols, 12, 64, keys=["image_id"]).toPandas()
    monkeypatch.setattr(detectors, "fit_isolation_forest", None)        # not called
    got = detectors.isolation_forest(df, cols, n_trees=12, psi=64, keys=["image_id"]).toPandas()
    assert len(got) == len(rows)
    for image, mine in got.groupby("image_id", dropna=False):
        grown = trees[trees.image_id.isna() if image != image else trees.image_id == image].sort_values("tree")
        want = detectors._forest_scores(mine[cols].to_numpy(float), list(zip(*[
            grown[p] for p in ("feature", "threshold", "left", "right", "size", "depth")])))
        assert len(grown) == 12 and np.array_equal(mine.score.to_numpy(float), want, equal_nan=True)
        assert mine.score.isna().sum() == 1
