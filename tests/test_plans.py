"""Physical-plan assertions: the shapes the operators are designed to have."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = E.queries()


def _plan(spark, name):
    df = Q[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_spatial_joins_are_equi_joins(spark):
    for name in ("j7_detections_in_images", "j6_clip_pixels"):
        p = _plan(spark, name)
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_listing_filters_pushed_to_scan(spark):
    p = _plan(spark, "f2_list_detections")
    assert "PushedFilters: [" in p and "IsNotNull(ts)" in p
    assert "TakeOrderedAndProject" in p


def test_column_pruning_on_scan(spark):
    p = _plan(spark, "a4_detection_counts")
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "value" not in scan.split("ReadSchema:")[1]          # unused event column not read


def test_last_window_is_cut_before_shuffle(spark):
    p = _plan(spark, "n1_window_features")
    assert "WindowGroupLimit" in p


def test_latest_per_source_is_partial_aggregate(spark):
    p = _plan(spark, "w5_latest_per_source")
    assert "max_by" in p and "Window" not in p


def test_resample_has_no_spine_join(spark):
    p = _plan(spark, "p1_resample_mean")
    assert "Join" not in p


def test_multilevel_grid_join_matches_brute_force(spark):
    import numpy as np
    from envspark.operators.joins import detections_in_images
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-180, 180, (400, 2)) * [1, 0.5])]
    boxes = []
    for j, ext in enumerate([0.01, 0.5, 3.0, 40.0, 300.0] * 4):
        x0, y0 = rng.uniform(-180, 180 - ext), rng.uniform(-90, 90 - min(ext, 170))
        boxes.append((j, float(x0), float(y0), float(x0 + ext), float(y0 + min(ext, 170))))
    d = spark.createDataFrame(pts, "id long, lon double, lat double")
    im = spark.createDataFrame(boxes, "id long, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {(r[0], r[1]) for r in detections_in_images(d, im).collect()}
    want = {(p[0], b[0]) for p in pts for b in boxes if b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4]}
    assert got == want and len(want) > 0
