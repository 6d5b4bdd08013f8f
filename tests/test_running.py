"""Running z-score over micro-batches (X10) and mean-shift modes
against NumPy."""

import datetime as dt
import uuid

import numpy as np
import pytest

from envspark.operators import raster_models
from envspark.streaming import streams

SCHEMA = "source_id long, id long, ts timestamp_ntz, humidity double"
T0 = dt.datetime(2024, 1, 1)


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _expected(rows):
    """z-scores of rows given in order of arrival (batches) and time."""
    seen, out = {}, {}
    for key, rid, _ts, v in rows:
        prev = np.array(seen.setdefault(key, []))
        ok = v is not None and v == v
        sd = prev.std(ddof=1) if len(prev) > 1 else 0.0
        out[rid] = (v - prev.mean()) / sd if ok and sd > 0 else None
        if ok:
            seen[key].append(v)
    return out


def _rows(n, start, rng, keys=(1, 2, None)):
    rows = []
    for i in range(n):
        v = float(rng.normal(1e6, 0.5))
        v = None if i % 17 == 5 else float("nan") if i % 23 == 7 else v
        # a hot sensor, a slow one, readings without a sensor
        rows.append((keys[0] if i % 4 else keys[1 + i // 4 % 2], start + i, T0 + dt.timedelta(seconds=start + i // 2), v))
    return rows


def _check(got, want):
    assert len(got) == sum(len(w) for w in want)
    flat = [r for w in want for r in w]
    z = _expected(flat)
    by_place = {}
    for k, rid, ts, v in flat:
        by_place.setdefault((k, ts), []).append(z[rid])
    for r in got:
        options = by_place[(r["source_id"], r["ts"])]
        assert any((r["zscore"] is None and e is None) or
                   (e is not None and r["zscore"] is not None and abs(r["zscore"] - e) < 1e-6) for e in options)
        assert r["anomaly"] == (r["zscore"] is not None and abs(r["zscore"]) > 2.0)


def test_running_zscore_over_ranges_batches_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(11)
    src, base = str(tmp_path / "in"), str(tmp_path / f"z-{uuid.uuid4().hex}")
    parts = [_rows(200, 0, rng), _rows(150, 1000, rng), _rows(60, 2000, rng, keys=(2, 3, 1))]
    _write(spark, parts[0], src)
    _write(spark, parts[1], src)
    first = streams.running_zscore_table(_stream(spark, src), "humidity", 2.0, base=base)
    _check(first.collect(), parts[:2])
    _write(spark, parts[2], src)                       # a new query on the same folder goes on
    again = streams.running_zscore_table(_stream(spark, src), "humidity", 2.0, base=base)
    _check(again.collect(), parts)


def test_running_zscore_epoch_run_again(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    src, base = str(tmp_path / "in"), str(tmp_path / "z")
    parts = [_rows(80, 0, rng), _rows(80, 1000, rng)]
    for p in parts:
        _write(spark, p, src)
    real, calls = streams.score_running, []

    def failing(batch, state, *a):
        scored, following = real(batch, state, *a)
        calls.append(1)
        if len(calls) == 2:                            # epoch 1: results written, then lost before the state
            scored.write.mode("overwrite").parquet(f"{base}/data/epoch=1")
            raise ValueError("executor gone")
        return scored, following
    monkeypatch.setattr(streams, "score_running", failing)
    with pytest.raises(Exception, match="executor gone"):
        streams.running_zscore_table(_stream(spark, src), "humidity", 2.0, base=base)
    monkeypatch.setattr(streams, "score_running", real)
    out = streams.running_zscore_table(_stream(spark, src), "humidity", 2.0, base=base)
    _check(out.collect(), parts)


def _greedy(points, strength, bandwidth):
    order = sorted(range(len(points)), key=lambda i: (-strength[i], *points[i]))
    kept = []
    for i in order:
        if all(((points[i] - points[j]) ** 2).sum() >= bandwidth ** 2 for j in kept):
            kept.append(i)
    return points[kept]


@pytest.mark.parametrize("dims", [1, 2])
def test_separated_modes_equal_the_ordered_choice(spark, dims):
    rng = np.random.default_rng(dims)
    pts = rng.uniform(-0.8, 0.8, (60, dims))
    strength = rng.integers(1, 6, 60).astype(float)    # many ties
    seeds = spark.createDataFrame([(0, *map(float, p), float(w)) for p, w in zip(pts, strength)]
                                  + [(1, *map(float, p), 1.0) for p in pts[:20]],
                                  "g long, " + ", ".join(f"y{i} double" for i in range(dims)) + ", strength double")
    out = raster_models.separate_modes(seeds, dims, 0.5, 1e-9, ["g"]).toPandas()
    for g, p, w in ((0, pts, strength), (1, pts[:20], np.ones(20))):
        got = out[out.g == g][[f"y{i}" for i in range(dims)]].to_numpy()
        assert sorted(map(tuple, got)) == sorted(map(tuple, _greedy(p, w, 0.5)))


def _numpy_shift(X, h, tol=1e-3, max_iter=50):
    keys, inv = np.unique(np.floor(X / h), axis=0, return_inverse=True)
    inv = inv.ravel()
    w = np.bincount(inv).astype(float)
    C = np.stack([np.bincount(inv, X[:, i]) for i in range(X.shape[1])], axis=1) / w[:, None]
    Y = C.copy()
    for _ in range(max_iter):
        near = ((Y[:, None] - C[None]) ** 2).sum(2) <= h * h
        wn = near * w
        N = (wn[:, :, None] * C[None]).sum(1) / wn.sum(1)[:, None]
        step = np.sqrt(((N - Y) ** 2).sum(1)).max()
        Y, s = N, wn.sum(1)
        if step < tol * h:
            break
    return _greedy(Y, s, h), s


def test_meanshift_per_image_equals_numpy(spark):
    rng = np.random.default_rng(4)
    images = {0: np.concatenate([rng.normal(c, 0.05, (60, 2)) for c in ((0, 0), (1, 1), (0, 3))]),
              1: rng.normal(0.4, 0.02, (50, 2)),
              2: np.concatenate([rng.normal(c, 0.02, (20, 2)) for c in ((0, 0), (40, 0))])}
    rows = [(g, 0, i, float(a), float(b), "x") for g, X in images.items() for i, (a, b) in enumerate(X)]
    rows += [(0, 1, 0, None, 1.0, None), (1, 1, 0, float("nan"), 1.0, "n"), (3, 0, 0, 1.0, float("inf"), "i"),
             (2, 0, 999, 20.5, 0.1, "far")]            # nearest mode many bandwidths away
    images[2] = np.concatenate([images[2], [[20.5, 0.1]]])
    df = spark.createDataFrame(rows, "image_id long, row long, col long, a double, b double, note string")
    out = raster_models.segment_meanshift(df, ["a", "b"], bandwidth=0.3)
    assert out.columns == [*df.columns, "segment"]
    out = out.toPandas()
    assert len(out) == len(rows)
    bad = out[(out.a.isna()) | (out.b == np.inf)]
    assert len(bad) == 3 and (bad.segment == -1).all()
    for g, X in images.items():
        modes, _ = _numpy_shift(X, 0.3)
        mine = out[(out.image_id == g) & (out.segment >= 0)]
        assert len(mine) == len(X)
        P = mine[["a", "b"]].to_numpy()
        near = ((P[:, None] - modes[None]) ** 2).sum(2).argmin(1)
        pairs = set(zip(near, mine.segment))
        assert len(pairs) == len(set(near)) == len(set(mine.segment))     # one label per mode
        assert set(mine.segment) <= set(range(len(modes)))


def test_meanshift_deals_rows_by_two_coordinates(spark, monkeypatch):
    """Seeds, tops and modes go to nine cells, however many bands there are."""
    steps, dealt = raster_models._steps_to, []
    monkeypatch.setattr(raster_models, "_steps_to", lambda df, cell: dealt.append(len(cell)) or steps(df, cell))
    rows = [(1, 0, i, *[float(10 * (i % 2) + 0.01 * (i // 2 + b)) for b in range(4)]) for i in range(8)]
    df = spark.createDataFrame(rows, "image_id long, row long, col long, a double, b double, c double, d double")
    out = raster_models.segment_meanshift(df, ["a", "b", "c", "d"], bandwidth=0.5)
    assert [r.segment for r in out.orderBy("col").collect()] in ([0, 1] * 4, [1, 0] * 4)
    assert dealt and max(dealt) == 2


def test_meanshift_without_pixels(spark):
    df = spark.createDataFrame([], "image_id long, row long, col long, a double")
    assert raster_models.segment_meanshift(df, ["a"]).count() == 0
    df = spark.createDataFrame([(0, 0, 0, None)], "image_id long, row long, col long, a double")
    assert [r["segment"] for r in raster_models.segment_meanshift(df, ["a"], keys=[]).collect()] == [-1]
