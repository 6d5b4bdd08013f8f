"""Model-backed operators.

D1/D2 run a *user-supplied* batch predictor over a DataFrame with
``predict_batch_udf``: the model is built once per Python worker and fed
Arrow batches.  R13/R14 fit one model per image: sufficient statistics by
image, every image advancing in the same job.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.operators import stats
from envspark.operators.common import attach, join_on
from envspark.session import ship_package, stored


def score(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
          cols: Sequence[str], out_col: str = "prediction", batch_size: int = 1024) -> DataFrame:
    """Batch inference.  ``make_predict_fn`` returns a function mapping a
    (batch, n_features) float array to a (batch,) array; it is called once
    per worker (model load), never per row."""
    ship_package(df.sparkSession)
    udf = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[len(cols)]])
    return df.withColumn(out_col, udf(F.array(*[F.col(c).cast("double") for c in cols])))


def evaluate(df: DataFrame, make_predict_fn, cols: Sequence[str], label_col: str,
             loss: Callable[[F.Column, F.Column], F.Column] | None = None, keys=()) -> DataFrame:
    """Mean loss of a predictor (default squared error) as a weighted
    aggregate (A15) - no gradients, one pass."""
    scored = score(df, make_predict_fn, cols)
    loss = loss or (lambda p, y: (p - y) * (p - y))
    per = scored.select(*keys, loss(F.col("prediction"), F.col(label_col).cast("double")).alias("loss"),
                        F.lit(1).alias("n"))
    return stats.mean_loss(per, "loss", "n", keys)


def reconstruction_score(pixels_wide: DataFrame, bands: Sequence[str], k: int = 2,
                         keys=("image_id",)) -> DataFrame:
    """A linear bottleneck (``k`` principal components of the image's own
    pixels) stands in for the small dense autoencoder: the anomaly score is
    the mean squared reconstruction residual, min-max scaled to [0, 1] per
    image.  Pixels with a null band have no score.

    All images are fitted at once: one partial aggregate gives every image its
    means and covariances, the components come from that table, and the pixels
    meet the projector of their image in one join."""
    ship_package(pixels_wide.sparkSession)
    keys, bands = list(keys), list(bands)
    d = len(bands)
    x = [F.col(b).cast("double") for b in bands]
    whole = functools.reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in bands])
    moments = pixels_wide.where(whole).groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in x]).alias("__mean"),
        F.array(*[F.covar_pop(x[min(i, j)], x[max(i, j)]) for i in range(d) for j in range(d)]).alias("__cov"))
    kinds = dict(pixels_wide.dtypes)

    def project(it):
        for pdf in it:
            out = []
            for c in pdf["__cov"]:
                values, vectors = np.linalg.eigh(np.asarray(c, float).reshape(d, d))
                top = vectors[:, np.argsort(-values, kind="stable")[:k]]
                out.append((top @ top.T).ravel())
            yield pdf[[*keys, "__mean"]].assign(__proj=out)
    fitted = moments.mapInPandas(project, "".join(f"`{c}` {kinds[c]}, " for c in keys)
                                 + "__mean array<double>, __proj array<double>")
    j = attach(pixels_wide, fitted, keys)
    c = [x[i] - F.col("__mean")[i] for i in range(d)]
    left = [c[i] - sum(F.col("__proj")[i * d + m] * c[m] for m in range(d)) for i in range(d)]
    scored = j.select(*pixels_wide.columns, (sum(e * e for e in left) / d).alias("__mse"))
    span = scored.groupBy(*keys).agg(F.min("__mse").alias("__lo"), F.max("__mse").alias("__hi"))
    return attach(scored, span, keys).select(
        *pixels_wide.columns, ((F.col("__mse") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-10)).alias("score"))


def _drawn(x: np.ndarray, weight: np.ndarray, k: int, n_init: int, seed: int) -> list[np.ndarray]:
    """k-means++ centres of every restart, drawn from weighted vectors."""
    out = []
    for r in range(n_init):
        rng = np.random.default_rng([seed, r])
        far, chosen = np.ones(len(x)), []
        for _ in range(min(k, len(x))):
            p = weight * far
            if p.sum() <= 0:
                break
            chosen.append(x[rng.choice(len(x), p=p / p.sum())])
            near = ((x - chosen[-1]) ** 2).sum(1)
            far = near if len(chosen) == 1 else np.minimum(far, near)
        out.append(np.array(chosen))
    return out


def _start_centres(points: DataFrame, keys: list[str], k: int, n_init: int, seed: int, sample: int) -> DataFrame:
    """Centres of every key and restart, drawn from the ``sample`` distinct
    points of smallest hash (a sample that merges over partitions)."""
    w = Window.partitionBy(*keys).orderBy("__h", "__x") if keys else Window.orderBy("__h", "__x")
    some = points.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= sample).drop("__h")
    kinds = dict(points.dtypes)

    def draw(pdf):
        pdf = pdf.sort_values("__rn")
        starts = _drawn(np.stack(pdf["__x"]).astype(float), pdf["__w"].to_numpy(float), k, n_init, seed)
        out = pd.DataFrame([(r, c.tolist()) for r, c in enumerate(starts)], columns=["__r", "__c"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "__r", "__c"]]
    return some.groupBy(*keys).applyInPandas(draw, "".join(f"`{c}` {kinds[c]}, " for c in keys)
                                             + "__r int, __c array<array<double>>")


def _lloyd(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, weighted sum and cost of the vectors nearest to each centre;
    the lower index of equals."""
    far = np.zeros((len(x), len(c)))
    for j in range(x.shape[1]):
        far += (x[:, j, None] - c[:, j]) ** 2
    i = far.argmin(1)
    n = np.bincount(i, w, len(c))
    sums = np.stack([np.bincount(i, w * x[:, j], len(c)) for j in range(x.shape[1])], 1)
    return n, sums, np.bincount(i, w * far[np.arange(len(x)), i], len(c))


def _vectors(batch, width: int):
    """Vectors and weights of each row of an Arrow batch of blocks."""
    for x, w in zip(batch.column("__x"), batch.column("__w")):
        yield x.values.to_numpy().reshape(-1, width), w.values.to_numpy().astype(float)


def _nearest(x: str, centres: str) -> Column:
    """(distance, index) of the nearest centre; the lower index of equals."""
    far = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    return F.array_min(F.transform(F.col(centres), lambda c, i: F.struct(far(c).alias("d"), i.alias("i"))))


def segment_kmeans(pixels_wide: DataFrame, bands: Sequence[str], k: int = 5, seed: int = 42, max_iter: int = 20,
                   n_init: int = 4, tol: float = 1e-4, keys=("image_id",), block: int = 1024,
                   sample: int = 512) -> tuple[DataFrame, DataFrame]:
    """K-means over the band vectors of each image, the best of
    ``n_init`` restarts from k-means++ centres; returns (pixels with
    ``segment``, cost per image).  Labels are arbitrary cluster ids; pixels
    with a null band have none.

    The distinct vectors of an image are dealt by hash into blocks of about
    ``block``, one row each, which are moved once.  An image of one block takes
    its Lloyd steps where the block is.  The others take a step together:
    blocks meet the centres of their image, and aggregates of (image, restart,
    cluster) give the next ones; images that have settled drop out."""
    ship_package(pixels_wide.sparkSession)
    keys, bands = list(keys), list(bands)
    vector, width = F.array(*[F.col(b).cast("double") for b in bands]), len(bands)
    points = (pixels_wide.select(*keys, vector.alias("__x")).where(F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v)))
              .groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__w"))
              .select(*keys, F.xxhash64("__x", F.lit(seed)).alias("__h"), "__x", "__w"))
    points = stored(points)
    parts = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("__parts"))
    blocks = stored(attach(points, parts, keys, "inner")
                    .groupBy(*keys, "__parts", F.expr("pmod(__h, __parts)").alias("__part"))
                    .agg(F.array_sort(F.collect_list(F.struct("__h", "__x", "__w"))).alias("__p")))
    flat = blocks.select(*keys, "__parts", F.flatten("__p.__x").alias("__x"), F.col("__p.__w").alias("__w"))
    kinds = "".join(f"`{c}` {t}, " for c, t in points.select(*keys).dtypes)

    def with_columns(batch, at, **columns):
        own = [batch.column(c).take(pa.array(at, pa.int64())) for c in keys]
        return pa.RecordBatch.from_arrays([*own, *columns.values()], [*keys, *columns])

    def fit(batches):
        for batch in batches:
            costs, best = [], []
            for x, w in _vectors(batch, width):
                found = []
                for r, c in enumerate(_drawn(x[:sample], w[:sample], k, n_init, seed)):
                    for _ in range(max_iter):
                        n, sums, _ = _lloyd(x, w, c)
                        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
                        moved, c = ((c - new) ** 2).sum(1).max(), new
                        if moved <= tol * tol:
                            break
                    found.append((_lloyd(x, w, c)[2].sum(), r, c))
                cost, _, c = min(found, key=lambda f: f[:2])
                costs.append(cost)
                best.append(c.tolist())
            yield with_columns(batch, np.arange(len(costs)), cost=pa.array(costs, pa.float64()),
                               __c=pa.array(best, pa.list_(pa.list_(pa.float64()))))

    def step(batches):
        for batch in batches:
            at, run, cluster, weight, total, cost = [], [], [], [], [], []
            for b, ((x, w), state) in enumerate(zip(_vectors(batch, width), batch.column("__s").to_pylist())):
                for s in state:
                    n, sums, far = _lloyd(x, w, np.array(s["__c"]))
                    own = np.flatnonzero(n)
                    at += [b] * len(own)
                    run += [s["__r"]] * len(own)
                    cluster += own.tolist()
                    weight += n[own].tolist()
                    total += sums[own].tolist()
                    cost += far[own].tolist()
            yield with_columns(batch, at, __r=pa.array(run, pa.int32()), __i=pa.array(cluster, pa.int32()),
                               __n=pa.array(weight, pa.float64()), __sum=pa.array(total, pa.list_(pa.float64())),
                               __cost=pa.array(cost, pa.float64()))

    best = (flat.where("__parts = 1").select(*keys, "__x", "__w")
            .mapInArrow(fit, kinds + "cost double, __c array<array<double>>"))
    large = flat.where("__parts > 1")
    if not large.isEmpty():
        run = [*keys, "__r"]

        def steps(state):
            at = state.groupBy(*keys).agg(F.collect_list(F.struct("__r", "__c")).alias("__s"))
            return (attach(large, at, keys, "inner").select(*keys, "__x", "__w", "__s")
                    .mapInArrow(step, kinds + "__r int, __i int, __n double, __sum array<double>, __cost double"))
        some = blocks.where("__parts > 1").select(*keys, F.inline(F.slice("__p", 1, sample)))
        state = stored(_start_centres(some, keys, k, n_init, seed, sample).withColumn("__open", F.lit(True)))
        for _ in range(max_iter):
            sums = steps(state.where("__open")).groupBy(*run, "__i").agg(F.sum("__n").alias("__n"), *[
                F.sum(F.col("__sum")[i]).alias(f"__s{i}") for i in range(width)])
            means = sums.groupBy(*run).agg(F.map_from_entries(F.collect_list(F.struct(
                "__i", F.array(*[F.col(f"__s{i}") / F.col("__n") for i in range(width)])))).alias("__m"))
            moved = join_on(state.where("__open"), means, run, "inner").withColumn(
                "__new", F.transform("__c", lambda c, i: F.coalesce(F.col("__m")[i], c)))
            shift = F.array_max(F.zip_with("__c", "__new", lambda a, b: F.aggregate(
                F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)))
            state = stored(moved.select(*run, F.col("__new").alias("__c"), (shift > tol * tol).alias("__open"))
                           .unionByName(state.where("not __open")))
            if state.where("__open").limit(1).count() == 0:
                break
        costs = steps(state).groupBy(*run).agg(F.sum("__cost").alias("__cost"))
        chosen = (join_on(state, costs, run, "inner").groupBy(*keys)
                  .agg(F.min(F.struct("__cost", "__r", "__c")).alias("__b")))
        best = best.unionByName(chosen.select(*keys, F.col("__b.__cost").alias("cost"), F.col("__b.__c").alias("__c")))
    best = stored(best)
    out = (attach(pixels_wide.withColumn("__x", vector), best.drop("cost"), keys)
           .withColumn("__c", F.when(F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v)), F.col("__c")))
           .select(*pixels_wide.columns, _nearest("__x", "__c")["i"].cast("int").alias("segment")))
    return out, best.select(*keys, "cost")
