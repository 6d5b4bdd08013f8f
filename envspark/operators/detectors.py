"""Multivariate anomaly models and signal events.

Isolation forest (published algorithm of Liu, Ting and Zhou):
  every tree is grown on the psi rows with the smallest hash of (row, tree,
  seed) - a bottom-k sample, which merges over partitions and does not depend
  on them; some trees at a time are grown in ``applyInPandas``.  One forest for
  the whole table is a few thousand numbers, shipped to every task; with
  ``keys`` there is a forest per key, brought to shares of its rows by a
  cogroup.  *All* rows are scored with vectorised NumPy traversal.

One-class SVM: random Fourier features of the RBF kernel and the
nu-one-class objective trained by full-batch subgradient steps; each step is
one distributed pass (per-partition partial sums in ``mapInPandas`` + sum);
the offset rho is the nu-quantile of the training scores.

CWT peaks and PELT change points run per (series, frame) group in
``applyInPandas`` with NumPy; ``frame`` bounds every group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.operators.common import attach
from envspark.operators.quantiles import exact_quantiles
from envspark.session import cut_lineage, ship_package, stored

EULER = 0.5772156649015329


def avg_path_length(n):
    """c(n): average path length of an unsuccessful search in a BST of n."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    out = np.where(big, 2.0 * (np.log(np.where(big, n - 1, 1)) + EULER) - 2.0 * (n - 1) / np.where(big, n, 1), out)
    return out


def _grow_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Arrays (feature, threshold, left, right, size, depth) of one tree."""
    feat, thr, left, right, size, depth = [], [], [], [], [], []
    columns = X.T.tolist()

    def node(idx, d):
        me = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx)), depth.append(d)
        if d >= max_depth or len(idx) <= 1:
            return me
        cand = []
        for q, column in enumerate(columns):
            values = [column[i] for i in idx]
            lo, hi = min(values), max(values)
            if hi > lo:
                cand.append((q, lo, hi, values))
        if not cand:
            return me
        # the numbers that choice and uniform draw, without their checks
        q, lo, hi, values = cand[rng.integers(0, len(cand))]
        if math.isinf(hi - lo):
            raise OverflowError("high - low range exceeds valid bounds")
        p = lo + (hi - lo) * rng.random()
        feat[me], thr[me] = q, p
        li = node([i for i, v in zip(idx, values) if v < p], d + 1)
        ri = node([i for i, v in zip(idx, values) if not v < p], d + 1)
        left[me], right[me] = li, ri
        return me

    node(range(len(X)), 0)
    return feat, thr, left, right, size, depth


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    feat, thr, left, right, size, depth = (np.asarray(a) for a in tree)
    cur = np.zeros(len(X), dtype=np.int64)
    active = feat[cur] >= 0
    while active.any():
        f = feat[cur[active]]
        go_left = X[np.nonzero(active)[0], f] < thr[cur[active]]
        cur[active] = np.where(go_left, left[cur[active]], right[cur[active]])
        active = feat[cur] >= 0
    return depth[cur] + avg_path_length(size[cur])


TREE = ("tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<int>, "
        "depth array<int>")
TREES_PER_TASK = 25
ROWS_PER_SHARE = 100_000


def fit_isolation_forest(df: DataFrame, cols: Sequence[str], n_trees: int = 100, psi: int = 256,
                         seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (key and) tree.  A tree's rows are those without a null or
    NaN feature of smallest hash over all their columns, so the forest is the
    same however the rows are partitioned.  Only rows whose hash is small
    enough to be among them (three times psi expected) are told apart."""
    ship_package(df.sparkSession)
    cols, keys = list(cols), list(keys)
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]
    data = df.where(functools.reduce(lambda x, y: x & y, whole)).withColumn("__row", F.xxhash64(*df.columns))
    counts = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    span = float(1 << 53)
    place = lambda t: F.pmod(F.xxhash64("__row", t, F.lit(seed)), F.lit(1 << 53)) / span
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: place(t) < 3.0 * psi / F.col("__n"))
    member = (attach(data.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)], "__row"),
                     counts, keys, "inner")
              .withColumn("tree", F.explode(trees)).withColumn("__h", place(F.col("tree"))))
    xs = [f"__x{i}" for i in range(len(cols))]
    w = Window.partitionBy(*keys, "tree").orderBy("__h", *xs)
    picked = (member.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= psi)
              .withColumn("__task", F.floor(F.col("tree") / TREES_PER_TASK)))
    kinds = dict(df.dtypes)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, rows in pdf.sort_values(["tree", "__rn"]).groupby("tree"):
            X = rows[xs].to_numpy(dtype=float)
            max_depth = int(math.ceil(math.log2(max(len(X), 2))))
            out.append((int(t), *_grow_tree(X, np.random.default_rng(seed + int(t)), max_depth)))
        out = pd.DataFrame(out, columns=["tree", "feature", "threshold", "left", "right", "size", "depth"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "tree", "feature", "threshold", "left", "right", "size", "depth"]]

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + TREE
    return picked.select(*keys, "tree", "__rn", *xs, "__task").groupBy(*keys, "__task").applyInPandas(grow, schema)


def _forest_scores(X: np.ndarray, trees: list) -> np.ndarray:
    """2^(-E[h] / c(psi)) of every row; NaN for rows with a missing feature."""
    ok = ~np.isnan(X).any(axis=1)
    out = np.full(len(X), np.nan)
    if ok.any() and trees:
        cpsi = float(avg_path_length(trees[0][4][0]))      # the root holds the sample
        h = np.mean([_path_lengths(X[ok], t) for t in trees], axis=0)
        out[ok] = np.power(2.0, -h / cpsi) if cpsi > 0 else 1.0
    return out


def _scores_by_share(df: DataFrame, keys: list, sizes: DataFrame, scored_rows, schema, forest: DataFrame,
                     parts: Sequence[str]) -> DataFrame:
    """Rows of large keys scored in shares, each with the trees of its key."""
    shares = sizes.select(*keys, F.ceil(F.col("__size") / ROWS_PER_SHARE).cast("int").alias("__shares"))
    rows = (attach(df, shares, keys, "inner")
            .withColumn("__share", F.pmod(F.xxhash64(*df.columns), F.col("__shares")).cast("int")).drop("__shares"))
    spread = (attach(forest, shares, keys, "inner")
              .withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares"))
    names = [f.name for f in schema.fields]

    def work(pdf: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=names)
        grown = grown.sort_values("tree")
        return scored_rows(pdf, list(zip(*[grown[p] for p in parts])))
    return rows.groupBy(*keys, "__share").cogroup(spread.groupBy(*keys, "__share")).applyInPandas(work, schema)


def isolation_forest(df: DataFrame, cols: Sequence[str], contamination="auto", n_trees: int = 100,
                     psi: int = 256, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``score`` (2^(-E[h]/c(psi)), higher = more anomalous) and
    ``anomaly``: score > 0.5 for ``'auto'``, else the top ``contamination``
    share of scores (threshold = exact (1 - c) quantile of all scores).  Rows with a
    null feature get null score and no flag.  With ``keys``, forest and
    threshold are those of the row's key alone."""
    ship_package(df.sparkSession)
    cols, keys = list(cols), list(keys)
    parts = ("feature", "threshold", "left", "right", "size", "depth")
    schema = T.StructType(df.schema.fields + [T.StructField("score", T.DoubleType())])

    def scored_rows(pdf: pd.DataFrame, trees: list) -> pd.DataFrame:
        pdf = pdf[df_columns].copy()
        pdf["score"] = _forest_scores(pdf[cols].to_numpy(dtype=float, na_value=np.nan), trees)
        return pdf
    df_columns = df.columns
    if not keys:
        forest = cut_lineage(fit_isolation_forest(df, cols, n_trees, psi, seed))
        trees = [tuple(r[p] for p in parts) for r in forest.orderBy("tree").collect()]      # n_trees small trees

        def scorer(it):
            for pdf in it:
                yield scored_rows(pdf, trees)
        scored = df.mapInPandas(scorer, schema)
    else:
        # a key of up to psi rows is the sample of each of its trees: they are grown and used where its rows are
        sizes = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")))

        def grown_here(pdf: pd.DataFrame) -> pd.DataFrame:
            X = pdf[cols].to_numpy(dtype=float, na_value=np.nan)
            X = X[~np.isnan(X).any(axis=1)]
            max_depth = int(math.ceil(math.log2(max(len(X), 2))))
            trees = [_grow_tree(X, np.random.default_rng(seed + t), max_depth) for t in range(n_trees)] if len(X) else []
            return scored_rows(pdf, trees)
        small, large = F.col("__size") <= psi, F.col("__size") > psi
        scored = (attach(df, sizes.where(small), keys, "inner").drop("__size")
                  .groupBy(*keys).applyInPandas(grown_here, schema))
        if not sizes.where(large).isEmpty():
            rest = attach(df, sizes.where(large), keys, "inner").drop("__size")
            scored = scored.unionByName(_scores_by_share(rest, keys, sizes.where(large), scored_rows, schema, cut_lineage(
                fit_isolation_forest(rest, cols, n_trees, psi, seed, keys)), parts))
    if contamination == "auto":
        return scored.withColumn("anomaly", F.coalesce(F.col("score") > 0.5, F.lit(False)))
    c = float(contamination)
    # exact (1 - c) quantile of the scores by rank selection, of scores that are written once
    scored = cut_lineage(scored.withColumn("score", F.when(~F.isnan("score"), F.col("score"))))
    q = exact_quantiles(scored, "score", [1.0 - c], keys, prefix="__score")
    flagged = attach(scored, q, keys).select(*scored.columns, (F.col("score") > F.col("__score_q0")).alias("anomaly"))
    return flagged.withColumn("anomaly", F.coalesce("anomaly", F.lit(False)))


# ---------------------------------------------------------------- one-class SVM

PI_HIGH = math.ldexp(math.floor(math.ldexp(math.pi, 24)), -24)      # few digits: small multiples are exact
PI_LOW = (math.pi - PI_HIGH) + 1.2246467991473532e-16
COSINE = [(-1) ** i / math.factorial(2 * i) for i in range(11, -1, -1)]


def _cosine(x: np.ndarray) -> np.ndarray:
    """Cosine, to the last digits of a double, by the series around the next
    multiple of pi: operations that numpy vectorises, unlike its own cosine of
    doubles on most machines."""
    n = x * (1 / math.pi)
    np.rint(n, out=n)
    out = n * PI_HIGH
    r = x - out
    np.multiply(n, PI_LOW, out=out)
    r -= out
    r *= r
    np.multiply(r, COSINE[0], out=out)
    for c in COSINE[1:-1]:
        out += c
        out *= r
    out += COSINE[-1]
    n *= 0.5        # odd multiples turn the sign
    n -= np.floor(n, out=r)
    n *= -4
    n += 1
    out *= n
    return out


def one_class_svm(df: DataFrame, cols: Sequence[str], nu: float = 0.05, gamma="scale", n_features: int = 256,
                  iterations: int = 60, seed: int = 42) -> DataFrame:
    """Standardise (population std), RBF kernel approximated by random
    Fourier features, nu-one-class objective
    ``min 1/2 |w|^2 + 1/(nu n) sum max(0, rho - w.z(x)) - rho``
    by full-batch subgradient steps (one distributed pass each, on the
    persisted features); the final rho is the nu-quantile of w.z(x).
    Adds ``score`` = w.z(x) - rho and ``anomaly`` = score < 0."""
    ship_package(df.sparkSession)
    cols = list(cols)
    d = len(cols)
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    mu = np.array([st[f"m_{c}"] for c in cols], dtype=float)
    sd = np.array([st[f"s_{c}"] or 1.0 for c in cols], dtype=float)
    sd[sd == 0] = 1.0
    g = 1.0 / d if gamma == "scale" else float(gamma)   # standardised data: X.var() == 1
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * g), size=(d, n_features))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)

    def feats(pdf, rows=128):
        """Standardised columns and features, as many rows at a time as a core's cache holds."""
        X = (pdf[cols].to_numpy(dtype=float, na_value=np.nan) - mu) / sd
        for at in range(0, len(X), rows):
            Z = X[at:at + rows] @ W
            Z += b
            Z = _cosine(Z)
            Z *= scale
            yield X[at:at + rows], Z

    base = df.select(*cols).na.drop(subset=cols).persist()
    n = base.count()
    w = np.zeros(n_features)
    rho = 0.0
    part_schema = T.StructType([T.StructField("s", T.ArrayType(T.DoubleType()))])
    for it in range(1, iterations + 1):
        wv, rv = w.copy(), rho

        def partial(batches, wv=wv, rv=rv):
            acc = np.zeros(n_features + 1)           # feature sums + violator count
            for pdf in batches:
                for _, Z in feats(pdf):
                    viol = Z @ wv < rv
                    acc[:-1] += viol.astype(float) @ Z
                    acc[-1] += float(viol.sum())
            yield pd.DataFrame({"s": [acc.tolist()]})

        summed = (base.mapInPandas(partial, part_schema).select(F.posexplode("s").alias("i", "v"))
                  .groupBy("i").agg(F.sum("v").alias("v")))
        vec = np.zeros(n_features + 1)
        for r in summed.collect():                    # n_features + 1 numbers
            vec[int(r["i"])] = r["v"]
        sums, tot = vec[:-1], vec[-1]
        lr = 1.0 / math.sqrt(it)
        grad_w = w - sums / (nu * n)
        grad_rho = tot / (nu * n) - 1.0
        w = w - lr * grad_w
        rho = rho - lr * grad_rho
    base.unpersist()
    wf = w.copy()
    schema = T.StructType(df.schema.fields + [T.StructField("raw", T.DoubleType())])

    def scorer(it):
        for pdf in it:
            pdf = pdf.copy()
            pdf["raw"] = np.concatenate([np.where(np.isnan(X).any(axis=1), np.nan, Z @ wf) for X, Z in feats(pdf)] or [np.empty(0)])
            yield pdf

    # the scores are written once; the quantile reads them several times
    scored = stored(df.mapInPandas(scorer, schema))
    rho_q = exact_quantiles(scored, "raw", [nu]).first()["raw_q0"]
    return (scored.withColumn("score", F.col("raw") - F.lit(rho_q)).drop("raw")
            .withColumn("anomaly", F.coalesce(F.col("score") < 0, F.lit(False))))


# ---------------------------------------------------------------- events per series

def ricker(points: int, a: float) -> np.ndarray:
    """Mexican-hat wavelet sampled on ``points`` points with width ``a``."""
    A = 2 / (np.sqrt(3 * a) * np.pi ** 0.25)
    v = np.arange(points) - (points - 1.0) / 2
    return A * (1 - v ** 2 / a ** 2) * np.exp(-v ** 2 / (2 * a ** 2))


def cwt_peaks(x: np.ndarray, widths=np.arange(1, 31), min_snr: float = 1.0, noise_perc: float = 10.0):
    """Peak positions by ridge lines of a Ricker continuous wavelet transform
    (Du, Kibbe & Lin 2006): local maxima are linked from the coarsest scale
    down (max distance width/4, gap ceil(width_0)), ridges shorter than a
    quarter of the scales or with SNR below ``min_snr`` (noise = 10th
    percentile of |finest scale| in a window of n/20) are dropped."""
    widths = np.asarray(widths, dtype=float)
    n = len(x)
    if n < 3:
        return np.array([], dtype=int)
    cw = np.empty((len(widths), n))
    for i, w in enumerate(widths):
        k = ricker(int(min(10 * w, n)), w)
        cw[i] = np.convolve(x, k, mode="same")
    left = np.concatenate([cw[:, :1], cw[:, :-1]], axis=1)
    right = np.concatenate([cw[:, 1:], cw[:, -1:]], axis=1)
    is_max = (cw > left) & (cw > right)
    rows_with = np.nonzero(is_max.any(axis=1))[0]
    if len(rows_with) == 0:
        return np.array([], dtype=int)
    max_dist = widths / 4.0
    gap = np.ceil(widths[0])
    start = rows_with[-1]
    lines = [[[start], [c], 0] for c in np.nonzero(is_max[start])[0]]
    done = []
    for row in range(start - 1, -1, -1):
        cols = np.nonzero(is_max[row])[0]
        for ln in lines:
            ln[2] += 1
        prev = np.array([ln[1][-1] for ln in lines])
        for c in cols:
            target = None
            if len(prev):
                dif = np.abs(c - prev)
                j = int(np.argmin(dif))
                if dif[j] <= max_dist[row]:
                    target = lines[j]
            if target is not None:
                target[1].append(c)
                target[0].append(row)
                target[2] = 0
            else:
                lines.append([[row], [c], 0])
        for j in range(len(lines) - 1, -1, -1):
            if lines[j][2] > gap:
                done.append(lines.pop(j))
    min_len = np.ceil(len(widths) / 4)
    win = int(np.ceil(n / 20))
    half, odd = divmod(win, 2)
    row0 = cw[0]
    noise = np.array([np.percentile(row0[max(i - half, 0):min(i + half + odd, n)], noise_perc) for i in range(n)])
    peaks = []
    for ln in done + lines:
        order = np.argsort(ln[0])
        rows = np.asarray(ln[0])[order]
        cols = np.asarray(ln[1])[order]
        if len(rows) < min_len:
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            snr = abs(cw[rows[0], cols[0]] / noise[cols[0]])
        if snr < min_snr:
            continue
        peaks.append(int(cols[0]))
    return np.array(sorted(peaks), dtype=int)


def pelt_l2(x: np.ndarray, pen: float = 10.0, min_size: int = 2, jump: int = 5) -> list[int]:
    """Change points by PELT (Killick, Fearnhead & Eckley 2012) with the L2
    segment cost (sum of squared deviations), candidate positions on
    multiples of ``jump``, segments at least ``min_size`` long.  Returns the
    segment ends without the final one."""
    n = len(x)
    if n == 0:
        return []
    c1 = np.concatenate([[0.0], np.cumsum(x)])
    c2 = np.concatenate([[0.0], np.cumsum(x * x)])

    def cost(s, e):
        m = e - s
        return c2[e] - c2[s] - (c1[e] - c1[s]) ** 2 / m

    best = {0: (0.0, [])}
    admissible: list[int] = []
    ends = [k for k in range(0, n, jump) if k >= min_size] + [n]
    for e in ends:
        cand = (e - min_size) // jump * jump
        admissible.append(cand)
        scored = []
        for t in admissible:
            if t not in best or e - t < min_size:
                continue
            v, bk = best[t]
            scored.append((v + cost(t, e) + pen, t, bk))
        if not scored:
            continue
        v, t, bk = min(scored, key=lambda z: z[0])
        best[e] = (v, bk + [e])
        admissible = [s for (val, s, _) in scored if val <= v + pen]
    return best[n][1][:-1] if n in best else []


EVENT_SCHEMA_FIELDS = [("column", T.StringType()), ("value", T.DoubleType()), ("method", T.StringType())]


def _series_events(df: DataFrame, cols, keys, time_col, frame, method, **kw) -> DataFrame:
    """Events of each series per bounded (series, frame) group.  For the CWT
    every frame also receives ``halo`` rows of its neighbours on both sides
    (10 x the largest wavelet width), so the wavelet coefficients of the
    frame's own rows equal those of the whole series; only peaks on the
    frame's own rows are reported."""
    ship_package(df.sparkSession)
    keys = list(keys)
    cols = list(cols)
    # series statistics for standardisation (exact, partial aggregate)
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols],
                                  *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    halo = int(10 * max(kw.get("widths", [1]))) if method == "cwt" else int(kw.get("halo", 100))
    from envspark.operators.windows import halo_frames, row_blocks
    base = df.select(*keys, time_col, *(["id"] if "id" in df.columns else []), *cols)
    if isinstance(frame, int):        # blocks of ``frame`` rows: bounded by rows, not by duration
        framed = row_blocks(base, keys, time_col, frame, min(halo, frame), after=min(halo, frame)) \
            .withColumnRenamed("__blk", "__chunk")
    else:                             # calendar frames
        framed = halo_frames(base, keys, time_col, frame, halo, halo)
    slim = framed.join(stats, keys, "left").select(
        *keys, "__chunk", "__idx", "__halo", time_col, *cols,
        *[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])
    ftypes = {f.name: f.dataType for f in slim.schema.fields}
    schema = T.StructType([T.StructField(k, ftypes[k]) for k in keys]
                          + [T.StructField(time_col, ftypes[time_col])]
                          + [T.StructField(n, t) for n, t in EVENT_SCHEMA_FIELDS])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__idx", kind="mergesort").reset_index(drop=True)
        core = ~pdf["__halo"].to_numpy(dtype=bool)
        out = []
        for c in cols:
            s = pdf[c].astype(float).ffill().bfill().to_numpy()
            if len(s) == 0 or np.isnan(s).all():
                continue
            if method == "cwt":
                sd = pdf[f"__s_{c}"].iloc[0]
                z = (s - pdf[f"__m_{c}"].iloc[0]) / (sd if sd and sd > 0 else np.nan)
                if np.isnan(z).any():
                    continue
                idx = cwt_peaks(z, kw.get("widths", np.arange(1, 31)), kw.get("min_snr", 1.0))
            else:
                idx = np.asarray(pelt_l2(s, kw.get("pen", 10.0), kw.get("min_size", 2), kw.get("jump", 5)), int)
            for i in idx:
                if not core[i]:
                    continue
                row = {k: pdf[k].iloc[0] for k in keys}
                row.update({time_col: pdf[time_col].iloc[i], "column": c, "value": float(pdf[c].iloc[i]),
                            "method": method})
                out.append(row)
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return slim.groupBy(*keys, "__chunk").applyInPandas(run, schema)


def cwt_events(df: DataFrame, cols, keys=("source_id",), time_col="ts", frame: str | int = "month",
               widths=np.arange(1, 31), min_snr: float = 1.0) -> DataFrame:
    """Peaks of each series (nulls filled forward then backward,
    standardised with the series mean and std) per bounded frame, each frame
    extended by a halo of 10 x max(widths) rows on both sides.  ``frame`` is
    a calendar unit or a number of rows (blocks bounded by size, for very
    high-rate sensors)."""
    return _series_events(df, cols, keys, time_col, frame, "cwt", widths=widths, min_snr=min_snr)


def change_points(df: DataFrame, cols, keys=("source_id",), time_col="ts", frame: str | int = "month",
                  pen: float = 10.0, min_size: int = 2, jump: int = 5, halo: int = 100) -> DataFrame:
    """PELT change points (L2 cost) of each series per bounded frame;
    each frame is segmented together with ``halo`` neighbouring rows on both
    sides and reports the change points on its own rows (the series end is
    not a change point)."""
    return _series_events(df, cols, keys, time_col, frame, "change_point", pen=pen, min_size=min_size, jump=jump,
                          halo=halo)


def detect_multivariate(df: DataFrame, method: str, cols, **kw) -> DataFrame:
    if method == "isolation_forest":
        return isolation_forest(df, cols, **kw)
    if method == "one_class_svm":
        return one_class_svm(df, cols, **kw)
    raise ValueError(f"no multivariate anomaly method called {method!r}")
