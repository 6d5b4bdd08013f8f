"""Quality classifier by Bradley-Terry pairwise ranking.

Documents have a feature vector of text statistics.  Each preference pair - a
good and a bad labelled document - says that the good one wins; the
probability of winning is the logistic function of the weighted feature
difference, and the weights are those of least logistic loss over all pairs of
all labelled documents (with a small ridge).  Documents are ranked by the
weighted sum; the decision threshold is the quantile of the training scores at
the share of bad labels, and scores are shown as the logistic of the distance
to it.

The features are DataFrame functions, scored in one pass without a shuffle.
Those of the labelled rows are written once.  A Newton step is one aggregate
over them: rows of a label whose scores share a step of ``BIN`` are summed up
(count, features, products of features), so the pairs are those of sums at
their mean scores; only sums, at most ``BINS`` steps, pass the driver.

Null and empty texts have all-zero features and get a score like any other.
Labels with a null value or id are not learned from; without both classes all
scores are 0.5.  Repeated rows are scored independently.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import blank
from envspark.operators.quantiles import exact_quantiles
from envspark.session import stored

BIN = 1 / 64            # scores closer than this meet the other label as one, at their mean
BINS = 1 << 14          # steps, at most (wider ones where scores spread further)


def counts(t: Column) -> Column:
    """What the features are made of, as one struct: each is counted once."""
    count = lambda rx: F.regexp_count(t, F.lit(rx)).cast("double")
    return F.struct(
        F.length(t).cast("double").alias("n"), count(r"\S+").alias("words"), count(r"\p{L}").alias("letters"),
        F.size(F.array_distinct(F.split(F.lower(t), r"\s+"))).cast("double").alias("distinct"),
        count(r"[*$&%#|!?{}<>=~^@/\\_+]").alias("symbols"), count(r"\p{Lu}").alias("upper"),
        count(r"[0-9]").alias("digits"), count(r"[.,;:]").alias("stops"),
        count(r"(?<!\S)(\S+)(?=\s+\1(?!\S))").alias("echo"), count(r"\n").alias("lines"))


def features(c: Column) -> dict[str, Column]:
    """Text statistics, all finite, of a struct of counts."""
    one = F.lit(1.0)
    n, w, letters = F.greatest(c["n"], one), F.greatest(c["words"], one), F.greatest(c["letters"], one)
    worded = lambda x: F.when(c["words"] == 0, 0.0).otherwise(x)
    return {
        "symbols": c["symbols"] / n,
        "upper": c["upper"] / letters,
        "digits": c["digits"] / n,
        "stops": c["stops"] / w,
        "echo": c["echo"] / w,
        "letters": c["letters"] / n,
        "word_length": (c["n"] - c["words"]) / w,
        "words": F.ln(1 + c["words"]),
        "variety": worded(c["distinct"] / w),
        "spread": worded(c["distinct"] / F.sqrt(w)),
        "lines": c["lines"] / w,
    }


NAMES = tuple(("symbols", "upper", "digits", "stops", "echo", "letters", "word_length", "words", "variety", "spread", "lines"))


@dataclass(frozen=True)
class Ranker:
    """score = logistic((weights . (features - centre) / scale - threshold) / width)"""
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def score(self, text: Column) -> Column:
        """The score of a text column.  The counts are bound to a lambda
        variable, so that a filter on the score makes them once as well."""
        return F.transform(F.array(counts(text)), lambda c: self._logistic(features(c)))[0]

    def _logistic(self, f: dict[str, Column]) -> Column:
        raw = F.lit(float(-self.threshold))
        for name, c, s, w in zip(NAMES, self.centre, self.scale, self.weights):
            if w:
                raw = raw + F.lit(float(w / s)) * (f[name].cast("double") - F.lit(float(c)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), raw / F.lit(float(self.width))))))


def _newton_terms(good: np.ndarray, bad: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature at ``w`` of the mean logistic loss over all
    pairs; rows are sums (count, features, products of features) of documents
    of about one score."""
    n_good, n_bad = good[:, 0], bad[:, 0]
    z_good, z_bad = good[:, 1:k + 1], bad[:, 1:k + 1]
    at_good, at_bad = z_good @ w / n_good, z_bad @ w / n_bad
    lost, lost_bad = np.zeros(len(good)), np.zeros(len(bad))
    bend, bend_bad = np.zeros(len(good)), np.zeros(len(bad))
    cross = np.zeros((k, k))
    for i in range(0, len(good), 512):
        here = slice(i, i + 512)
        loss = 1 / (1 + np.exp(np.clip(at_good[here, None] - at_bad, -30, 30)))
        curve = loss * (1 - loss)
        lost[here], bend[here] = loss @ n_bad, curve @ n_bad
        lost_bad += n_good[here] @ loss
        bend_bad += n_good[here] @ curve
        cross += z_good[here].T @ (curve @ z_bad)
    pairs = n_good.sum() * n_bad.sum()
    upper = bend @ good[:, k + 1:] + bend_bad @ bad[:, k + 1:]
    square = np.zeros((k, k))
    square[np.triu_indices(k)] = upper
    square = square + np.triu(square, 1).T
    return (lost_bad @ z_bad - lost @ z_good) / pairs, (square - cross - cross.T) / pairs


def fit_pairs(rows: DataFrame, ridge: float = 1e-3) -> Ranker:
    """Weights of least logistic loss over all pairs of rows (``__y`` and the
    columns NAMES) by Newton steps."""
    k = len(NAMES)
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("good"),
                  *[f(c).alias(f"{p}_{c}") for c in NAMES for p, f in (("m", F.avg), ("s", F.stddev_pop), ("l", F.min), ("h", F.max))]
                  ).first()
    n, good = st["n"], st["good"] or 0
    if not good or good == n:
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    centre = np.array([st[f"m_{c}"] for c in NAMES])
    scale = np.array([st[f"s_{c}"] for c in NAMES])
    scale = np.where(scale > 1e-12, scale, 1.0)
    spread = np.array([st[f"h_{c}"] - st[f"l_{c}"] for c in NAMES]) / scale
    # a partial sum is as large whatever its task reads: as many as cores
    few = rows.coalesce(max(12, rows.sparkSession.sparkContext.defaultParallelism))
    z = few.select("__y", F.array(*[(F.col(c) - F.lit(float(m))) / F.lit(float(d))
                                     for c, m, d in zip(NAMES, centre, scale)]).alias("z"))

    def scored(w: np.ndarray) -> Column:
        return sum((F.col("z")[i] * F.lit(float(w[i])) for i in range(k)), F.lit(0.0))
    terms = [F.count(F.lit(1))] + [F.sum(F.col("z")[i]) for i in range(k)] + [
        F.sum(F.col("z")[i] * F.col("z")[j]) for i, j in zip(*np.triu_indices(k))]
    w = np.zeros(k)
    for _ in range(50):
        step = max(BIN, float(np.abs(w) @ spread) / BINS)
        sums = (z.groupBy("__y", F.floor(scored(w) / F.lit(step)).alias("bin"))
                .agg(F.array(*[t.cast("double") for t in terms]).alias("t")).orderBy("__y", "bin").collect())
        bad, won = (np.array([r["t"] for r in sums if r["__y"] == y]) for y in (0, 1))
        grad, hess = _newton_terms(won, bad, w, k)
        grad = grad + ridge * w
        move = np.linalg.solve(hess + ridge * np.eye(k), grad)
        gain = float(grad @ move)          # twice what the step takes off the loss, about
        move *= min(1.0, 5.0 / max(1e-12, float(np.abs(move).max())))
        w = w - move
        if gain < 1e-8:
            break
    s = z.select(scored(w).alias("s"))
    # as many training scores below the threshold as there are bad labels: between two ranks
    threshold = exact_quantiles(s, "s", [(n - good - 0.5) / (n - 1)]).first()["s_q0"]
    width = s.agg(F.stddev_pop("s")).first()[0]
    return Ranker(centre, scale, w, float(threshold), float(max(width / 4, 1e-9)))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Ranker:
    """Learn from all labelled rows outside the held-out third."""
    picked = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y"))
              .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id"))))
    t = docs.select(F.col(id_col).cast("long").alias("__id"), blank(text_col).alias("__t"))
    # features, not texts, are moved to the labels
    rows = (t.where(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
            .select("__id", F.transform(F.array(counts(F.col("__t"))), lambda c: F.struct(
                *[x.cast("double").alias(k) for k, x in features(c).items()]))[0].alias("__f"))
            .join(picked, "__id").select("__y", "__f.*"))
    return fit_pairs(stored(rows))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality") -> DataFrame:
    """id, held_out, score and predicted for every document."""
    ranker = fit(docs, labels, id_col, text_col, label_col)
    t = docs.select(F.col(id_col), blank(text_col).alias("__t"))
    return (t.select(id_col, held_out(F.col(id_col)).alias("held_out"),
                     ranker.score(F.col("__t")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality") -> DataFrame:
    """The documents ranked above the threshold, with all their columns."""
    ranker = fit(docs, labels, id_col, text_col, label_col)
    return docs.where(ranker.score(blank(text_col)) >= 0.5)
