"""Queries: point queries, batch scoring, multivariate anomaly models,
signal events and pixel models (F12, D1, D2, N13, N14, N16, N17, R12-R16)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from envspark.operators import detectors, listing, models, raster, raster_models
from envspark.plans.catalog import register
from envspark.plans.q_ingest import _S5
from envspark.sources import ingest
from envspark.sources.views import _read, view

BANDS = ["B02", "B03", "B04", "B08"]


def _points(spark, sf):
    ok, _ = ingest.decode_messages(view(spark, sf, "messages"))
    return ingest.messages_to_points(ok)


@register("f12_query_points",
          "SELECT id, sensor_id, field, value, time FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, field "
          f"ORDER BY time, value) AS rn FROM ({_S5}) WHERE measurement = 'click' AND time >= TIMESTAMP '2024-01-05' "
          "AND time < TIMESTAMP '2024-01-20') WHERE rn <= 3", ["messages"])
def f12(spark, sf):
    q = listing.query_points(_points(spark, sf), "click", "2024-01-05", "2024-01-20", limit=3)
    return q.select("id", F.col("tags")["sensor_id"].alias("sensor_id"), "field", "value", "time")


@register("f12_query_points_tag",
          f"SELECT id, field, value, time FROM ({_S5}) WHERE measurement = 'view' AND sensor_id = '7' "
          "AND time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-01'", ["messages"])
def f12t(spark, sf):
    q = listing.query_points(_points(spark, sf), "view", "2024-01-01", "2024-02-01", {"sensor_id": 7}, 1000)
    return q.select("id", "field", "value", "time")


# The user-supplied model of the scoring queries (a linear
# price model: weights for quantity and discount, intercept).
W_PRICE = (900.0, -5000.0)
B_PRICE = 100.0


def _price_model():
    w = np.array(W_PRICE)

    def predict(x: np.ndarray) -> np.ndarray:
        return x @ w + B_PRICE
    return predict


@register("d1_score",
          f"SELECT l_orderkey, l_linenumber, l_quantity * {W_PRICE[0]} + l_discount * {W_PRICE[1]} + {B_PRICE} "
          "AS prediction FROM lineitem", [], rnd=["prediction"])
def d1(spark, sf):
    li = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return models.score(li, _price_model, ["l_quantity", "l_discount"]).select(
        "l_orderkey", "l_linenumber", "prediction")


@register("d2_evaluate",
          "SELECT l_returnflag, avg(power(l_quantity * 900.0 + l_discount * -5000.0 + 100.0 - l_extendedprice, 2)) "
          "AS mean_loss, CAST(count(*) AS BIGINT) AS samples FROM lineitem GROUP BY 1", [],
          rnd=["mean_loss"])
def d2(spark, sf):
    li = _read(spark, sf, "lineitem")
    return models.evaluate(li, _price_model, ["l_quantity", "l_discount"], "l_extendedprice", keys=["l_returnflag"])


def _readings(spark, sf):
    return view(spark, sf, "readings").select("id", "source_id", "ts", "temperature", "humidity")


@register("n13_isolation_forest")
def n13(spark, sf):
    return detectors.isolation_forest(_readings(spark, sf), ["temperature", "humidity"], "auto")


@register("n13_isolation_forest_contamination")
def n13c(spark, sf):
    return detectors.isolation_forest(_readings(spark, sf), ["temperature", "humidity"], 0.05)


@register("n14_one_class_svm")
def n14(spark, sf):
    return detectors.one_class_svm(_readings(spark, sf), ["temperature", "humidity"], nu=0.05, iterations=30)


@register("n16_cwt_events")
def n16(spark, sf):
    return detectors.cwt_events(_readings(spark, sf), ["humidity"], frame="month")


@register("n17_change_points")
def n17(spark, sf):
    return detectors.change_points(_readings(spark, sf), ["humidity"], frame="month", pen=10.0)


def _wide(spark, sf):
    return raster.pixel_bands(view(spark, sf, "pixels"), BANDS, fallback=False)


def _wide_norm(spark, sf):
    """Wide pixels with bands min-max scaled to [0, 1] per image."""
    p = raster.band_minmax(view(spark, sf, "pixels"))
    return raster.pixel_bands(p, BANDS, fallback=False)


@register("r12_pixel_anomaly_iforest")
def r12(spark, sf):
    return raster_models.pixel_anomaly(_wide(spark, sf), BANDS, "isolation_forest")


@register("r12_pixel_anomaly_svm")
def r12s(spark, sf):
    return raster_models.pixel_anomaly(_wide_norm(spark, sf), BANDS, "one_class_svm", iterations=20)


@register("r13_reconstruction_score")
def r13(spark, sf):
    return models.reconstruction_score(_wide(spark, sf), BANDS, 2)


@register("r14_segment_kmeans")
def r14(spark, sf):
    out, _ = models.segment_kmeans(_wide_norm(spark, sf), BANDS, 5, 42)
    return out


@register("r15_segment_meanshift")
def r15(spark, sf):
    return raster_models.segment_meanshift(_wide_norm(spark, sf), BANDS, 0.5)


@register("r16_segment_slic")
def r16(spark, sf):
    return raster_models.segment_slic(_wide_norm(spark, sf), ["B04", "B03", "B02"], 5, 10.0, 5)
