"""Spectral features of whole frames.

The reference takes the FFT of a complete column and repeats the result on
every row.  Here the FFT runs per (series, frame) group in ``applyInPandas``
- ``frame`` (a calendar unit such as ``'day'`` or ``'month'``) bounds every
group, so no task ever holds an unbounded series - and the one-row result
per group is joined back to its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from envspark.functions.timefn import time_bucket
from envspark.session import ship_package


def fft_summary(values: np.ndarray) -> tuple[float, float, float]:
    """(dominant frequency, its magnitude, spectral entropy in bits) of the
    full FFT.  The dominant search excludes the DC term and covers the
    positive frequencies 1..n/2 (for a real signal |X_k| = |X_{n-k}|, so the
    mirrored negative bin would only be chosen by rounding noise)."""
    x = np.nan_to_num(np.asarray(values, dtype=float), nan=0.0)
    n = len(x)
    if n < 2:
        return float("nan"), float("nan"), float("nan")
    spec = np.fft.fft(x)
    freqs = np.fft.fftfreq(n)
    mag = np.abs(spec)
    idx = int(np.argmax(mag[1:n // 2 + 1])) + 1
    psd = mag ** 2
    tot = psd.sum()
    ent = float(-np.sum((psd / tot) * np.log2(psd / tot + 1e-10))) if tot > 0 else float("nan")
    return float(abs(freqs[idx])), float(mag[idx]), ent


def fft_features(df: DataFrame, cols, keys=("source_id",), time_col="ts", frame: str | None = "month",
                 order_col: str | None = "id") -> DataFrame:
    """``<col>_dominant_freq``, ``<col>_dominant_power``,
    ``<col>_spectral_entropy`` of each (series, frame) on every row."""
    ship_package(df.sparkSession)
    keys = list(keys)
    if frame is None:
        raise ValueError("fft_features needs a bounded frame (e.g. 'day' or 'month')")
    cols = list(cols)
    tagged = df.withColumn("__frame", time_bucket(time_col, frame))
    gkeys = [*keys, "__frame"]
    order = [time_col] + ([order_col] if order_col and order_col in df.columns else [])
    slim = tagged.select(*gkeys, *order, *cols)
    out_fields = ", ".join(f"{c}_dominant_freq double, {c}_dominant_power double, {c}_spectral_entropy double"
                           for c in cols)
    key_types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join(f"`{k}` {key_types[k]}" for k in gkeys) + ", " + out_fields

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort")
        row = {k: pdf[k].iloc[0] for k in gkeys}
        for c in cols:
            f, p, e = fft_summary(pdf[c].to_numpy(dtype=float, na_value=np.nan))
            row[f"{c}_dominant_freq"], row[f"{c}_dominant_power"], row[f"{c}_spectral_entropy"] = f, p, e
        return pd.DataFrame([row])

    summ = slim.groupBy(*gkeys).applyInPandas(per_group, schema)
    return tagged.join(summ, gkeys, "left").drop("__frame")
