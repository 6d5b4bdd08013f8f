"""Small helpers shared by operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on columns of both sides in which nulls are equal; the
    columns of ``left``, then the others of ``right``."""
    other = right.select(*[F.col(c).alias(f"__on_{c}") if c in names else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(other[f"__on_{c}"]) for c in names]
    return left.join(other, on, how).drop(*[f"__on_{c}" for c in names])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key statistics back to the rows (a null key is a key like any
    other).  With no keys the statistics are a single row; it is attached with
    an equi-join on a constant key (a broadcast hash join), never a cross join."""
    keys = list(keys)
    if keys:
        return join_on(df, stats, keys, how)
    return (df.withColumn("__one", F.lit(1))
            .join(stats.withColumn("__one", F.lit(1)), "__one", how).drop("__one"))
