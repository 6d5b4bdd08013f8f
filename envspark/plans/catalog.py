"""Registry of the named queries (one or more per operator of the survey).

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the domain views of
the parquet tables in ``sf_dir``; most carry an equivalent DuckDB SQL string
used as the correctness oracle.  Double columns listed in ``rnd`` are
rounded to 6 decimals on both sides so the comparison does not depend on the
summation order of two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def _round_df(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.round(F.col(c), DIGITS).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _round_sql(sql: str, cols) -> str:
    if not cols:
        return sql
    rep = ", ".join(f"ROUND({c}, {DIGITS}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS __q"


def register(name: str, sql: str | None = None, views=(), rnd=()):
    """Decorator: register ``fn`` under ``name`` with its oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return _round_df(df, rnd) if rnd else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = _round_sql(with_views(sql.strip(), *views), rnd)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from envspark.plans import (  # noqa: F401
        q_series, q_relational, q_features, q_ingest, q_raster, q_streaming, q_numeric)
