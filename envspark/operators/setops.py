"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def concat_tables(dfs: list[DataFrame]) -> DataFrame:
    """Rows of many tables, columns matched by name, missing -> null."""
    if not dfs:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_values(df: DataFrame, cols) -> DataFrame:
    """Distinct values (hash aggregate with map-side de-duplication)."""
    return df.select(*cols).distinct()
