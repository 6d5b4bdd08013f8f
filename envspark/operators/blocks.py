"""Ordered scans over series of any size.

A window over a whole series is one task, however long the series.  Here the
rows are range-partitioned by (keys, order) first, so a series is a row of
neighbouring ranges of about equal size (``ranges``).  Windows then run inside
(keys, range), and what one range hands to the next - a row count, the last
value that is not null, the first one - is worked out on a table with one row
per (series, range) and joined back.  The ranges are written to the shared
checkpoint folder, because their borders come from a sample: all readers must
see the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.operators.common import join_on
from envspark.session import cut_lineage

RANGE = "__range"


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with the number of their range in ``__range``: along (keys,
    order), every range is one partition and holds about as many rows."""
    spread = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return cut_lineage(spread.withColumn(RANGE, F.spark_partition_id()))


def _whole(keys: Sequence[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def with_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows of ``ranges`` with their 0-based position in their series."""
    counts = df.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("__n"))
    upto = _whole(keys, F.col(RANGE)).rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(*keys, RANGE, (F.sum("__n").over(upto) - F.col("__n")).alias("__start"))
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order)
    numbered = df.withColumn("__rn", F.row_number().over(inside))
    return (join_on(numbered, starts, [*keys, RANGE], "inner")
            .withColumn(name, F.col("__start") + F.col("__rn") - 1).drop("__start", "__rn"))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], upto: Mapping[str, Column] | None = None,
               after: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of ``ranges`` with a column for each name: in ``upto`` the last
    value of the expression that is not null at or before the row, in
    ``after`` the first one strictly behind it.  Give structs where a null
    must count."""
    upto, after = dict(upto or {}), dict(after or {})
    place = F.struct(*order)
    marked = df.select("*", *[e.alias(f"__e_{n}") for n, e in {**upto, **after}.items()])
    tails = [F.max_by(f"__e_{n}", F.when(F.col(f"__e_{n}").isNotNull(), place)).alias(f"__t_{n}") for n in upto]
    heads = [F.min_by(f"__e_{n}", F.when(F.col(f"__e_{n}").isNotNull(), place)).alias(f"__t_{n}") for n in after]
    edge = marked.groupBy(*keys, RANGE).agg(*tails, *heads)
    earlier = _whole(keys, F.col(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    later = _whole(keys, F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select(*keys, RANGE,
                          *[F.last(f"__t_{n}", True).over(earlier).alias(f"__c_{n}") for n in upto],
                          *[F.last(f"__t_{n}", True).over(later).alias(f"__c_{n}") for n in after])
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = (Window.partitionBy(*keys, RANGE).orderBy(*[F.col(c).desc() for c in order])
            .rowsBetween(Window.unboundedPreceding, -1))
    found = marked.select("*", *[F.last(f"__e_{n}", True).over(inside).alias(f"__i_{n}") for n in upto],
                          *[F.last(f"__e_{n}", True).over(back).alias(f"__i_{n}") for n in after])
    j = join_on(found, carried, [*keys, RANGE], "inner")
    return j.select(*df.columns, *[F.coalesce(f"__i_{n}", f"__c_{n}").alias(n) for n in [*upto, *after]])
