"""Exact quantiles per key, many columns at once, without holding or sorting
a group in one task.

Spark's exact ``percentile`` aggregate keeps a map of every distinct value of
a group in one buffer: a sensor with a third of all readings would need that
map in one task.  Here the wanted ranks are *selected*:

1. Rows are reduced to (key, column, value, count) with partial aggregation -
   a value that makes up nearly all rows becomes one row before the shuffle.
2. The ranks floor(h), ceil(h) with h = p (n - 1) are wanted (linear
   interpolation, as ``percentile`` / numpy).  Each starts in the open interval
   of all values of its key and column.
3. Every round puts edges into every open interval (quantiles of its distinct
   values from the mergeable ``percentile_approx`` sketch; an edge is a value
   of the data) and counts three ways: between two edges, on an edge.  A rank
   that falls on an edge is found; the others go on in the interval between
   two edges, which has lost at least those values and usually all but a
   ``buckets``-th part.  1e12 distinct values take about five rounds.

Nothing is ever ordered but the counts of one interval (2 ``buckets`` + 1
rows).  When the largest group (counted first) is within ``small`` values, the
bounded ``percentile`` aggregate gives the same numbers in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.operators.common import join_on
from envspark.session import stored


def _edges_below(df: DataFrame, edges: str, x: str, n_edges: int, out: str) -> DataFrame:
    """Number of edges strictly below x (binary search, one step per select)."""
    df = df.withColumn("__blo", F.lit(0)).withColumn("__bhi", F.size(edges))
    for _ in range(int(math.ceil(math.log2(max(n_edges, 1) + 1))) + 1):
        mid = ((F.col("__blo") + F.col("__bhi")) / 2).cast("int")
        df = df.withColumn("__mid", mid).withColumn(
            "__step", F.when(F.col("__blo") >= F.col("__bhi"), F.lit(0))          # converged
            .when(F.get(F.col(edges), F.col("__mid")) < F.col(x), F.lit(1)).otherwise(F.lit(2)))
        df = df.select(*[c for c in df.columns if c not in ("__blo", "__bhi")],
                       F.when(F.col("__step") == 1, F.col("__mid") + 1).otherwise(F.col("__blo")).alias("__blo"),
                       F.when(F.col("__step") == 2, F.col("__mid")).otherwise(F.col("__bhi")).alias("__bhi"))
    return df.withColumnRenamed("__blo", out).drop("__bhi", "__mid", "__step")


def select_ranks(values: DataFrame, group: list[str], wanted: DataFrame, buckets: int = 256) -> DataFrame:
    """(group, __r, __v): the value of 0-based rank ``__r`` in its group, for
    every row of ``wanted`` (group, __r).  ``values`` has one row per group and
    distinct value ``__x`` with its count ``__n``.

    An interval is named by the number of values up to its lower border
    (``__base``): open intervals that hold a rank differ in it.
    """
    interval = [*group, "__base"]
    state = (wanted.select(*group, "__r").distinct()
             .select("*", F.lit(0).cast("long").alias("__base"), F.lit(None).cast("double").alias("__lo"),
                     F.lit(None).cast("double").alias("__hi")))
    grid = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    inside = ((F.col("__lo").isNull() | (F.col("__x") > F.col("__lo")))
              & (F.col("__hi").isNull() | (F.col("__x") < F.col("__hi"))))
    done = None
    while True:
        borders = state.select(*interval, "__lo", "__hi").distinct()
        edges = stored(
            join_on(values, borders, group, "inner").where(inside).groupBy(*interval, "__lo", "__hi")
            .agg(F.array_sort(F.array_distinct(F.percentile_approx("__x", grid, 4 * buckets))).alias("__e")))
        placed = _edges_below(join_on(values, edges, group, "inner").where(inside), "__e", "__x", buckets, "__b")
        edge = F.get(F.col("__e"), F.col("__b"))
        on = F.coalesce(edge == F.col("__x"), F.lit(False))
        below = F.when(F.col("__b") > 0, F.get(F.col("__e"), F.col("__b") - 1)).otherwise(F.col("__lo"))
        counts = (placed.select(*interval, (2 * F.col("__b") + on.cast("int")).alias("__code"), "__n",
                                F.when(on, F.col("__x")).otherwise(below).alias("__from"),
                                F.when(on, F.col("__x")).otherwise(F.coalesce(edge, F.col("__hi"))).alias("__to"))
                  .groupBy(*interval, "__code", "__from", "__to").agg(F.sum("__n").alias("__n")))
        run = Window.partitionBy(*interval).orderBy("__code").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__stop", F.col("__base") + F.sum("__n").over(run))
        state = stored(
            join_on(state.select(*interval, "__r"), counts, interval, "inner")
            .where((F.col("__r") < F.col("__stop")) & (F.col("__r") >= F.col("__stop") - F.col("__n")))
            .select(*group, "__r", (F.col("__stop") - F.col("__n")).alias("__base"), F.col("__from").alias("__lo"),
                    F.col("__to").alias("__hi"), (F.col("__code") % 2 == 1).alias("__found")))
        found = state.where("__found").select(*group, "__r", F.col("__lo").alias("__v"))
        done = found if done is None else done.unionByName(found)
        state = state.where("not __found").drop("__found")
        if state.limit(1).count() == 0:
            return done


def exact_quantile_table(df: DataFrame, cols: Sequence[str], ps: Sequence[float], keys: Sequence[str] = (),
                         buckets: int = 256, small: int = 1_000_000) -> DataFrame:
    """Exact linear-interpolated quantiles per key (nulls ignored): one row
    per key that has any value, with columns ``<col>_q<i>`` for ``ps[i]``
    (null where the column has no value).  A null key is a key."""
    keys, cols = list(keys), list(cols)
    numbers = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    counts = numbers.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])
    largest = counts.agg(F.max(F.greatest(*[F.col(c) for c in cols], F.lit(0)))).first()[0]
    if largest is None or largest <= small:
        # checked size: the buffer of a group holds at most ``small`` values
        arr = F.array(*[F.lit(float(p)) for p in ps])
        g = numbers.groupBy(*keys).agg(*[F.percentile(c, arr).alias(c) for c in cols])
        g = g.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())
        return g.select(*keys, *[F.col(c)[i].alias(f"{c}_q{i}") for c in cols for i in range(len(ps))])
    group = [*keys, "__c"]
    long = numbers.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("x"))
                                                     for i, c in enumerate(cols)])).alias("s"))
    values = stored(long.select(*keys, F.col("s.c").alias("__c"), F.col("s.x").alias("__x"))
                         .where("__x is not null").groupBy(*group, "__x").agg(F.count(F.lit(1)).alias("__n")))
    total = values.groupBy(*group).agg(F.sum("__n").alias("__total"))
    ranks = []
    for i, p in enumerate(ps):
        h = F.lit(float(p)) * (F.col("__total") - 1)
        ranks.append(F.struct(F.lit(i).alias("i"), F.floor(h).alias("lo"), F.ceil(h).alias("hi"),
                              (h - F.floor(h)).alias("frac")))
    targets = (total.select(*group, F.explode(F.array(*ranks)).alias("t"))
               .select(*group, F.col("t.i").alias("__i"), F.col("t.frac").alias("__frac"),
                       F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("t.lo").alias("r")),
                                         F.struct(F.lit(1).alias("side"), F.col("t.hi").alias("r")))).alias("z"))
               .select(*group, "__i", "__frac", F.col("z.side").alias("__side"), F.col("z.r").cast("long").alias("__r")))
    hit = join_on(targets, select_ranks(values, group, targets, buckets), [*group, "__r"], "inner")
    side = lambda s: F.max(F.when(F.col("__side") == s, F.col("__v")))
    q = (hit.groupBy(*group, "__i", "__frac").agg(side(0).alias("__a"), side(1).alias("__b"))
         .select(*keys, "__c", "__i", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__frac")).alias("__q")))
    return q.groupBy(*keys).agg(*[F.max(F.when((F.col("__c") == j) & (F.col("__i") == i), F.col("__q"))).alias(f"{c}_q{i}")
                                  for j, c in enumerate(cols) for i in range(len(ps))])


def exact_quantiles(df: DataFrame, col: str, ps: Sequence[float], keys: Sequence[str] = (),
                    prefix: str | None = None, buckets: int = 256, small: int = 1_000_000) -> DataFrame:
    """Exact quantiles of one column: columns ``<prefix>_q<i>`` for ``ps[i]``."""
    table = exact_quantile_table(df, [col], ps, keys, buckets, small)
    prefix = prefix or col
    return table.select(*keys, *[F.col(f"{col}_q{i}").alias(f"{prefix}_q{i}") for i in range(len(ps))])
