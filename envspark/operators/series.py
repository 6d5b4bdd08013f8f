"""Time-series cleaning: resampling, gap fills, scaling.

Every operator works on many series at once: ``keys`` names the columns that
identify a series (default ``["source_id"]``; ``[]`` = one series).

Scale plan.  Raw readings are first reduced to one row per (keys, bin) with
a partially-aggregated ``groupBy`` - a sensor that holds a third of all rows
is combined map-side before the shuffle.  Only the per-key *grid* (bounded by
time span / freq, not by the number of readings) is then ordered by a window
``partitionBy(keys)``.  Gap rows of the grid are generated by exploding the
distance to the next occupied bin, so no spine join is needed.

One long series.  A window over a whole series is one task.  With
``via="blocks"`` - the default without keys - the ordered steps run in ranges
of about equal size and carry what crosses a border (``blocks.py``);
``via="window"`` is the default with keys, where series are many and bounded.
Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.functions.timefn import epoch_seconds, freq_seconds, from_epoch_seconds
from envspark.operators.blocks import neighbours, ranges, with_index
from envspark.operators.common import attach, join_on
from envspark.operators.quantiles import exact_quantile_table

DAY = 86400
STEPS = 1 << 16         # most gap rows made from one array


def numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """All numeric columns except the excluded (keys, time, ids)."""
    skip = set(exclude) | {"id"}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def _cols(df: DataFrame, cols, keys, time_col) -> list[str]:
    if cols is None:
        cols = numeric_cols(df, [*keys, time_col])
    cols = [c for c in cols if c != time_col]
    if not cols:
        raise ValueError("no value columns")
    return list(cols)


def _grid_window(keys: Sequence[str], time_col: str, descending: bool = False):
    o = F.col(time_col).desc() if descending else F.col(time_col)
    return Window.partitionBy(*keys).orderBy(o) if keys else Window.orderBy(o)


def _running(keys: Sequence[str], time_col: str, backwards: bool = False):
    """Running frame from the first row (or, backwards, from the last row) to
    the current one.  Spark evaluates running frames incrementally; a frame
    ending at UNBOUNDED FOLLOWING is re-aggregated per row (quadratic), so
    "next value" lookups use a reversed order with a running frame instead."""
    return _grid_window(keys, time_col, backwards).rowsBetween(Window.unboundedPreceding, 0)


def _in_blocks(keys: Sequence[str], via: str | None) -> bool:
    if via not in (None, "window", "blocks"):
        raise ValueError(f"unknown way {via!r}: window or blocks")
    return via == "blocks" or (via is None and not keys)


def _steps(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Every row ``n`` times, numbered from 0 in ``name``.  Two levels, so
    that a gap of any length makes short arrays only."""
    return (df.withColumn("__n", n)
            .withColumn("__hi", F.explode(F.expr(f"sequence(0L, (__n - 1) div {STEPS}L)")))
            .withColumn(name, F.explode(F.expr(f"sequence(__hi * {STEPS}L, least(__n, (__hi + 1) * {STEPS}L) - 1)")))
            .drop("__n", "__hi"))


def bin_start(df: DataFrame, time_col: str, step: int, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """Left-closed, left-labelled bin of ``time_col``, anchored at midnight of
    the first day of each series.  For steps that divide a day the anchor is
    any midnight, so the epoch grid is used and no per-key origin is needed."""
    sec = epoch_seconds(F.col(time_col))
    if DAY % step == 0:
        return df, from_epoch_seconds(F.floor(sec / step) * step)
    origin = (df.groupBy(*keys).agg(F.min(time_col).alias("__t0"))
              .select(*keys, (F.floor(epoch_seconds(F.col("__t0")) / DAY) * DAY).alias("__origin")))
    df = attach(df, origin, keys, "inner")
    return df, from_epoch_seconds(F.col("__origin") + F.floor((sec - F.col("__origin")) / step) * step)


def _fill_gaps(binned: DataFrame, keys: Sequence[str], time_col: str, step: int,
               value_cols: Sequence[str], via: str | None = None) -> DataFrame:
    """Insert the empty bins between occupied ones (values null)."""
    if _in_blocks(keys, via):
        marked = neighbours(ranges(binned, keys, [time_col]), keys, [time_col],
                            after={"__nx": F.struct(F.col(time_col).alias("t"))})
        nxt = F.col("__nx.t")
    else:
        marked = binned.withColumn("__nx", F.lead(time_col).over(_grid_window(keys, time_col)))
        nxt = F.col("__nx")
    n = F.coalesce(((epoch_seconds(nxt) - epoch_seconds(F.col(time_col))) / step).cast("long"), F.lit(1).cast("long"))
    gaps = _steps(marked, n, "__k")
    out = [*[F.col(k) for k in keys],
           from_epoch_seconds(epoch_seconds(F.col(time_col)) + F.col("__k") * step).alias(time_col)]
    out += [F.when(F.col("__k") == 0, F.col(c)).alias(c) for c in value_cols]
    return gaps.select(*out)


def resample_mean(df: DataFrame, freq="1h", cols=None, keys=("source_id",), time_col="ts",
                  fill_gaps: bool = True, via: str | None = None) -> DataFrame:
    """Mean per bin; empty bins between first and last are present as null."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    step = freq_seconds(freq)
    df2, b = bin_start(df, time_col, step, keys)
    binned = df2.groupBy(*keys, b.alias(time_col)).agg(*[F.avg(c).alias(c) for c in cols])
    return _fill_gaps(binned, keys, time_col, step, cols, via) if fill_gaps else binned


def resample_fill(df: DataFrame, freq="1h", method: str = "linear", cols=None, keys=("source_id",),
                  time_col="ts", agg: str = "mean", edges: bool = False, via: str | None = None) -> DataFrame:
    """P1 followed by P3/P4/P5 in one plan: bin means, then the gaps filled
    while they are generated.  The fill windows run on the *occupied* bins
    only (far fewer rows than the grid): for every column the last non-null
    (position, value) at or before the bin and the first non-null strictly
    after it; each exploded grid row then computes its value directly.
    Positions are grid indices, so this equals interpolating the full grid
    by row position.  The grid itself is never sorted.

    ``agg='asfreq'`` takes the reading exactly on each grid point instead of
    the bin mean (two readings on one grid point fail the query);
    ``edges=True`` then fills what is left forward and backward (leading /
    trailing runs), as the series preprocessing does."""
    if method not in ("linear", "ffill", "pad", "bfill"):
        raise ValueError(f"no gap fill called {method!r}; there are linear, ffill, pad and bfill")
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    step = freq_seconds(freq)
    df2, b = bin_start(df, time_col, step, keys)
    if agg == "mean":
        binned = df2.groupBy(*keys, b.alias(time_col)).agg(*[F.avg(c).alias(c) for c in cols])
    elif agg == "asfreq":
        on = F.col(time_col) == b
        g = df2.groupBy(*keys, b.alias(time_col)).agg(
            F.count_if(on).alias("__dup"), *[F.first(F.when(on, F.col(c)), True).alias(c) for c in cols])
        binned = g.select(*keys, time_col, *[
            F.when(F.col("__dup") > 1, F.raise_error(F.lit("duplicate timestamps on the grid")))
            .otherwise(F.col(c)).alias(c) for c in cols])
    else:
        raise ValueError(f"no bin aggregation called {agg!r}; there are mean and asfreq")
    binned = binned.withColumn("__pos", F.round(epoch_seconds(F.col(time_col)) / step))
    pos = F.col("__pos")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(pos.alias("p"), F.col(c).alias("v"))) for c in cols}
    if _in_blocks(keys, via):
        marked = neighbours(ranges(binned, keys, [time_col]), keys, [time_col],
                            upto={f"__b_{c}": known[c] for c in cols},
                            after={"__nx": F.struct(pos.alias("p")), **{f"__a_{c}": known[c] for c in cols}})
        marked = marked.select(*binned.columns, F.col("__nx.p").alias("__next"), *[
            F.col(f"__{side}_{c}")[f].alias(f"__{f}{i}_{c}") for c in cols for i, side in enumerate("ba") for f in "pv"])
    else:
        upto = _running(keys, time_col)
        after = _grid_window(keys, time_col, True).rowsBetween(Window.unboundedPreceding, -1)
        sel = [F.lead("__pos").over(_grid_window(keys, time_col)).alias("__next")]
        for c in cols:
            sel += [F.last(F.when(F.col(c).isNotNull(), pos), True).over(upto).alias(f"__p0_{c}"),
                    F.last(F.col(c), True).over(upto).alias(f"__v0_{c}"),
                    F.last(F.when(F.col(c).isNotNull(), pos), True).over(after).alias(f"__p1_{c}"),
                    F.last(F.col(c), True).over(after).alias(f"__v1_{c}")]
        marked = binned.select("*", *sel)
    n = F.coalesce((F.col("__next") - pos).cast("long"), F.lit(1).cast("long"))
    grid = _steps(marked, n, "__k")
    gpos = pos + F.col("__k")
    out = [*[F.col(k) for k in keys],
           from_epoch_seconds((pos + F.col("__k")) * step).alias(time_col)]
    for c in cols:
        own = F.when(F.col("__k") == 0, F.col(c))
        p0, v0, p1, v1 = (F.col(f"__{x}_{c}") for x in ("p0", "v0", "p1", "v1"))
        if method == "linear":
            gap = F.when(p1.isNull(), v0).otherwise(v0 + (v1 - v0) * (gpos - p0) / (p1 - p0))
        elif method in ("ffill", "pad"):
            gap = v0
        else:
            gap = v1
        val = F.coalesce(own, gap)
        if edges:                                   # remaining leading/trailing nulls
            val = F.coalesce(val, v0, v1)
        out.append(val.alias(c))
    return grid.select(*out)


def _grid(df: DataFrame, step: int, keys, time_col, via: str | None = None) -> DataFrame:
    """Grid ``(keys, time_col)`` from the first to the last bin of each series."""
    df2, b = bin_start(df, time_col, step, keys)
    occ = df2.groupBy(*keys, b.alias(time_col)).agg(F.lit(True).alias("__occ"))
    return _fill_gaps(occ, keys, time_col, step, [], via)


def resample_asfreq(df: DataFrame, freq="1h", cols=None, keys=("source_id",), time_col="ts",
                    via: str | None = None) -> DataFrame:
    """Grid value = reading exactly on the grid point, else null.
    Two readings on the same grid point make the query fail (as a reindex
    with duplicate labels does)."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    step = freq_seconds(freq)
    df2, b = bin_start(df, time_col, step, keys)
    on_grid = (df2.where(F.col(time_col) == b)
               .groupBy(*keys, F.col(time_col))
               .agg(F.count(F.lit(1)).alias("__dup"), *[F.first(c).alias(c) for c in cols]))
    checked = on_grid.select(*keys, time_col, *[
        F.when(F.col("__dup") > 1, F.raise_error(F.lit("duplicate timestamps on the grid")))
        .otherwise(F.col(c)).alias(c) for c in cols])
    return join_on(_grid(df, step, keys, time_col, via), checked, [*keys, time_col])


def _asof_fill(df: DataFrame, freq, cols, keys, time_col, direction: str, via: str | None = None) -> DataFrame:
    """Upsampling fill: grid value = value of the last reading at or before
    the grid point (``ffill``) or of the first at or after it (``bfill``).
    Each reading is assigned to the one grid point it can serve first and
    reduced there (partial aggregation); the grid then carries it on."""
    keys = list(keys)
    step = freq_seconds(freq)
    df2, b = bin_start(df, time_col, step, keys)
    order = F.struct(F.col(time_col), F.col("id")) if "id" in df.columns else F.col(time_col)
    if direction == "ffill":
        target = F.when(F.col(time_col) == b, b).otherwise(
            from_epoch_seconds(epoch_seconds(b) + step))
        red = df2.groupBy(*keys, target.alias(time_col)).agg(
            *[F.max_by(c, order).alias(c) for c in cols])
    else:
        red = df2.groupBy(*keys, b.alias(time_col)).agg(
            *[F.min_by(c, order).alias(c) for c in cols])
    red = red.withColumn("__hit", F.lit(True))
    j = join_on(_grid(df, step, keys, time_col, via), red, [*keys, time_col])
    hit = {f"__h_{c}": F.when(F.col("__hit"), F.struct(F.col(c).alias("v"))) for c in cols}
    if _in_blocks(keys, via):
        base = ranges(j, keys, [time_col])
        if direction == "ffill":
            found = neighbours(base, keys, [time_col], upto=hit)
        else:
            found = neighbours(base, keys, [time_col], after=hit)
            found = found.select(*j.columns, *[F.coalesce(e, F.col(n)).alias(n) for n, e in hit.items()])
    else:
        frame = _running(keys, time_col, backwards=direction != "ffill")
        found = j.select("*", *[F.last(e, True).over(frame).alias(n) for n, e in hit.items()])
    return found.select(*keys, time_col, *[F.col(f"__h_{c}.v").alias(c) for c in cols])


def _asof_ffill_sparse(df: DataFrame, freq, cols, keys, time_col, via: str | None = None) -> DataFrame:
    """P9 ``ffill`` (as-of, then forward and backward fill) without sorting
    the grid.  A reading serves first the grid point at or after it (its
    *hit*); after the fills, a grid point holds the latest non-null hit at or
    before it, else the earliest non-null hit of the series.  Both come from
    windows over the sparse table of occupied bins and hits; the gaps are
    exploded afterwards and inherit the value."""
    keys = list(keys)
    step = freq_seconds(freq)
    df2, b = bin_start(df, time_col, step, keys)
    order = F.struct(F.col(time_col), F.col("id")) if "id" in df.columns else F.col(time_col)
    target = F.when(F.col(time_col) == b, b).otherwise(from_epoch_seconds(epoch_seconds(b) + step))
    hits = df2.groupBy(*keys, target.alias("__t")).agg(*[F.max_by(c, order).alias(c) for c in cols])
    hits = hits.select(*keys, "__t", F.lit(True).alias("__hit"), F.lit(False).alias("__occ"), *cols)
    occ = df2.groupBy(*keys, b.alias("__t")).agg(F.lit(1).alias("__one")).select(
        *keys, "__t", F.lit(False).alias("__hit"), F.lit(True).alias("__occ"),
        *[F.lit(None).cast("double").alias(c) for c in cols])
    sp = (hits.unionByName(occ).groupBy(*keys, "__t")
          .agg(F.max("__hit").alias("__hit"), F.max("__occ").alias("__occ"),
               *[F.max(F.when(F.col("__hit"), F.col(c))).alias(c) for c in cols]))
    known = {c: F.when(F.col("__hit") & F.col(c).isNotNull(), F.col(c)) for c in cols}
    if _in_blocks(keys, via):
        end = sp.groupBy(*keys).agg(F.max(F.when(F.col("__occ"), F.col("__t"))).alias("__end"))
        m = neighbours(ranges(sp, keys, ["__t"]), keys, ["__t"], upto={f"__f_{c}": known[c] for c in cols},
                       after={"__next": F.col("__t"), **{f"__e_{c}": known[c] for c in cols}})
        # without a hit at or before it, the first one after a row is the first of the series
        m = attach(m, end, keys)
    else:
        w = _grid_window(keys, "__t")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sel = [F.lead("__t").over(w).alias("__next"),
               F.max(F.when(F.col("__occ"), F.col("__t"))).over(whole).alias("__end")]
        for c in cols:
            sel += [F.last(known[c], True).over(upto).alias(f"__f_{c}"), F.first(known[c], True).over(whole).alias(f"__e_{c}")]
        m = sp.select(*keys, "__t", *sel)
    m = m.where(F.col("__t") <= F.col("__end"))
    stop = F.least(F.coalesce(F.col("__next"), F.col("__end") + F.expr(f"INTERVAL {step} SECONDS")),
                   F.col("__end") + F.expr(f"INTERVAL {step} SECONDS"))
    n = ((epoch_seconds(stop) - epoch_seconds(F.col("__t"))) / step).cast("long")
    g = _steps(m, n, "__k")
    return g.select(*keys, from_epoch_seconds(epoch_seconds(F.col("__t")) + F.col("__k") * step).alias(time_col),
                    *[F.coalesce(F.col(f"__f_{c}"), F.col(f"__e_{c}")).alias(c) for c in cols])


# ---------------------------------------------------------------------------
# Fills on a regular grid (P3-P8).  Input: output of P1/P2 (one row per bin).

def fill_linear(df: DataFrame, cols=None, keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    """Interior gaps interpolated linearly by position, trailing gaps keep
    the last value, leading gaps stay null.  Position = row number in time
    order (pandas' default ``method='linear'`` ignores index spacing; on a
    regular grid the two agree)."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    pos = F.col("__pos")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(pos.alias("p"), F.col(c).alias("v"))) for c in cols}
    if _in_blocks(keys, via):
        base = with_index(ranges(df, keys, [time_col]), keys, [time_col], "__pos")
        both = neighbours(base, keys, [time_col], upto={f"__b_{c}": known[c] for c in cols},
                          after={f"__a_{c}": known[c] for c in cols})
    else:
        # one forward pass (position, previous non-null of every column) and one
        # backward pass (next non-null): two sorts whatever the number of columns
        base = df.select("*", F.row_number().over(_grid_window(keys, time_col)).alias("__pos"))
        before, after = _running(keys, time_col), _running(keys, time_col, backwards=True)
        both = base.select("*", *[F.last(known[c], True).over(before).alias(f"__b_{c}") for c in cols])
        both = both.select("*", *[F.last(known[c], True).over(after).alias(f"__a_{c}") for c in cols])
    filled = {}
    for c in cols:
        (p0, v0), (p1, v1) = ((F.col(f"__{side}_{c}.p").cast("double"), F.col(f"__{side}_{c}.v")) for side in "ba")
        filled[c] = (F.when(F.col(c).isNotNull(), F.col(c)).when(p1.isNull(), v0)
                     .otherwise(v0 + (v1 - v0) * (pos - p0) / (p1 - p0)))
    return both.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def _fill_towards(df: DataFrame, cols, keys, time_col, via: str | None, backwards: bool) -> DataFrame:
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    if _in_blocks(keys, via):
        near = {f"__v_{c}": F.col(c) for c in cols}
        found = neighbours(ranges(df, keys, [time_col]), keys, [time_col], **{"after" if backwards else "upto": near})
        value = {c: F.coalesce(F.col(c), F.col(f"__v_{c}")) for c in cols}
    else:
        frame = _running(keys, time_col, backwards)
        found, value = df, {c: F.last(F.col(c), True).over(frame) for c in cols}
    return found.select(*[value[c].alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_ffill(df: DataFrame, cols=None, keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    """P4 (``ffill`` / ``pad``): last non-null value so far."""
    return _fill_towards(df, cols, keys, time_col, via, backwards=False)


def fill_bfill(df: DataFrame, cols=None, keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    """P5: next non-null value."""
    return _fill_towards(df, cols, keys, time_col, via, backwards=True)


def fill_mean(df: DataFrame, cols=None, keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    """Nulls replaced by the series mean (one partial aggregate per key,
    joined back)."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    j = attach(df, df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols]), keys)
    return j.select(*[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_median(df: DataFrame, cols=None, keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    """Nulls replaced by the series median (exact, linear interpolation;
    rank selection, so no task holds a series)."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    j = attach(df, exact_quantile_table(df, cols, [0.5], keys), keys)
    return j.select(*[F.coalesce(F.col(c), F.col(f"{c}_q0")).alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_zero(df: DataFrame, cols=None, keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    """P8."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    return df.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


FILLS = {"linear": fill_linear, "ffill": fill_ffill, "pad": fill_ffill, "bfill": fill_bfill,
         "mean": fill_mean, "median": fill_median, "zero": fill_zero}


def fill(df: DataFrame, method: str, cols=None, keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    if method not in FILLS:
        raise ValueError(f"no fill called {method!r}; there are {', '.join(FILLS)}")
    return FILLS[method](df, cols, keys, time_col, via)


def preprocess_series(df: DataFrame, freq="1h", fill_method="linear", cols=None,
                      keys=("source_id",), time_col="ts", via: str | None = None) -> DataFrame:
    """Resample to ``freq`` with upsampling semantics, fill, then ffill
    and bfill whatever is left.

    linear      grid values of readings exactly on the grid, interpolated
    ffill/pad   last reading at or before each grid point
    bfill       first reading at or after each grid point
    mean        bin means
    other       readings exactly on the grid
    """
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    if fill_method == "linear":
        return resample_fill(df, freq, "linear", cols, keys, time_col, agg="asfreq", edges=True, via=via)
    if fill_method == "mean":
        return resample_fill(df, freq, "ffill", cols, keys, time_col, agg="mean", edges=True, via=via)
    if fill_method not in ("ffill", "pad", "bfill"):
        return resample_fill(df, freq, "ffill", cols, keys, time_col, agg="asfreq", edges=True, via=via)
    if fill_method in ("ffill", "pad"):
        return _asof_ffill_sparse(df, freq, cols, keys, time_col, via)
    out = _asof_fill(df, freq, cols, keys, time_col, "bfill", via)
    return fill_bfill(fill_ffill(out, cols, keys, time_col, via), cols, keys, time_col, via)


# ---------------------------------------------------------------------------
# Scaling (P10-P12).  Statistics per series, nulls ignored in the fit and
# kept null in the output.

def scale_stats(df: DataFrame, method: str, cols, keys=("source_id",),
                quantile_range=(25.0, 75.0), with_centering=True, with_scaling=True) -> DataFrame:
    """Fitted scaler as a table ``(keys..., <col>__center, <col>__scale)``.
    One partially-aggregated pass (robust: one rank selection for all
    columns); reusable on new data (``apply_scale``)."""
    keys = list(keys)
    aggs = []
    for c in cols:
        if method == "standard":
            center = F.avg(c)
            sd = F.stddev_pop(c)
            scale = F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
        elif method == "minmax":
            center = F.min(c)
            rng = F.max(c) - F.min(c)
            scale = F.when((rng == 0) | rng.isNull(), F.lit(1.0)).otherwise(rng)
        elif method == "robust":
            continue
        else:
            raise ValueError(f"no scaling called {method!r}; there are standard, minmax and robust")
        aggs += [center.cast("double").alias(f"{c}__center"), scale.cast("double").alias(f"{c}__scale")]
    if method != "robust":
        return df.groupBy(*keys).agg(*aggs)
    lo, hi = quantile_range
    q = exact_quantile_table(df, cols, [lo / 100, 0.5, hi / 100], keys)
    out = []
    for c in cols:
        iqr = F.col(f"{c}_q2") - F.col(f"{c}_q0")
        out += [(F.col(f"{c}_q1") if with_centering else F.lit(0.0)).cast("double").alias(f"{c}__center"),
                (F.when((iqr == 0) | iqr.isNull(), F.lit(1.0)).otherwise(iqr) if with_scaling else F.lit(1.0))
                .cast("double").alias(f"{c}__scale")]
    return attach(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), q, keys).select(*keys, *out)


def apply_scale(df: DataFrame, stats: DataFrame, cols, keys=("source_id",)) -> DataFrame:
    """Apply a fitted scaler (the stats table is one row per series)."""
    keys = list(keys)
    j = attach(df, stats, keys)
    return j.select(*[((F.col(c) - F.col(f"{c}__center")) / F.col(f"{c}__scale")).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def scale(df: DataFrame, method: str | None, cols=None, keys=("source_id",), time_col="ts",
          quantile_range=(25.0, 75.0), with_centering=True, with_scaling=True) -> DataFrame:
    """P10 standard (population std, 0 -> 1), P11 minmax (range 0 -> 1),
    P12 robust ((x - median) / IQR): statistics per series from partial
    aggregates or rank selection, joined back to the rows."""
    if method is None:
        return df
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    return apply_scale(df, scale_stats(df, method, cols, keys, quantile_range, with_centering, with_scaling), cols, keys)


def preprocess(df: DataFrame, freq="1h", fill_method="linear", scale_method="standard",
               cols=None, keys=("source_id",), time_col="ts", via: str | None = None, **scale_kw) -> DataFrame:
    """Resample (bin means) -> fill -> scale, one lazy plan."""
    keys = list(keys)
    cols = _cols(df, cols, keys, time_col)
    if freq and fill_method in ("linear", "ffill", "pad", "bfill"):
        out = resample_fill(df, freq, fill_method, cols, keys, time_col, via=via)
    else:
        out = resample_mean(df, freq, cols, keys, time_col, via=via) if freq else df.select(*keys, time_col, *cols)
        if fill_method in FILLS:
            out = FILLS[fill_method](out, cols, keys, time_col, via)
    return scale(out, scale_method, cols, keys, time_col, **scale_kw)
