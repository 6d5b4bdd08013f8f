"""DuckDB SQL text for the oracle side of series queries (the same
definitions written as plain SQL windows and joins)."""

from __future__ import annotations


def _k(keys) -> str:
    return ", ".join(keys)


def _pby(keys) -> str:
    return f"PARTITION BY {_k(keys)} " if keys else ""


def bin_expr(step: int, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{step} seconds', {ts}, TIMESTAMP '1970-01-01')"


def resample_mean(src: str, step: int, cols, keys) -> str:
    """Bin means on the full grid (gaps null)."""
    aggs = ", ".join(f"avg({c}) AS {c}" for c in cols)
    kk = f"{_k(keys)}, " if keys else ""
    on = " AND ".join([f"g.{k} = b.{k}" for k in keys] + ["g.ts = b.ts"])
    gsel = ", ".join([f"g.{k}" for k in keys] + ["g.ts"] + [f"b.{c}" for c in cols])
    grp = f"GROUP BY {_k(keys)}" if keys else ""
    return (f"SELECT {gsel} FROM "
            f"(SELECT {kk}unnest(generate_series(min(ts), max(ts), INTERVAL '{step} seconds')) AS ts "
            f" FROM (SELECT {kk}{bin_expr(step)} AS ts FROM {src}) {grp}) g "
            f"LEFT JOIN (SELECT {kk}{bin_expr(step)} AS ts, {aggs} FROM {src} GROUP BY ALL) b ON {on}")


def grid(src: str, step: int, keys) -> str:
    kk = f"{_k(keys)}, " if keys else ""
    grp = f"GROUP BY {_k(keys)}" if keys else ""
    return (f"SELECT {kk}unnest(generate_series(min(b), max(b), INTERVAL '{step} seconds')) AS ts "
            f"FROM (SELECT {kk}{bin_expr(step)} AS b FROM {src}) {grp}")


def fill_linear(src: str, cols, keys) -> str:
    pb = _pby(keys)
    wb = f"({pb}ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wa = f"({pb}ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    inner = []
    for c in cols:
        inner += [f"last_value(CASE WHEN {c} IS NOT NULL THEN __pos END IGNORE NULLS) OVER {wb} AS __p0_{c}",
                  f"last_value({c} IGNORE NULLS) OVER {wb} AS __v0_{c}",
                  f"first_value(CASE WHEN {c} IS NOT NULL THEN __pos END IGNORE NULLS) OVER {wa} AS __p1_{c}",
                  f"first_value({c} IGNORE NULLS) OVER {wa} AS __v1_{c}"]
    outer = [f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN __p1_{c} IS NULL THEN __v0_{c} "
             f"ELSE __v0_{c} + (__v1_{c} - __v0_{c}) * (__pos - __p0_{c}) / (__p1_{c} - __p0_{c}) END AS {c}"
             for c in cols]
    kk = f"{_k(keys)}, " if keys else ""
    return (f"SELECT {kk}ts, {', '.join(outer)} FROM (SELECT *, {', '.join(inner)} FROM "
            f"(SELECT *, CAST(row_number() OVER ({pb}ORDER BY ts) AS DOUBLE) AS __pos FROM ({src}))) ")


def fill_dir(src: str, cols, keys, direction: str) -> str:
    pb = _pby(keys)
    if direction == "ffill":
        w = f"({pb}ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        fn = "last_value"
    else:
        w = f"({pb}ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        fn = "first_value"
    sel = ", ".join(f"{fn}({c} IGNORE NULLS) OVER {w} AS {c}" for c in cols)
    kk = f"{_k(keys)}, " if keys else ""
    return f"SELECT {kk}ts, {sel} FROM ({src})"


def scale(src: str, cols, keys, method: str) -> str:
    pb = f"(PARTITION BY {_k(keys)})" if keys else "()"
    out = []
    for c in cols:
        if method == "standard":
            sd = f"stddev_pop({c}) OVER {pb}"
            out.append(f"({c} - avg({c}) OVER {pb}) / CASE WHEN {sd} = 0 OR {sd} IS NULL THEN 1.0 ELSE {sd} END AS {c}")
        elif method == "minmax":
            rng = f"(max({c}) OVER {pb} - min({c}) OVER {pb})"
            out.append(f"({c} - min({c}) OVER {pb}) / CASE WHEN {rng} = 0 OR {rng} IS NULL THEN 1.0 ELSE {rng} END AS {c}")
        elif method == "robust":
            q1, q2, q3 = (f"quantile_cont({c}, {p}) OVER {pb}" for p in (0.25, 0.5, 0.75))
            iqr = f"({q3} - {q1})"
            out.append(f"({c} - {q2}) / CASE WHEN {iqr} = 0 OR {iqr} IS NULL THEN 1.0 ELSE {iqr} END AS {c}")
    kk = f"{_k(keys)}, " if keys else ""
    return f"SELECT {kk}ts, {', '.join(out)} FROM ({src})"


def zscore_flags(src: str, cols, keys, threshold=3.0, population=False) -> str:
    pb = f"(PARTITION BY {_k(keys)})" if keys else "()"
    flags = []
    for c in cols:
        if population:
            flags.append(f"COALESCE(abs(({c} - avg({c}) OVER {pb}) / (stddev_pop({c}) OVER {pb} + 1e-10)) > {threshold}, false) AS anomaly_{c}")
        else:
            sd = f"stddev_samp({c}) OVER {pb}"
            flags.append(f"COALESCE(abs(({c} - avg({c}) OVER {pb}) / CASE WHEN {sd} <> 0 THEN {sd} END) > {threshold}, false) AS anomaly_{c}")
    return f"SELECT *, {', '.join(flags)} FROM ({src})"


def iqr_flags(src: str, cols, keys, k=1.5) -> str:
    pb = f"(PARTITION BY {_k(keys)})" if keys else "()"
    flags = []
    for c in cols:
        q1, q3 = f"quantile_cont({c}, 0.25) OVER {pb}", f"quantile_cont({c}, 0.75) OVER {pb}"
        flags.append(f"COALESCE({c} < {q1} - {k} * ({q3} - {q1}) OR {c} > {q3} + {k} * ({q3} - {q1}), false) AS anomaly_{c}")
    return f"SELECT *, {', '.join(flags)} FROM ({src})"


def anomaly_summary(src: str, cols, keys, method="zscore", threshold=3.0) -> str:
    kk = f"{_k(keys)}, " if keys else ""
    parts = " UNION ALL ".join(
        f"SELECT {kk}ts, '{c}' AS \"column\", anomaly_{c} AS flag FROM ({src})" for c in cols)
    return (f"SELECT {kk}\"column\", '{method}' AS method, CAST({threshold} AS DOUBLE) AS threshold, "
            f"count_if(flag) AS anomaly_count, min(CASE WHEN flag THEN ts END) AS first_anomaly, "
            f"max(CASE WHEN flag THEN ts END) AS last_anomaly FROM ({parts}) GROUP BY ALL")
