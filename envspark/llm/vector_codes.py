"""Product codes of vectors: Lloyd rounds that follow active entries only.

Components become integers ``floor(scale * x)`` and vectors are cut into
equal consecutive parts, each with its own codebook, which begins as that
part of the vectors with the smallest ids.  Between rounds every row keeps the
entry and the exact squared distance of each of its parts in a table written
to the shared folder.  A part whose entry stayed where it was is compared only
with the entries that moved; a part whose entry moved is compared with all.
Equal distances go to the lower entry in both cases, so the result is that of
a full scan.

A codebook holds entries x dimensions integers whatever the number of rows;
it travels with the tasks.  New entries come from integer sums, taken per task
and then per (part, entry), so no order of summation shows.

Rows whose vector is null, empty or holds a null, NaN or infinite component
are left out, and so are rows whose vector has another length than that of
the smallest id left.  Null ids come after all others; equal ids are ordered
by vector.  Fewer rows than entries give smaller codebooks; no row gives no
result.  Components beyond +-131072 (at scale 256) fail the query: squared
distances would leave 64 bits.  Repeated rows are coded one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.session import checkpoint_dir, ensure_conf

LARGEST = 1 << 25       # of an integer component


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of integer vectors."""
    top = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:        # every sum is exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[:, k]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared_distances(x, entries)
    at = d.argmin(1)                                # the first of equals
    return at, d[np.arange(len(x)), at]


def assign(parts: np.ndarray, books: np.ndarray, held: np.ndarray | None = None, dist: np.ndarray | None = None,
           moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of every part (rows x parts x
    length).  With the entries held before, their distances and which entries
    have moved since, parts of unmoved entries look at moved entries only."""
    n, m, _ = parts.shape
    entry, far = np.zeros((n, m), np.int64), np.zeros((n, m), np.int64)
    for p in range(m):
        x = parts[:, p]
        again = np.ones(n, bool) if held is None else moved[p][held[:, p]]
        entry[again, p], far[again, p] = nearest(x[again], books[p])
        stay = np.flatnonzero(~again)
        if not len(stay):
            continue
        best, least = held[stay, p].copy(), dist[stay, p].copy()
        active = np.flatnonzero(moved[p])
        if len(active):
            at, d = nearest(x[stay], books[p][active])
            at = active[at]
            nearer = (d < least) | ((d == least) & (at < best))
            best[nearer], least[nearer] = at[nearer], d[nearer]
        entry[stay, p], far[stay, p] = best, least
    return entry, far


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)


def _integers(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    q = np.floor(scale * _matrix(column, np.float64))
    if np.abs(q).max(initial=0) > LARGEST:
        raise ValueError(f"vector component beyond {LARGEST // scale}")
    return q.astype(np.int64).reshape(len(column), parts, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def usable(vector: str) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    x = F.col(vector)
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))
                                                 & ~F.isnan(v)), F.lit(False))


def _assigned(rows: DataFrame, books: np.ndarray, scale: int, moved: np.ndarray | None) -> DataFrame:
    """Rows with ``entry`` and ``dist`` of each part; those of the last round
    are used where ``moved`` is given."""
    m = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = _integers(b.column("vector"), scale, m)
            if moved is None:
                entry, dist = assign(parts, books)
            else:
                entry, dist = assign(parts, books, _matrix(b.column("entry"), np.int64),
                                     _matrix(b.column("dist"), np.int64), moved)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("vector"), _lists(entry.astype(np.int16)), _lists(dist)],
                ["id", "label", "vector", "entry", "dist"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, vector {kinds['vector']}, "
                                "entry array<short>, dist array<long>")


def _moved_books(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks whose used entries are the floored means of their parts."""
    m, n, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((m * n, d), np.int64), np.zeros(m * n, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            parts = _integers(b.column("vector"), scale, m)
            at = (_matrix(b.column("entry"), np.int64) + np.arange(m) * n).ravel()
            np.add.at(sums, at, parts.reshape(-1, d))
            counts += np.bincount(at, minlength=m * n)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), _lists(sums[used])],
                                             ["at", "n", "sums"])
    partial = rows.select("vector", "entry").mapInArrow(run, "at long, n long, sums array<long>")
    exact = "decimal(38,0)"
    total = partial.groupBy("at").agg(F.sum(F.col("n").cast(exact)).alias("n"),
                                      F.array(*[F.sum(F.col("sums")[k].cast(exact)) for k in range(d)]).alias("sums"))
    out = books.copy().reshape(m * n, d)
    for r in total.collect():                       # at most one row per entry
        out[r.at] = [int(s) // int(r.n) for s in r.sums]
    return out.reshape(m, n, d)


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                  parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Every usable row's id, label, ``entry`` and ``dist`` (nearest entry and
    squared distance of each part), and the codebooks (parts x entries x
    length)."""
    spark = ensure_conf(vectors.sparkSession)
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
            .where(usable("vector")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    size = len(first[0].vector) if first else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == size)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    q = np.floor(scale * np.array([r.vector for r in start], np.float64).reshape(len(start), parts, size // parts))
    if np.abs(q).max(initial=0) > LARGEST:
        raise ValueError(f"vector component beyond {LARGEST // scale}")
    books, moved = np.ascontiguousarray(q.astype(np.int64).transpose(1, 0, 2)), None
    top = f"{checkpoint_dir(spark)}/product-codes-{uuid.uuid4().hex}"
    for k in range(rounds + 1):
        _assigned(rows, books, scale, moved).write.parquet(f"{top}/{k}")
        rows = spark.read.parquet(f"{top}/{k}")
        if k < rounds:
            old, books = books, _moved_books(rows, books, scale)
            moved = (books != old).any(2)
    return rows.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "entry", "dist"), books


def with_group_sums(rows: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """Rows with the sum of ``value`` over equal ``group`` values (nulls are
    equal).  The sums are written first, so that their size is known when the
    join is planned."""
    spark = rows.sparkSession
    top = f"{checkpoint_dir(spark)}/group-sums-{uuid.uuid4().hex}"
    rows.groupBy(F.col(group).alias("__group")).agg(F.sum(value).alias(out)).write.parquet(top)
    sums = spark.read.parquet(top)
    return rows.join(sums, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def code_report(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", **options) -> DataFrame:
    """Every usable row's id, ``code`` (two hex digits per part), ``error``
    (summed squared distances), ``label_error`` (errors summed over its label)
    and the SHA-256 of all codebook components."""
    rows, books = product_codes(vectors, id_col, label_col=label_col, **options)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    two = lambda e: F.lpad(F.lower(F.hex(e.cast("long"))), 2, "0")
    rows = rows.select(id_col, F.col(label_col).alias("__label"), F.array_join(F.transform("entry", two), "").alias("code"),
                       F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    return (with_group_sums(rows, "error", "__label", "label_error").drop("__label")
            .withColumn("codebooks_sha256", F.lit(digest)))


#: The same in DuckDB SQL, every assignment a full scan.
ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT vec_id, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS v
  FROM kept, (SELECT unnest(range(16)) AS part)),
{books}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, k)) AS codebooks_sha256
  FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS k FROM b2)),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (vec_id)),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM labelled GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM labelled l JOIN sums s ON l.label IS NOT DISTINCT FROM s.label, digest
"""
_BOOKS = """b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v
  FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),"""
_ROUND = """
a{k} AS (
  SELECT vec_id, part, any_value(v) AS v, min(d) AS d, arg_min(e, (d, e)) AS e
  FROM (SELECT c.vec_id, c.part, c.v, b.e, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM cut c JOIN b{k} b USING (part)) GROUP BY vec_id, part),"""
_MOVE = """
s{k} AS (
  SELECT part, e, list(m ORDER BY i) AS v
  FROM (SELECT part, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
        FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) GROUP BY part, e, i) GROUP BY part, e),
b{n} AS (SELECT b.part, b.e, coalesce(s.v, b.v) AS v FROM b{k} b LEFT JOIN s{k} s USING (part, e)),"""
ORACLE_SQL = ORACLE_SQL.format(books=_BOOKS + "".join(_ROUND.format(k=k) + (_MOVE.format(k=k, n=k + 1) if k < 2 else "")
                                                      for k in range(3)))
