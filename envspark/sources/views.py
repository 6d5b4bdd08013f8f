"""Domain views over the driver's parquet tables.

The monitoring domain has four relational tables (sources, images,
readings, detections) plus pixel, point-cloud and message tables.  The test
data is a TPC-H-like star schema, so each domain table is a projection of one
base table.  The projections are SQL expression lists that Spark
(``selectExpr``) and DuckDB (``SELECT ... FROM``) evaluate identically, so the
oracle SQL can embed exactly the same view definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.session import ensure_conf

# The view definitions (column expressions over the base tables).
VIEW_EXPRS: dict[str, tuple[str, list[str]]] = {
    "readings": ("events", [
        "event_id AS id",
        "user_id AS source_id",
        "ts AS ts",
        "event_type AS sensor_type",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS temperature",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS humidity",
        "props AS metadata",
    ]),
    "sources": ("customer", [
        "c_custkey AS id",
        "c_name AS name",
        "CASE c_custkey % 3 WHEN 0 THEN 'satellite' WHEN 1 THEN 'drone' ELSE 'iot_sensor' END AS type",
        "c_acctbal > 0 AS is_active",
        "CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon",
        "CAST((c_custkey * 10473) % 18000 AS DOUBLE) / 100 - 90 AS lat",
    ]),
    "detections": ("events", [
        "event_id AS id",
        "CASE event_type WHEN 'click' THEN 'illegal_logging' WHEN 'error' THEN 'wildfire' "
        "WHEN 'purchase' THEN 'water_pollution' WHEN 'signup' THEN 'air_quality' ELSE 'other' END AS threat_type",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS confidence",
        "ts AS ts",
        "CAST((event_id * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon",
        "CAST((event_id * 10473) % 18000 AS DOUBLE) / 100 - 90 AS lat",
        "CASE user_id % 3 WHEN 0 THEN 'satellite' WHEN 1 THEN 'drone' ELSE 'iot_sensor' END AS source_type",
        "user_id AS source_id",
        "CASE WHEN event_id % 3 = 0 THEN event_id END AS image_id",
        "CASE WHEN event_id % 3 = 1 THEN event_id END AS sensor_reading_id",
        "event_id % 5 = 0 AS is_verified",
    ]),
    "images": ("orders", [
        "o_orderkey AS id",
        "o_custkey AS source_id",
        "o_orderdate AS ts",
        "CAST((o_orderkey * 7919) % 35900 AS DOUBLE) / 100 - 180 AS min_lon",
        "CAST((o_orderkey * 10473) % 17900 AS DOUBLE) / 100 - 90 AS min_lat",
        "CAST((o_orderkey * 7919) % 35900 AS DOUBLE) / 100 - 179.5E0 AS max_lon",
        "CAST((o_orderkey * 10473) % 17900 AS DOUBLE) / 100 - 89.5E0 AS max_lat",
        "o_totalprice / 500000 AS cloud_cover",
        "CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 10 ELSE 20 END AS DOUBLE) AS resolution",
    ]),
    "lidar": ("lineitem", [
        "l_suppkey AS file_id",
        "l_extendedprice AS x",
        "CAST(l_orderkey AS DOUBLE) AS y",
        "l_quantity AS z",
        "l_discount * 100 AS intensity",
        "l_linenumber AS classification",
    ]),
    "messages": ("events", [
        "event_id AS id",
        "concat('sensors/', user_id, '/', event_type) AS topic",
        "CASE WHEN event_id % 23 = 0 THEN '{broken' ELSE concat('{\"sensor_id\": ', user_id, "
        "', \"value\": ', value, ', ', substr(props, 2)) END AS payload",
        "event_id % 2 AS qos",
        "event_id % 7 = 0 AS retain",
        "ts AS received_at",
    ]),
}

# Pixel layout of the embeddings table (one 64-vector = one
# 8x8 band of one image; four consecutive vectors are the four bands).
BANDS = ["B02", "B03", "B04", "B08"]
TILE = 8
PIXEL_COLS = ["image_id", "band", "row", "col", "value"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the domain views, lazily projected from its base table."""
    ensure_conf(spark)
    if name in ("pixels", "thermal"):
        return pixels(spark, sf_dir) if name == "pixels" else thermal(spark, sf_dir)
    base, exprs = VIEW_EXPRS[name]
    return _read(spark, sf_dir, base).selectExpr(*exprs)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band-long pixel table ``(image_id, band, row, col, value)``."""
    ensure_conf(spark)
    emb = _read(spark, sf_dir, "embeddings")
    band = F.element_at(F.array(*[F.lit(b) for b in BANDS]),
                        (F.col("vec_id") % 4 + 1).cast("int"))
    return (emb.select("vec_id", F.posexplode("embedding").alias("i", "x"))
            .select(F.floor(F.col("vec_id") / 4).alias("image_id"),
                    band.alias("band"),
                    F.floor(F.col("i") / TILE).alias("row"),
                    (F.col("i") % TILE).cast("bigint").alias("col"),
                    F.round((F.col("x").cast("double") + 1) * 5000).alias("value")))


def thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-band frames: the B08 band of each pixel tile."""
    return (pixels(spark, sf_dir).where(F.col("band") == "B08")
            .select("image_id", "row", "col", "value"))


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL (for the oracle side of the correctness gate).

def view_sql(name: str) -> str:
    if name == "pixels":
        return (
            "SELECT CAST(FLOOR(vec_id / 4) AS BIGINT) AS image_id, "
            "CASE vec_id % 4 WHEN 0 THEN 'B02' WHEN 1 THEN 'B03' WHEN 2 THEN 'B04' ELSE 'B08' END AS band, "
            "CAST(FLOOR(i / 8) AS BIGINT) AS row, CAST(i % 8 AS BIGINT) AS col, "
            "ROUND((CAST(x AS DOUBLE) + 1) * 5000) AS value "
            "FROM (SELECT vec_id, UNNEST(embedding) AS x, "
            "UNNEST(range(len(embedding))) AS i FROM embeddings)")
    if name == "thermal":
        return f"SELECT image_id, row, col, value FROM ({view_sql('pixels')}) WHERE band = 'B08'"
    base, exprs = VIEW_EXPRS[name]
    return f"SELECT {', '.join(exprs)} FROM {base}"


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs defining the named views."""
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
