"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.session import cut_lineage, ensure_conf

__all__ = ["table", "cut_lineage", "spans", "spaces", "connected_components", "member_of", "blank", "small_batches"]

BITS = 1 << 20          # size of the fixed membership sketch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Hand texts to Python workers in batches of at most ``rows`` rows, to
    bound their memory."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ensure_conf(df.sparkSession)
    return df


def blank(text: str) -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(text), F.lit(""))


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def spans(text: Column, pattern: Column, measure=F.length) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of
    (start, end, hit), in units of ``measure`` (code points by default).

    The pieces between matches come from ``split`` and the matches from
    ``regexp_extract_all``; both run the same pattern over the same text, so
    the running sum of their sizes gives the offsets.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)),
                       lambda h, g: F.struct(measure(g).cast("int").alias("g"), measure(h).cast("int").alias("n"),
                                             h.alias("hit")))
    kind = "struct<pos:int,out:array<struct<start:int,end:int,hit:string>>>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(kind)
    return F.aggregate(
        pairs, zero,
        lambda a, p: F.struct(
            (a["pos"] + p["g"] + p["n"]).alias("pos"),
            F.concat(a["out"], F.array(F.struct((a["pos"] + p["g"]).alias("start"),
                                                (a["pos"] + p["g"] + p["n"]).alias("end"),
                                                p["hit"].alias("hit")))).alias("out")).cast(kind),
        lambda a: a["out"])


def member_of(ids: DataFrame, col: Column) -> Column:
    """Whether a 64-bit value may be among ``ids`` (first column): a bitmap of
    BITS bits, computed as a scalar subquery.  Its size is fixed; false
    positives are sorted out by the join that follows."""
    slot = F.pmod(F.col(ids.columns[0]), F.lit(BITS)) + 1
    maps = (ids.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
            .agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("m")))
    mine = F.pmod(col, F.lit(BITS)) + 1
    at = F.bitmap_bit_position(mine)
    byte = F.substring(F.element_at(maps.scalar(), F.bitmap_bucket_number(mine)), (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    bit = F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")
    return F.coalesce(value.bitwiseAND(bit) != 0, F.lit(False))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list, where the
    component is its smallest node.

    Alternates "connect larger neighbours to my smallest" and "connect
    smaller neighbours to my smallest" until every node hangs on its
    component's minimum.  Each round is two aggregates and two equi-joins
    over the edges, written to the shared checkpoint folder.  Raises if the
    edges have not settled after ``max_rounds`` (rounds grow with the log of
    the longest path).
    """
    e = (edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
         .where("u is not null and v is not null and u <> v").distinct())
    e = cut_lineage(e)
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return (e.select(F.col("v").alias("node"), F.col("u").alias("component"))
                    .union(e.select("u", "u")).distinct())
        seen = tuple(state)
        both = e.select("v", "u").union(e.select("u", "v")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        low2 = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(low2, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .union(low2.select("v", F.col("m").alias("u"))).where("v <> u").distinct())
        e = cut_lineage(small)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
