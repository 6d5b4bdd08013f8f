"""Session helpers: the configuration the library expects and the shared
checkpoint folder used to cut lineage in iterative plans."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this library assumes.  Timestamps at rest are
# ``timestamp_ntz``; arithmetic that needs epoch seconds casts to
# ``timestamp`` and therefore needs a UTC session.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Settings that make the plans scale; applied only when the user has not
# chosen a value already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "envspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with the library's configuration.

    On a cluster pass ``master=None`` and let spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {**DEFAULT_CONF, **REQUIRED_CONF,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply REQUIRED_CONF to an existing session and make the package
    importable on the executors (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to the executors (``addPyFile`` of a zip built
    once per Spark context), so Arrow UDFs and ``applyInPandas`` functions
    that live in the package can be imported by every Python worker - on a
    cluster as well as from any working directory."""
    import shutil
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="envspark-pkg-")
    archive = shutil.make_archive(os.path.join(staging, "envspark"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is
    unset *and* the master is local (tests) a fresh scratch folder is created
    and registered; on a cluster a machine-local folder would be invisible to
    the other executors, so an unset value is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="envspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table into the shared folder and read back.  Cuts
    the lineage like ``cut_lineage``; the plan that follows also knows the real
    size (a checkpoint carries the estimate of its plan along, which grows
    without bound in a loop that joins a state with itself)."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
