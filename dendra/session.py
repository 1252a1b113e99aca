"""Session construction and lineage helpers.

Library functions never create a session; they take DataFrames and use
``df.sparkSession``.  ``build_session`` is for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "dendra",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session tuned for this library: AQE with skew-join splitting, Arrow
    transfer for the pandas operators, UTC time, no web UI."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.driver.memory",
                 driver_memory or os.environ.get("DENDRA_DRIVER_MEMORY", "8g"))
    parts = shuffle_partitions or int(os.environ.get("DENDRA_SHUFFLE_PARTITIONS", "8"))
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.shuffle.partitions", str(parts))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``dendra`` importable in executor Python workers (pandas
    functions reference it): zip the package once and ``addPyFile`` it."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="dendra-pkg-"), "dendra.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    A scratch folder is made only for a local master; elsewhere machines don't
    share it, so a session without the setting is refused."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        conf_dir = tempfile.mkdtemp(prefix="dendra-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and read it back (optionally partitioned, so later filters on that column
    prune files).

    Used by every iterative operator, so each round's plan stays short and a
    lost executor recomputes from the last written round.  A written table
    (rather than ``Dataset.checkpoint``) also gives the optimizer true file
    statistics: checkpointed plans carry their parent's size estimates, which
    compound across rounds of joins."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    # the schema is known, and a table without rows may have no file to infer it from
    return spark.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table.  A scan that yields fewer partitions than the cluster
    has cores (e.g. a single-row-group file) is spread round-robin so per-row
    work (tokenising whole texts, regex over html) uses every core; inputs
    that already arrive in many splits are left as they are."""
    ship_package(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        df = df.repartition(par)
    return df
