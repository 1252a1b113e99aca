"""A stored index of rows by key: bucketed parquet, versions, a manifest.

Layout under ``base``::

    data/v=<n>/bucket=<b>/*.parquet     rows of bucket b written by version n
    manifest/v=<n>/*.parquet            per bucket and metadata value: the version
                                        that holds the bucket now, rows, dimensions

A row's bucket is a hash of its key.  An upsert rewrites only the buckets that
its updates fall into, as a new version, and then writes a manifest that points
there and leaves the other buckets where they are.  The manifest comes last and
is written once: a reader sees the index before or after an upsert, never
between, and what an upsert that failed has left is overwritten by the next.
One writer at a time.  Statistics come from the manifest, which has at most buckets x metadata
values rows; a filter on the metadata value skips the buckets and (rows are
sorted by it) the row groups that don't hold it.

Defined results: keys are unique (of repeated keys the one with the greatest
``order`` stays, ties are broken by the row itself); null keys form one key;
null metadata is a value of its own; an index without rows can be made and read;
rows must not have a column ``bucket``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators import knn
from dendra.sources.sinks import path_exists

MANIFEST_SCHEMA = "bucket int, meta string, version int, n long, min_dim int, max_dim int"


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Versions whose manifest was written completely, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names
                  if n.startswith("v=") and path_exists(spark, f"{base}/manifest/{n}/_SUCCESS"))


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """The newest manifest (``MANIFEST_SCHEMA``); raises where there is no index."""
    v = _versions(spark, base)
    if not v:
        raise FileNotFoundError(f"no index at {base}")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifest/v={v[-1]}")


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_version(rows: DataFrame, base: str, version: int, key: str, vec: str, meta: str) -> DataFrame:
    """Write bucketed rows (column ``bucket``) and return their manifest rows."""
    path = f"{base}/data/v={version}"
    (rows.repartition("bucket").sortWithinPartitions("bucket", meta, key)
     .write.mode("overwrite").partitionBy("bucket").parquet(path))
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    dim = F.size(vec)
    return back.groupBy("bucket", F.col(meta).cast("string").alias("meta")).agg(
        F.lit(version).alias("version"), F.count(F.lit(1)).alias("n"),
        F.min(dim).alias("min_dim"), F.max(dim).alias("max_dim")).select("bucket", "meta", "version",
                                                                        "n", "min_dim", "max_dim")


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the greatest ``order``; a hash aggregate, so a key
    repeated often costs a row per partition."""
    rest = [c for c in rows.columns if c not in (key, order)]
    top = F.max(F.struct(F.col(order), *rest)).alias("_m")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def create_index(rows: DataFrame, base: str, *, key: str, vec: str, meta: str,
                 buckets: int = 64) -> None:
    """Version 0 from rows with unique keys.  ``buckets`` stays for the index'
    life; choose it so that a bucket fits a task (rows / 1,000,000, say)."""
    if _versions(rows.sparkSession, base):
        raise FileExistsError(f"an index is stored at {base}")
    m = _write_version(rows.withColumn("bucket", _bucket(key, buckets)), base, 0, key, vec, meta)
    m.coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/v=0")


def read_index(spark: SparkSession, base: str, schema, *, meta: str,
               value=None, only_buckets: list[int] | None = None) -> DataFrame:
    """Rows of the newest version (``schema`` plus ``bucket``).  ``value`` keeps
    the rows whose metadata is that value and opens only the buckets that have
    it; ``only_buckets`` opens those buckets."""
    m = manifest(spark, base)
    if value is not None:
        m = m.filter(F.col("meta") == F.lit(value).cast("string"))
    if only_buckets is not None:
        m = m.filter(F.col("bucket").isin(only_buckets))
    # at most one folder a bucket: bounded by the index' number of buckets
    held = m.select("version", "bucket").distinct().orderBy("version", "bucket").collect()
    paths = [f"{base}/data/v={r['version']}/bucket={r['bucket']}" for r in held]
    if not paths:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(*paths)
    return df.filter(F.col(meta) == F.lit(value)) if value is not None else df


def upsert_index(updates: DataFrame, base: str, *, key: str, vec: str, meta: str, order: str,
                 buckets: int = 64) -> int:
    """Insert or replace rows by key, the greatest ``order`` of a key wins.
    Rewrites the touched buckets only; returns their number."""
    spark = updates.sparkSession
    version = _versions(spark, base)
    if not version:
        raise FileNotFoundError(f"no index at {base}")
    version = version[-1] + 1
    new = _latest(updates, key, order).withColumn("bucket", _bucket(key, buckets))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    if not touched:
        return 0
    schema = new.drop("bucket").schema
    old = read_index(spark, base, schema, meta=meta, only_buckets=touched)
    old = old.withColumn("bucket", _bucket(key, buckets))
    same = new.select(F.col(key).alias("_k")).distinct()
    kept = old.join(same, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    before = manifest(spark, base).filter(~F.col("bucket").isin(touched))
    m = _write_version(kept.unionByName(new), base, version, key, vec, meta)
    before.unionByName(m).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/v={version}")
    return len(touched)


def index_stats(spark: SparkSession, base: str) -> DataFrame:
    """Rows, dimension range and metadata values of the index, and the number of
    its versions in use, without reading a vector."""
    return manifest(spark, base).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_vectors"),
        F.min("min_dim").cast("long").alias("min_dim"), F.max("max_dim").cast("long").alias("max_dim"),
        F.count_distinct("meta").cast("long").alias("n_values"),
        F.count_distinct("version").cast("long").alias("n_versions"))


def search_index(queries: DataFrame, base: str, schema, k: int, *, key: str, vec: str, meta: str,
                 value=None, metric: str = "cosine", q_id: str = "id", q_vec: str = "vec",
                 **kw) -> DataFrame:
    """Top-k rows of the stored index per query, among those with the metadata
    ``value`` if one is given; the row count comes from the manifest."""
    spark = queries.sparkSession
    m = manifest(spark, base)
    if value is not None:
        m = m.filter(F.col("meta") == F.lit(value).cast("string"))
    n = m.agg(F.sum("n")).first()[0] or 0
    index = read_index(spark, base, schema, meta=meta, value=value)
    return knn.top_k(queries, index, k, q_id=q_id, i_id=key, q_vec=q_vec, i_vec=vec, metric=metric,
                     n_index=n, **kw)
