"""Writers and model tables.

Everything is written as partitioned parquet through Spark writers; nothing
passes through the driver.  A run is two tables - ``runs`` (one row per run:
params and metrics structs) and ``assignments`` (one row per point) - both
partitioned by ``run_id``.  ``write_json_lists`` writes the single nested JSON
object (or array) a file line by line, so no row holds a whole run.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendra.operators.metrics import attach

MODEL_TABLES = ("tree", "closed", "mst", "core", "selected", "assignments", "train", "layout")


def write_articles(articles: DataFrame, path: str, format: str = "parquet") -> None:
    articles.write.mode("overwrite").format(format).save(path)


def write_embeddings(emb: DataFrame, path: str, format: str = "parquet", compression: str | None = None) -> None:
    w = emb.write.mode("overwrite").format(format)
    (w if compression is None else w.option("compression", compression)).save(path)


def write_json_lists(items: DataFrame, frames: DataFrame, path: str) -> None:
    """JSON files that hold a list: ``frames`` (file_no, head, tail) has the text
    before and after each file's list, ``items`` (file_no, place, json) the
    elements.  A file is written by one task, an element a line, from sorted rows;
    choose ``file_no`` so that files are of a bounded size."""
    w = Window.partitionBy("file_no").orderBy("place")
    n = F.row_number().over(w)
    lines = items.select("file_no", F.lit(1).alias("part"), n.alias("n"),
                         F.concat(F.when(n > 1, ",").otherwise(""), F.col("json")).alias("line"))
    for part, col in ((0, "head"), (2, "tail")):
        lines = lines.unionByName(frames.select("file_no", F.lit(part).alias("part"),
                                                F.lit(0).alias("n"), F.col(col).alias("line")))
    (lines.repartition("file_no").sortWithinPartitions("file_no", "part", "n")
     .select("file_no", "line").write.mode("overwrite").partitionBy("file_no").text(path))


def write_run(run_id: str, params: DataFrame, metrics_row: DataFrame, assignments: DataFrame,
              base: str) -> None:
    """Append one run: params + metrics (one row) and its assignments."""
    one = attach(params, metrics_row)
    one.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id") \
        .parquet(os.path.join(base, "runs"))
    assignments.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id") \
        .parquet(os.path.join(base, "assignments"))


def read_run(spark: SparkSession, base: str, run_id: str):
    runs = spark.read.parquet(os.path.join(base, "runs")).filter(F.col("run_id") == run_id)
    asg = spark.read.parquet(os.path.join(base, "assignments")).filter(F.col("run_id") == run_id)
    return runs, asg          # run_id filters prune partitions


def write_sweep(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def save_model(model: dict, base: str) -> None:
    """A fitted density model as parquet tables (replaces pickled objects)."""
    for name in MODEL_TABLES:
        if name in model and model[name] is not None:
            model[name].write.mode("overwrite").parquet(os.path.join(base, name))


def load_model(spark: SparkSession, base: str) -> dict:
    return {name: spark.read.parquet(os.path.join(base, name)) for name in MODEL_TABLES
            if path_exists(spark, os.path.join(base, name))}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist in the store it names (any Hadoop file system)?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """Write-once table: read it when it was written completely, else compute,
    write, read.  Any other failure to read it is raised."""
    if not path_exists(spark, os.path.join(path, "_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
