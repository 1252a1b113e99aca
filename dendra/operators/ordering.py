"""Global consecutive numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.session import cut_lineage


def consecutive_index(df: DataFrame, order_cols: list[str], out: str = "idx",
                      partitions: int | None = None, start: int = 0) -> DataFrame:
    """Number rows ``start, start+1, ...`` in ``order_cols`` order.

    Rows are range partitioned on the order columns, counted per partition,
    and each partition adds the running total of the partitions before it
    (a window over one row per partition).  The order columns must be unique."""
    parts = partitions or max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = cut_lineage(df.repartitionByRange(parts, *order_cols)
                         .withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_p", F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    w = Window.partitionBy("_p").orderBy(*order_cols)
    return (ranged.withColumn("_r", F.row_number().over(w))
            .join(F.broadcast(offs), "_p")     # one row per partition
            .withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_r") - 1 + start)
                        .cast("long"))
            .drop("_p", "_r", "_off"))
