"""Streaming additions (the reference is batch-only; these reuse the batch
operators on arriving data).

* ``first_seen_stream``: hits arriving as files -> validity filters ->
  ``dropDuplicates`` on the ID (state keeps one row per ID; first arrival wins).
* ``predict_stream``: ``foreachBatch`` applying a batch predictor against
  static model tables to each micro-batch, appending to a parquet table.
Sinks and checkpoints live under the session's shared checkpoint folder
unless a path is given.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.operators import ingest
from dendra.session import ensure_checkpoint_dir


def _work_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex}")


def first_seen_stream(spark: SparkSession, source_path: str, schema, to_hits, *,
                      out_path: str | None = None, **clean_kw) -> DataFrame:
    """Run the dedup stream over everything available now; return the sink."""
    work = out_path or _work_dir(spark, "first-seen")
    raw = spark.readStream.schema(schema).parquet(source_path)
    valid = ingest.clean_hits(to_hits(raw), **clean_kw)
    q = (valid.select("pmid", "topic", "query_no", "rank", "url_clean", "title_clean")
         .dropDuplicates(["pmid"])
         .writeStream.format("parquet").option("path", os.path.join(work, "out"))
         .option("checkpointLocation", os.path.join(work, "ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(work, "out"))


def predict_stream(spark: SparkSession, source_path: str, schema, predictor, *,
                   out_path: str | None = None) -> DataFrame:
    """``predictor(batch_df) -> DataFrame`` runs on every micro-batch
    (static model tables are joined inside it); results are appended."""
    work = out_path or _work_dir(spark, "predict")
    out = os.path.join(work, "out")

    def each(batch: DataFrame, epoch_id: int) -> None:
        predictor(batch).withColumn("epoch_id", F.lit(epoch_id)).write.mode("append").parquet(out)

    q = (spark.readStream.schema(schema).parquet(source_path).writeStream
         .foreachBatch(each).option("checkpointLocation", os.path.join(work, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
