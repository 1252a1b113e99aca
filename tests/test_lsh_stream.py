import os

import numpy as np
from pyspark.sql import functions as F

from dendra.operators import knn
from dendra.streaming import dedup


def test_lsh_recall_on_structured_data(spark):
    rng = np.random.default_rng(7)
    C = rng.normal(size=(6, 16)) * 4
    X = np.vstack([c + rng.normal(size=(25, 16)) for c in C])
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(len(X))],
                               "id long, vec array<double>")
    exact = knn.self_top_k(df, 5, metric="cosine")
    approx = knn.lsh_top_k(df, 5, bands=12, bits=4, block_rows=16)
    hit = exact.join(approx.select("id", "nbr_id"), ["id", "nbr_id"], "left_semi").count()
    assert hit / exact.count() >= 0.9
    # scores of found pairs are exact cosine scores
    j = exact.join(approx.select("id", "nbr_id", F.col("score").alias("s2")), ["id", "nbr_id"])
    assert j.filter(F.abs(F.col("score") - F.col("s2")) > 1e-12).count() == 0


def test_predict_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, x double") \
        .write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    out = dedup.predict_stream(spark, str(src), schema,
                               lambda b: b.select("id", (F.col("x") * 2).alias("y")),
                               out_path=str(tmp_path / "work"))
    assert out.count() == 10 and out.agg(F.sum("y")).first()[0] == 90.0
    assert os.path.exists(str(tmp_path / "work" / "ckpt"))


def test_lsh_rows_without_candidates_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in x])
                                for i, x in enumerate(rng.normal(size=(40, 12)))],
                               "id long, vec array<double>")
    got = knn.lsh_top_k(df, 5, bands=1, bits=10)      # nearly every bucket holds one row
    assert {r["count"] for r in got.groupBy("id").count().collect()} == {5}
    assert got.filter("id = nbr_id").count() == 0
