"""The tiled exact search against scores of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.functions import vectors as V
from dendra.operators import knn


def _all_pairs(L, R, k, metric, l_out, r_out, digits):
    rows, cols = np.indices((len(L), len(R))).reshape(2, -1)
    S = V.pair_scores(L, R, rows, cols, metric).reshape(len(L), len(R))
    S = S if digits is None else np.round(S, digits)
    out = []
    for i in range(len(L)):
        ok = [j for j in range(len(R)) if l_out[i] != r_out[j] and np.isfinite(S[i, j])]
        ok.sort(key=lambda j: (S[i, j] if metric == "euclidean" else -S[i, j], j))
        out += [(i, j, S[i, j]) for j in ok[:k]]
    return out


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
@pytest.mark.parametrize("kind", ["copies", "close", "random"])
def test_tiles_give_the_result_of_all_pairs(metric, kind, monkeypatch):
    monkeypatch.setattr(V, "TILE_ROWS", 16)
    monkeypatch.setattr(V, "TILE_COLS", 64)
    monkeypatch.setattr(V, "FIRST_COLS", 20)
    rng = np.random.default_rng(3)
    if kind == "copies":
        L, R = rng.integers(0, 3, (50, 3)).astype(float), rng.integers(0, 3, (400, 3)).astype(float)
    elif kind == "close":
        at = rng.normal(size=(4, 5)) * 1000
        L, R = at[rng.integers(0, 4, 50)], at[rng.integers(0, 4, 400)] + rng.normal(size=(400, 5)) * 1e-9
    else:
        L, R = rng.normal(size=(50, 6)) * 1e-5, rng.normal(size=(400, 6)) * 1e4
    R[7, 1], R[8, 0], L[3, 2], R[9] = np.nan, np.inf, np.nan, 0.0
    l_out, r_out = rng.integers(-1, 400, 50), np.arange(400)
    for digits in (None, 3):
        with np.errstate(invalid="ignore"):
            want = _all_pairs(L, R, 7, metric, l_out, r_out, digits)
            got = V.nearest_rows(L, R, 7, metric, l_out, r_out, digits)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_blocks_text_ids_and_exclusion(spark):
    rng = np.random.default_rng(5)
    X = rng.integers(0, 4, (300, 3)).astype(float)
    ids = [f"v{i:03}" for i in range(300)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, X)], "id string, vec array<float>")
    queries = df.withColumn("not", F.when(F.col("id") < "v150", "v200"))
    for block in (None, 37):
        got = knn.top_k(queries, df, 4, metric="euclidean", exclude="not", q_vec="vec", i_vec="vec",
                        block_rows=block).orderBy("id", "rank").collect()
        D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
        D[:150, 200] = np.inf
        want = [(ids[i], r + 1, ids[j]) for i in range(300)
                for r, j in enumerate(np.lexsort((np.arange(300), D[i]))[:4])]
        assert [(g["id"], g["rank"], g["nbr_id"]) for g in got] == want


def test_dense_blocks_are_large(spark):
    """Rows sent are rows x blocks: 20,000 vectors make a few blocks, not ten."""
    df = spark.range(20000).select("id", F.array(F.rand(1), F.rand(2)).alias("vec"))
    rows = df.sparkSession.sparkContext.defaultParallelism
    left, right = knn.plan_blocks(spark, 20000, 20000, knn.DENSE_BLOCK_BYTES // 16)
    assert left * right < 2 * rows + max(left, right) + 1
    assert knn.self_top_k(df, 1, metric="euclidean").count() == 20000


def test_vectors_of_two_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "id long, vec array<double>")
    with pytest.raises(Exception, match="one length"):
        knn.self_top_k(df, 1).collect()


def test_distance_tiles(spark):
    """Copies are at distance 0, near points keep their digits."""
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 5)) * 100
    X[20:40] = X[:20]
    X[40:50] = X[:10] + rng.normal(size=(10, 5)) * 1e-7
    want = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
    got = np.full((60, 60), -1.0)
    for r, c, d in V.distance_tiles(X, X, rows=13, cols=7):
        got[r:r + d.shape[0], c:c + d.shape[1]] = d
    assert np.allclose(got, want, rtol=1e-9, atol=0)
    assert (got[np.arange(20), np.arange(20, 40)] == 0).all()


def test_silhouette_takes_large_blocks(spark, monkeypatch):
    """12,000 points were 36 pairs of blocks of 2048; rows sent grew with that."""
    from dendra.operators import metrics
    asked = []
    plan = metrics.plan_blocks
    monkeypatch.setattr(metrics, "plan_blocks", lambda s, a, b, rows, *per: asked.append(rows) or plan(s, a, b, rows, *per))
    df = spark.range(12000).select("id", F.array(F.rand(1), F.rand(2) + F.col("id") % 2).alias("v"),
                                   (F.col("id") % 2).alias("c"))
    got = metrics.silhouette(df, id_col="id", vec="v", cluster="c").first()[0]
    small = metrics.silhouette(df, id_col="id", vec="v", cluster="c", block_rows=1000).first()[0]
    assert asked[0] > 12000 and asked[1] == 1000 and abs(got - small) < 1e-9
