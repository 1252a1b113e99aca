"""Dense and sparse vectors side by side: the corpus is weighed once."""

import numpy as np

from dendra.operators import features as FE
from dendra.plans import queries as Q


def test_vectors_are_written_once(spark, sf_dir, monkeypatch):
    written = []
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df, *a: written.append(df.columns) or cut(df, *a))
    df = Q.q_dense_sparse_join(spark, sf_dir)
    assert written == [["doc_id", "terms", "weights"], ["doc_id", "embedding"]]
    plan = df._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan
    assert df.count() == FE.sparse_vectors(Q._doc_weights(spark, sf_dir)[0]).count()


def test_embedding_is_the_signed_sum(spark):
    rng = np.random.default_rng(4)
    rows = [(i, sorted(int(t) for t in rng.integers(0, 1 << 60, n)), rng.random(n).tolist())
            for i, n in enumerate([3, 0, 9000, 1, 12000])]
    df = spark.createDataFrame(rows, "doc_id long, terms array<long>, weights array<double>")
    got = {r["doc_id"]: np.array(r["embedding"]) for r in FE.dense_embed(df, 16).collect()}
    for i, terms, weights in rows:
        v = np.array(weights) @ FE._signs(np.array(terms, dtype=np.int64), 16) if terms else np.zeros(16)
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1), atol=1e-12)
