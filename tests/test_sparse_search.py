"""Sparse search: tiles of large blocks against all products."""

import numpy as np

from dendra.functions import vectors as V
from dendra.operators import knn
from dendra.session import cut_lineage


def vectors(n, rng, vocab=400):
    """Vectors with a term in all, some in many, copies, and one without terms."""
    out = []
    for i in range(n):
        if i and i % 7 == 0:
            out.append(out[rng.integers(i)])
            continue
        t = np.unique(np.r_[3, (vocab * rng.random(rng.integers(1, 40)) ** 3).astype(int)]) * 10 ** 12
        w = rng.random(len(t))
        out.append((t, w / np.linalg.norm(w)))
    out[n // 2] = (np.zeros(0, np.int64), np.zeros(0))
    return out


def flat(vs):
    return (np.cumsum([0] + [len(t) for t, _ in vs]), np.concatenate([t for t, _ in vs]).astype(np.int64),
            np.concatenate([w for _, w in vs]))


def best(S, ids, k, out=None, digits=9):
    """Rows of (score, smallest id), by sorting all."""
    rows = []
    for r, scores in enumerate(np.round(S, digits)):
        order = sorted((-x, i) for x, i in zip(scores, ids) if out is None or i != out[r])
        rows += [(r, i, -x) for x, i in order[:k]]
    return rows


def test_tiles_hold_all_products(monkeypatch):
    rng = np.random.default_rng(1)
    L, R = vectors(90, rng), vectors(150, rng)
    want = V.sparse_scores(*zip(*L), *zip(*R))
    for cells, tail in ((1 << 20, 1 << 18), (1500, 300), (1, 1)):
        monkeypatch.setattr(V, "SPARSE_CELLS", cells)
        monkeypatch.setattr(V, "TAIL_CELLS", tail)
        got = np.concatenate([S for _, S in V.SparseBlock(*flat(R)).tiles(*flat(L))])
        assert np.allclose(got, want, atol=1e-12)


def test_nearest_sparse_equals_sorting_all(monkeypatch):
    rng = np.random.default_rng(2)
    L, R = vectors(60, rng), vectors(130, rng)
    # pairs without a common term tie at 0
    L[0] = (np.array([7]), np.array([1.0]))
    monkeypatch.setattr(V, "SPARSE_CELLS", 2000)
    S = V.sparse_scores(*zip(*L), *zip(*R))
    ids = np.arange(len(R))
    for k in (1, 5, 200):
        for out in (None, rng.integers(-1, len(R), len(L))):
            rows, cols, score = V.nearest_sparse(flat(L), flat(R), k, out, None if out is None else ids, 9)
            assert list(zip(rows, cols, np.round(score, 9))) == best(S, ids, k, out)


def test_blocks_do_not_decide(spark):
    rng = np.random.default_rng(3)
    vs = vectors(300, rng)
    df = cut_lineage(spark.createDataFrame([(i, t.tolist(), w.tolist()) for i, (t, w) in enumerate(vs)],
                                           "id long, t array<long>, w array<double>"))
    S = V.sparse_scores(*zip(*vs), *zip(*vs))
    want = sorted(best(S, range(300), 4, range(300)))
    for rows in (None, 70):
        nn = knn.self_top_k(df, 4, id_col="id", vec=None, terms="t", weights="w", metric="dot", round_digits=9,
                            block_rows=rows)
        assert sorted((r["id"], r["nbr_id"], r["score"]) for r in nn.collect()) == want


def test_blocks_by_bytes_send_rows_less_often(spark, monkeypatch):
    """Rows are sent once for each block of the other side, so blocks are as large as memory lets them be."""
    df = spark.range(3).selectExpr("id", "array_repeat(id, 300) t")
    n, rows = knn.sparse_size(df, "t", knn.SPARSE_LEFT_BYTES)
    assert n == 3 and 300 * 16 * rows <= knn.SPARSE_LEFT_BYTES and rows > 8 * knn.DEFAULT_BLOCK_ROWS


def test_no_vector_is_shuffled(spark, monkeypatch):
    """Blocks are rows of written tables, met where they lie; a task keeps the best of its pairs."""
    rng = np.random.default_rng(4)
    vs = vectors(120, rng)
    df = cut_lineage(spark.createDataFrame([(f"d{i:03}", f"d{i + 1:03}", t.tolist(), w.tolist())
                                            for i, (t, w) in enumerate(vs)],
                                           "id string, x string, t array<long>, w array<double>"))
    seen = []
    cut = knn.cut_lineage
    monkeypatch.setattr(knn, "cut_lineage", lambda d, *a: seen.append(d) or cut(d, *a))
    monkeypatch.setattr(knn, "HELD_BLOCKS", 1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    nn = knn.top_k(df, df, 3, q_vec=None, i_vec=None, q_terms="t", q_weights="w", i_terms="t", i_weights="w",
                   metric="dot", exclude="x", round_digits=9, block_rows=40)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == kept
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
    assert len(plans) == 2 and "CartesianProduct" in plans[-1]      # packed once for both sides
    assert not any("Exchange" in p for p in plans)
    S = V.sparse_scores(*zip(*vs), *zip(*vs))
    want = sorted((f"d{r:03}", f"d{c:03}", s) for r, c, s in best(S, range(120), 3, np.arange(120) + 1))
    assert sorted((r["id"], r["nbr_id"], r["score"]) for r in nn.collect()) == want
