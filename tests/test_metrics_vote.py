import numpy as np
from pyspark.sql import functions as F

from dendra.operators import knn, metrics, vote

# Contingency counts of the reference's shipped runs, cluster: {label: rows}.
DENSE = {-1: {"endocrinology": 1}, 0: {"psychiatry": 10}, 1: {"gastroenterology": 5},
         2: {"neurology": 7}, 3: {"pulmonology": 10}, 4: {"oncology": 6},
         5: {"nephrology": 10, "endocrinology": 3},
         6: {"infectious disease": 8, "oncology": 4, "neurology": 3}, 7: {"cardiology": 5},
         8: {"gastroenterology": 5, "infectious disease": 2}, 9: {"rheumatology": 6},
         10: {"rheumatology": 4}, 11: {"endocrinology": 4},
         12: {"cardiology": 5, "endocrinology": 2}}
SPARSE = {-1: {"neurology": 3, "psychiatry": 1}, 0: {"nephrology": 10}, 1: {"oncology": 6},
          2: {"pulmonology": 10, "infectious disease": 8, "endocrinology": 6, "gastroenterology": 1},
          3: {"gastroenterology": 5, "infectious disease": 2}, 4: {"rheumatology": 4},
          5: {"cardiology": 4, "endocrinology": 4}, 6: {"rheumatology": 6}, 7: {"cardiology": 6},
          8: {"gastroenterology": 4, "oncology": 1},
          9: {"neurology": 6, "psychiatry": 2, "oncology": 1},
          10: {"psychiatry": 7, "oncology": 2, "neurology": 1}}
KNOWN_2D = {0: {"0": 35}, 1: {"2": 20}, 2: {"3": 15}, 3: {"1": 18}, 4: {"1": 12}}


def _rows(spark, table):
    rows = []
    i = 0
    for c, labs in table.items():
        for lab, n in labs.items():
            for _ in range(n):
                rows.append((i, c, lab, 1.0 if c != -1 else 0.0))
                i += 1
    return spark.createDataFrame(rows, "id long, cluster int, label string, confidence double")


def test_ari_goldens(spark):
    for table, want in ((DENSE, 0.628692), (SPARSE, 0.458282), (KNOWN_2D, 0.882627)):
        got = metrics.adjusted_rand(_rows(spark, table), "label", "cluster").first()["ari"]
        assert abs(got - want) < 5e-7, (got, want)


def test_counts_and_dominant_tie(spark):
    df = _rows(spark, SPARSE)
    m = metrics.run_metrics(df, id_col="id", truth="label").first()
    assert m["n_clusters"] == 11 and m["noise_pct"] == 4.0 and m["ari"] == 0.4583
    d = {r["cluster"]: r["dominant"] for r in
         metrics.label_distribution(df, cluster="cluster", label="label", pos="id").collect()}
    assert d[5] == "cardiology"          # 4 vs 4: first met wins


def test_identical_partitions_and_one_cluster(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3) for i in range(9)], "id long, a int, b int")
    assert metrics.adjusted_rand(df, "a", "b").first()["ari"] == 1.0
    one = spark.createDataFrame([(i, [float(i), 0.0], 0, 1.0, 0) for i in range(5)],
                                "id long, v array<double>, cluster int, confidence double, t int")
    m = metrics.run_metrics(one, one, id_col="id", truth="t", vec="v").first()
    assert m["silhouette"] is None and m["davies_bouldin"] is None


def test_silhouette_of_many_clusters_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(60, 3))
    lab = np.concatenate([np.full(25, 7), np.arange(20) // 2 + 100, np.full(14, -5), [900]])
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i])) for i in range(60)],
                               "id long, v array<double>, c int")
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    want = {}
    for i in range(60):
        own = lab == lab[i]
        a = D[i, own].sum() / max(own.sum() - 1, 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        want[i] = 0.0 if own.sum() == 1 else (b - a) / max(a, b)
    for block in (7, 13, 60):
        got = metrics.silhouette_samples(df, id_col="id", vec="v", cluster="c", block_rows=block)
        rows = {r["id"]: r["silhouette"] for r in got.collect()}
        assert rows.keys() == want.keys()
        assert max(abs(rows[i] - want[i]) for i in want) < 1e-9


def test_silhouette_db_against_numpy(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(size=(6, 3)), rng.normal(size=(5, 3)) + 4, rng.normal(size=(1, 3)) - 5])
    lab = np.array([0] * 6 + [1] * 5 + [2])
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i])) for i in range(len(X))],
                               "id long, v array<double>, c int")
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    got = metrics.silhouette(df, id_col="id", vec="v", cluster="c").first()["silhouette"]
    assert abs(got - np.mean(s)) < 1e-9
    cen = np.array([X[lab == c].mean(0) for c in range(3)])
    sc = np.array([np.linalg.norm(X[lab == c] - cen[c], axis=1).mean() for c in range(3)])
    cd = np.sqrt(((cen[:, None] - cen[None]) ** 2).sum(-1))
    cd[cd == 0] = np.inf
    want = np.mean(np.max((sc[:, None] + sc[None]) / cd, axis=1))
    got = metrics.davies_bouldin(df, id_col="id", vec="v", cluster="c").first()["davies_bouldin"]
    assert abs(got - want) < 1e-9


def test_knn_brute_force_and_blocks(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(40)], "id long, vec array<double>")
    got = knn.self_top_k(df, 3, metric="euclidean", block_rows=7).orderBy("id", "rank").collect()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    want = np.argsort(D, axis=1, kind="stable")[:, :3]
    assert [r["nbr_id"] for r in got] == list(want.ravel())


def test_vote_ties_and_noise(spark):
    nn = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13),
                                (2, 1, 12), (2, 2, 14)], "id long, rank int, nbr_id long")
    asg = spark.createDataFrame([(10, 5), (11, 6), (12, 6), (13, 5), (14, -1)], "id long, cluster int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r["id"]: (r["predicted"], r["n_votes"]) for r in
           vote.majority_vote(nn, asg, queries=q).collect()}
    assert got[1] == (5, 2)     # 5 and 6 both twice: cluster of the nearest (rank 1) wins
    assert got[2] == (6, 1)     # noise neighbour casts no vote
    assert got[3] == (-1, 0)    # no neighbours at all
