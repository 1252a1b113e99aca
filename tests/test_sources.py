import json

from pyspark.sql import functions as F

from dendra.operators import metrics
from dendra.sources import sinks, tables


def test_read_run_result_and_rescore(spark, tmp_path):
    run = {
        "umap_params": {"n_components": 40, "n_neighbors": 5, "min_dist": 0.0,
                        "metric": "cosine", "random_state": 42},
        "hdbscan_params": {"min_cluster_size": 3, "min_samples": None,
                           "cluster_selection_epsilon": 0.0,
                           "cluster_selection_method": "eom", "metric": "euclidean"},
        "metrics": {"n_clusters": 2, "noise_pct": 20.0, "silhouette": "N/A",
                    "davies_bouldin": "N/A", "ari_vs_categories": 0.5,
                    "avg_membership_confidence": 0.9},
        "assignments": [
            {"pmid": "1", "cluster": 0, "confidence": 1.0, "category": "a", "title": "t1"},
            {"pmid": "2", "cluster": 0, "confidence": 0.8, "category": "a", "title": "t2"},
            {"pmid": "3", "cluster": 1, "confidence": 0.9, "category": "b", "title": "t3"},
            {"pmid": "4", "cluster": 1, "confidence": 0.9, "category": "b", "title": "t4"},
            {"pmid": "5", "cluster": -1, "confidence": 0.0, "category": "b", "title": "t5"}],
    }
    p = tmp_path / "run.json"
    p.write_text(json.dumps(run, indent=2))
    runs, asg = tables.read_run_result(spark, str(p))
    r = runs.first()
    assert r["metrics"]["n_clusters"] == 2 and r["metrics"]["silhouette"] is None
    assert r["hdbscan_params"]["cluster_selection_method"] == "eom"
    assert asg.count() == 5
    m = metrics.run_metrics(asg.withColumnRenamed("pmid", "id"), id_col="id",
                            truth="category").first()
    assert m["n_clusters"] == 2 and m["noise_pct"] == 20.0
    assert abs(m["avg_membership_confidence"] - 0.9) < 1e-12


def test_articles_and_run_tables(spark, tmp_path):
    arts = [{"pmid": "9", "title": "x", "abstract": "y", "category": "c",
             "url": "https://pubmed.ncbi.nlm.nih.gov/9/", "relevance_score": 0.5}]
    p = tmp_path / "articles.json"
    p.write_text(json.dumps(arts))
    a = tables.read_articles(spark, str(p))
    assert a.first()["pmid"] == "9"
    base = str(tmp_path / "runs")
    params = spark.createDataFrame([(3, "eom")], "min_cluster_size int, method string")
    mrow = spark.createDataFrame([(1, 0.0)], "n_clusters int, noise_pct double")
    asg = spark.createDataFrame([(1, 0, 1.0)], "id long, cluster int, confidence double")
    sinks.write_run("r1", params, mrow, asg, base)
    runs, back = sinks.read_run(spark, base, "r1")
    assert runs.count() == 1 and back.filter(F.col("cluster") == 0).count() == 1
