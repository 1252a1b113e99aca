import pytest
from pyspark.sql import functions as F

from dendra.operators import layout, metrics
from dendra.plans import reports as RP
from dendra.sources import sinks, tables


def _run(spark, rows):
    return spark.createDataFrame(rows, "id long, cluster int, confidence double, label string")


def test_metrics_of_an_empty_run(spark):
    m = metrics.run_metrics(_run(spark, []), id_col="id", truth="label").first()
    assert m["n_clusters"] == 0 and m["noise_pct"] is None and m["avg_membership_confidence"] is None


def test_attach_refuses_more_than_one_row(spark):
    with pytest.raises(Exception, match="(?i)scalar_subquery|more than one row"):
        metrics.attach(spark.range(2), spark.range(2).withColumnRenamed("id", "x")).collect()


def test_unknown_ids_get_suggestions_and_noise_no_peers(spark):
    run = _run(spark, [(1, 0, 0.9, "a"), (2, 0, 0.8, "a"), (3, -1, 0.0, "b")])
    req = spark.createDataFrame([(1,), (3,), (7,)], "id long")
    r = {x["id"]: x for x in RP.lookup_report(req, run, 5, 2).collect()}
    assert r[1]["peers"] == [2] and r[1]["suggestions"] == []
    assert r[3]["is_noise"] and r[3]["peers"] == []
    assert not r[7]["found"] and r[7]["suggestions"] == ["1", "2"]


def test_unmatched_cluster_is_a_question_mark(spark):
    run = _run(spark, [(1, 0, 0.9, "a"), (2, -1, 0.8, "a")])
    m = spark.createDataFrame([(9, 1), (9, 2), (9, 5)], "id long, nbr_id long")
    r = {x["nbr_id"]: x["cluster_label"] for x in RP.matches_with_clusters(m, run).collect()}
    assert r == {1: "Cluster 0", 2: "NOISE", 5: "?"}


def test_article_array_and_lines_read_alike(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"pmid": "1", "title": "x"}, {"pmid": "2"}]')
    a = tables.read_articles(spark, str(tmp_path / "a.json"))
    sinks.write_articles(a, str(tmp_path / "lines"), "json")
    b = tables.read_articles(spark, str(tmp_path / "lines"), multi_line=False)
    assert sorted(r["pmid"] for r in b.collect()) == ["1", "2"] and a.schema == b.schema


def test_fuzzy_graph_of_sparse_vectors(spark):
    rows = [(i, [i % 3, 10 + i], [0.8, 0.6]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, terms array<long>, weights array<double>")
    g = layout.fuzzy_graph(df, 3, vec=None, terms="terms", weights="weights").collect()
    assert g and all(r["i"] % 3 == r["j"] % 3 for r in g)      # only rows that share a term
    e = {(r["i"], r["j"]): round(r["p"], 9) for r in g}
    assert all(e[(j, i)] == p for (i, j), p in e.items())
