"""Corpus weights a document a row equal those of entries joined with frequencies."""

import numpy as np
import pytest

from dendra.operators import features as FE

TEXTS = [(1, "a b b c"), (2, "a, c! ä"), (3, None), (4, " -- "), (5, "b"), (None, "a x"), (1, "b d É"),
         (None, "x"), (6, "only é here"), (7, "a a a a c once")]


def frame(spark):
    return spark.createDataFrame(TEXTS, "id long, body string").repartition(3)


def rows(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["term"], r["term_id"], round(r["weight"], 12))
                   for r in df.collect()))


@pytest.mark.parametrize("known", [0, 1, 3, 1 << 20])
def test_weights_equal_joins(spark, monkeypatch, known):
    monkeypatch.setattr(FE, "KNOWN_TERMS", known)
    monkeypatch.setattr(FE, "BATCH_DOCS", 2)
    tc = FE.term_counts(frame(spark), "id", "body")
    want = rows(FE.tfidf(tc, FE.document_frequency(tc)))
    w, dfreq = FE.corpus_tfidf(frame(spark), "id", "body")
    assert rows(FE.entries(w)) == want and len(want) == 17
    assert sorted(map(tuple, dfreq.collect())) == sorted(map(tuple, FE.document_frequency(tc).collect()))
    for r in FE.sparse_vectors(w).collect():
        assert r["terms"] == sorted(r["terms"]) and np.isclose(np.linalg.norm(r["weights"]), 1)


def test_vectors_of_the_corpus_are_not_shuffled(spark, sf_dir):
    from dendra.plans import queries as Q
    w, _ = Q._doc_weights(spark, sf_dir)
    for df in (FE.sparse_vectors(w), FE.dense_embed(FE.sparse_vectors(w), 8, keep=True)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_texts(spark):
    w, _ = FE.corpus_tfidf(spark.createDataFrame([(1, None), (2, "!")], "id long, body string"), "id", "body")
    assert FE.entries(w).count() == 0 and FE.vocabulary_index(w).count() == 0


def test_triples_follow_the_vocabulary(spark):
    w, _ = FE.corpus_tfidf(frame(spark), "id", "body")
    vocab = FE.vocabulary_index(w)
    got = FE.doc_term_triples(w, vocab)
    col = {r["term_id"]: r["col"] for r in vocab.collect()}
    assert sorted(col.values()) == list(range(len(col)))
    want = sorted((r["doc_id"] or 0, col[r["term_id"]], round(r["weight"], 12)) for r in FE.entries(w).collect())
    assert sorted((r["doc_id"] or 0, r["col"], round(r["val"], 12)) for r in got.collect()) == want


def test_triples_are_summed_where_they_are_joined(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as for a large vocabulary
    try:
        w, _ = FE.corpus_tfidf(frame(spark), "id", "body")
        got = FE.doc_term_triples(w, FE.vocabulary_index(w))
        assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_hybrid_vectors_are_written_once(spark, sf_dir, monkeypatch):
    from dendra.plans import queries as Q
    written = []
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df, *a: written.append(df) or cut(df, *a))
    assert Q.q_hybrid_top5(spark, sf_dir).count() > 0
    assert [df.columns[0] for df in written] == ["doc_id", "item_id"]
    assert "Join" not in written[0]._jdf.queryExecution().executedPlan().toString()


def test_sparse_lines_are_compressed(spark, sf_dir, monkeypatch):
    from dendra.plans import store_queries as SQ
    seen = []
    write = SQ.sinks.write_embeddings
    monkeypatch.setattr(SQ.sinks, "write_embeddings",
                        lambda rows, path, *a, **k: seen.extend((rows, path)) or write(rows, path, *a, **k))
    n = SQ.q_sparse_roundtrip(spark, sf_dir).count()
    rows, path = seen
    assert n == rows.count()
    files = spark.read.format("binaryFile").load(path).select("path").collect()
    assert files and all(f["path"].endswith(".json.gz") for f in files)
