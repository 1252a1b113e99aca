"""Registered queries of readers, writers, stored runs and sweeps.  Tables are
written in the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.functions import text as TX
from dendra.operators import density, features as FE, ingest, knn, metrics
from dendra.plans import reports as RP
from dendra.plans import sweep as SW
from dendra.session import ensure_checkpoint_dir, read_table
from dendra.sources import sinks
from dendra.sources import tables as SRC
from dendra.sources import vector_index as VI

TOP_K = 5
TOPIC_TARGET = 10


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/store/{name}-{uuid.uuid4().hex}"


def _pubmed_valid(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    hits = SRC.pages_as_pubmed_hits(read_table(spark, sf_dir, "pages"))
    return ingest.clean_hits(hits), SRC.topics_from_hits(hits, TOPIC_TARGET)


def q_clean_hits(spark, sf_dir):
    """Valid hits under the default rules: own host, 20 hits a query, an ID in
    the URL, an abstract by heading or description; title without the suffix."""
    valid, _ = _pubmed_valid(spark, sf_dir)
    return valid.select("page_id", "pmid", "url_clean", "title_clean", "abstract")


def q_unique_hits_total(spark, sf_dir):
    """Valid hits and distinct IDs among them."""
    valid, topics = _pubmed_valid(spark, sf_dir)
    first = ingest.first_seen(valid, topics)
    return metrics.attach(valid.agg(F.count(F.lit(1)).alias("n_hits")),
                          first.agg(F.count(F.lit(1)).alias("n_unique")))


def q_articles_roundtrip(spark, sf_dir):
    """First-seen hits as articles, written as JSON lines and read back."""
    valid, topics = _pubmed_valid(spark, sf_dir)
    path = _folder(spark, "articles")
    sinks.write_articles(ingest.to_articles(ingest.first_seen(valid, topics)), path, "json")
    return SRC.read_articles(spark, path, multi_line=False)


def q_articles_array(spark, sf_dir):
    """First-seen hits written as JSON arrays of up to 1,000 ids a file and read
    back in splits."""
    valid, topics = _pubmed_valid(spark, sf_dir)
    a = ingest.to_articles(ingest.first_seen(valid, topics))
    items = a.select(F.floor(F.col("pmid").cast("long") / 1000).alias("file_no"),
                     F.col("pmid").alias("place"), F.to_json(F.struct(*a.columns)).alias("json"))
    frames = items.select("file_no").distinct().select(
        "file_no", F.lit("[").alias("head"), F.lit("]").alias("tail"))
    path = _folder(spark, "arrays")
    sinks.write_json_lists(items, frames, path)
    return SRC.read_articles(spark, path)


def q_run_results_read(spark, sf_dir):
    """Run results, one nested JSON object a file (1,000 ids each), read back as
    runs and flat assignments and joined by file."""
    run = _stored_run(spark, sf_dir).withColumn("file_no", F.floor(F.col("id") / 1000))
    noise = F.col("cluster") == -1
    frames = run.groupBy("file_no").agg(
        F.count_distinct(F.when(~noise, F.col("cluster"))).cast("int").alias("n_clusters"),
        F.round(100 * F.count_if(noise) / F.count(F.lit(1)), 1).alias("noise_pct"))
    head = F.to_json(F.struct(
        F.lit("dense").alias("embedding_type"),
        F.concat(F.lit('run "'), F.col("file_no").cast("string"), F.lit('" {[')).alias("model"),
        F.struct(F.lit(40).alias("n_components"), F.lit("cosine").alias("metric")).alias("umap_params"),
        F.struct("n_clusters", "noise_pct").alias("metrics")))
    head = F.concat(F.left(head, F.length(head) - 1), F.lit(', "assignments": ['))
    frames = frames.select("file_no", head.alias("head"), F.lit("]}").alias("tail"))
    items = run.select("file_no", F.col("id").alias("place"), F.to_json(F.struct(
        F.col("id").cast("string").alias("pmid"), "cluster", "confidence",
        F.concat(F.lit('}], "'), F.col("label").cast("string")).alias("category"))).alias("json"))
    path = _folder(spark, "results")
    sinks.write_json_lists(items, frames, path)
    runs, asg = SRC.read_run_result(spark, path)
    head = runs.select("run_file", "model", F.col("umap_params.n_components").alias("n_components"),
                       "metrics.n_clusters", "metrics.noise_pct")
    return (asg.select("run_file", "pmid", "cluster", "confidence", "category")
            .join(head, "run_file").drop("run_file"))


def q_dense_roundtrip(spark, sf_dir):
    """Embeddings with metadata (title cut to 60, abstract to 500 characters)
    written as JSON lines, read back without the ``url`` metadata key."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("lang"), F.col("text"))
    e = read_table(spark, sf_dir, "embeddings").join(d, "vec_id", "left")
    text = F.coalesce("text", F.lit(""))
    rows = e.select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"),
        F.struct(F.col("vec_id").cast("string").alias("pmid"), TX.truncate(text, 60).alias("title"),
                 TX.truncate(text, TX.ABSTRACT_METADATA_LIMIT).alias("abstract"),
                 F.col("lang").alias("category"), F.lit("").alias("url")).alias("metadata"))
    path = _folder(spark, "dense")
    sinks.write_embeddings(rows, path, "json")
    r = SRC.read_dense_embeddings(spark, path, multi_line=False, drop=("url",))
    total = F.aggregate(F.transform("values", lambda x: x.cast("double")), F.lit(0.0),
                        lambda a, x: a + x)
    return r.select("id", F.size("values").cast("long").alias("dim"),
                    F.round(total, 6).alias("total"), "category", "title",
                    F.col("metadata.abstract").alias("abstract"))


def q_sparse_roundtrip(spark, sf_dir):
    """TF-IDF vectors written as JSON lines in the sparse shape and read back."""
    docs = read_table(spark, sf_dir, "documents")
    w, _ = FE.corpus_tfidf(docs, "doc_id", "text")
    # the titles are cut before the join, so that no whole text is sent
    titles = docs.select("doc_id", F.col("lang").alias("category"), TX.truncate("text", 60).alias("title"))
    rows = FE.sparse_vectors(w).join(titles, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.col("terms").alias("sparse_indices"),
        F.col("weights").alias("sparse_values"), "category", "title")
    path = _folder(spark, "sparse")
    sinks.write_embeddings(rows, path, "json", compression="gzip")     # numbers as text
    r = SRC.read_sparse_embeddings(spark, path, multi_line=False)
    total = F.aggregate("sparse_values", F.lit(0.0), lambda a, x: a + x)
    return r.select("id", F.size("sparse_indices").cast("long").alias("nnz"),
                    F.round(total, 6).alias("total"), "category", "title")


def _stored_run(spark, sf_dir) -> DataFrame:
    return SRC.embeddings_as_run(read_table(spark, sf_dir, "embeddings"))


def q_run_roundtrip(spark, sf_dir):
    """A run (parameters, metrics, assignments) written and read by its id."""
    a = _stored_run(spark, sf_dir)
    base = _folder(spark, "runs")
    params = spark.range(1).select(F.lit(3).alias("min_cluster_size"), F.lit("eom").alias("method"))
    sinks.write_run("run1", params, metrics.run_metrics(a, id_col="id", truth="label"), a, base)
    sinks.write_run("run2", params, metrics.run_metrics(a.limit(0), id_col="id", truth="label"),
                    a.limit(0), base)
    runs, asg = sinks.read_run(spark, base, "run1")
    head = runs.select("run_id", "min_cluster_size", "method", "n_clusters", "noise_pct")
    return metrics.attach(asg.drop("run_id"), head)


def q_cached_table(spark, sf_dir):
    """A write-once table: computed by the first call, only read by the second."""
    path = _folder(spark, "cache")
    docs = read_table(spark, sf_dir, "documents")
    sinks.cached_or_compute(spark, path, lambda: metrics.contingency(docs, "lang", "source"))

    def never():
        raise AssertionError("computed twice")
    return sinks.cached_or_compute(spark, path, never).select(
        "lang", "source", F.col("n").cast("long").alias("n"))


def q_model_roundtrip(spark, sf_dir):
    """Model tables (core distances, assignments) saved, loaded and joined."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    base = _folder(spark, "model")
    sinks.save_model({"core": density.core_distances(e, 3, id_col="vec_id", vec="embedding"),
                      "assignments": _stored_run(spark, sf_dir)}, base)
    m = sinks.load_model(spark, base)
    return (m["assignments"].join(m["core"], "id")
            .select("id", "cluster", F.round("core", 6).alias("core_distance")))


def q_stored_run_summary(spark, sf_dir):
    """Cluster summary of a stored run that has noise."""
    return RP.cluster_summary(_stored_run(spark, sf_dir))


def q_stored_run_members(spark, sf_dir):
    """Five most confident members of every cluster of a stored run."""
    return RP.top_members(_stored_run(spark, sf_dir), 5)


def q_stored_run_composition(spark, sf_dir):
    """Composition of every cluster of a stored run."""
    return RP.cluster_composition(_stored_run(spark, sf_dir), 5)


def q_stored_run_flags(spark, sf_dir):
    """Display label and low-confidence flag of every row of a stored run."""
    return RP.noise_flags(_stored_run(spark, sf_dir))


def q_stored_run_metrics(spark, sf_dir):
    """The six run metrics of a stored run; noise is left out of silhouette,
    Davies-Bouldin and confidence."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return metrics.run_metrics(_stored_run(spark, sf_dir), e, id_col="id", truth="label",
                               vec="embedding")


def q_run_compare_missing(spark, sf_dir):
    """A stored run beside a run that does not exist."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    m = metrics.run_metrics(_stored_run(spark, sf_dir), e, id_col="id", truth="label", vec="embedding")
    return RP.compare_metrics(m, None, ("run_a", "run_b"))


def q_lookup_report(spark, sf_dir):
    """Lookup of every embedding id in a stored run; ids that are not part of
    it get suggestions."""
    ids = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return RP.lookup_report(ids, _stored_run(spark, sf_dir), 5, 10)


def q_matches_with_clusters(spark, sf_dir):
    """Top-5 neighbours of every embedding with the cluster each one has in a
    stored run, ``?`` where it has none."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nn = knn.self_top_k(e, TOP_K, id_col="vec_id", vec="embedding", metric="cosine")
    return (RP.matches_with_clusters(nn, _stored_run(spark, sf_dir))
            .select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id", "cluster_label",
                    F.round("confidence", 4).alias("confidence")))


def q_named_clusters(spark, sf_dir):
    """Clusters of a stored run under their names; only region keys have one."""
    names = read_table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("int").alias("cluster"), F.col("r_name").alias("name"))
    return RP.named_clusters(_stored_run(spark, sf_dir), names)


def q_dense_sparse_misses(spark, sf_dir):
    """Ids that the dense embeddings and the documents' sparse vectors share,
    and those that only one of them has."""
    w, _ = FE.corpus_tfidf(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    dense = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return RP.id_misses(dense, w.select(F.col("doc_id").alias("id")), "id")


def q_upsert_partial(spark, sf_dir):
    """Keyed upsert where some keys are only old: turns from the third on
    update the first turns; short conversations keep theirs."""
    c = read_table(spark, sf_dir, "conversations")
    existing = c.filter(F.col("turn") == 0).select(F.col("conv_id").alias("id"), "role", "text")
    updates = c.filter(F.col("turn") >= 2).select(
        F.col("conv_id").alias("id"), "role", "text", F.col("turn").alias("batch_no"))
    return ingest.upsert_latest(existing, updates, key="id", batch_col="batch_no")


def q_sweep_best(spark, sf_dir):
    """Stored sweep results: best 30, best 10 with two dimensions, and the
    number of runs with a perfect score."""
    path = _folder(spark, "sweep")
    sinks.write_sweep(SRC.parts_as_sweep(read_table(spark, sf_dir, "part")), path)
    res = spark.read.parquet(path)
    cols = ["grid_pos", "umap_dims", "hdbscan_min_cs", "hdbscan_method", "ari", "silhouette", "noise_pct"]
    top = (SW.best(res, 30).select(F.lit("all").alias("list"), *cols)
           .unionByName(SW.best(res, 10, dims=2).select(F.lit("dims=2").alias("list"), *cols)))
    return metrics.attach(top, SW.perfect_count(res))


_INDEX = {"key": "vec_id", "vec": "embedding", "meta": "label"}


def _stored_index(spark, sf_dir):
    """The embeddings as a stored index that was written with every fourth vector
    reversed and every seventh missing, then corrected by one upsert that also
    brings an older row for each corrected key."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    i = F.col("vec_id")
    base = _folder(spark, "index")
    flipped = F.when(i % 4 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    VI.create_index(e.filter(i % 7 != 0).withColumn("embedding", flipped), base, **_INDEX)
    fix = e.filter((i % 4 == 0) | (i % 7 == 0))
    old = (fix.withColumn("embedding", F.reverse("embedding"))
           .withColumn("label", F.lit(-5).cast(e.schema["label"].dataType)))
    VI.upsert_index(fix.withColumn("batch_no", F.lit(2)).unionByName(old.withColumn("batch_no", F.lit(1))),
                    base, order="batch_no", **_INDEX)
    return base, e


def q_stored_index_rows(spark, sf_dir):
    """All rows of the stored index after its upsert."""
    base, e = _stored_index(spark, sf_dir)
    r = VI.read_index(spark, base, e.schema, meta="label")
    return r.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"),
                    F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"),
                    F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


def q_stored_index_stats(spark, sf_dir):
    """Statistics of the stored index, from its manifest alone."""
    base, _ = _stored_index(spark, sf_dir)
    return VI.index_stats(spark, base).drop("n_versions")


def q_stored_index_search(spark, sf_dir):
    """Top-5 neighbours of every embedding among the stored rows of label 3; only
    buckets that hold the label are opened."""
    base, e = _stored_index(spark, sf_dir)
    nn = VI.search_index(e, base, e.schema, TOP_K, value=3, q_id="vec_id", q_vec="embedding",
                         self_join=True, **_INDEX)
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id",
                     F.round("score", 6).alias("score"))


QUERIES = {f.__name__[2:]: f for f in (
    q_clean_hits, q_unique_hits_total, q_articles_roundtrip, q_articles_array, q_run_results_read, q_dense_roundtrip, q_sparse_roundtrip,
    q_run_roundtrip, q_cached_table, q_model_roundtrip, q_stored_run_summary, q_stored_run_members,
    q_stored_run_composition,    q_stored_run_flags, q_stored_run_metrics, q_run_compare_missing, q_lookup_report,
    q_matches_with_clusters, q_named_clusters, q_dense_sparse_misses, q_upsert_partial, q_sweep_best,
    q_stored_index_rows, q_stored_index_stats, q_stored_index_search)}
