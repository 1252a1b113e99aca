"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole driver tables.  ``__spark_entry__`` only wires these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.session import cut_lineage, read_table
from dendra.functions import text as TX
from dendra.operators import features as FE
from dendra.operators import density, descent, ingest, knn, layout, metrics, predict, vote
from dendra.operators.ordering import consecutive_index
from dendra.sources import tables as SRC
from dendra.plans import reports as RP
from dendra.plans import sweep as SW

# Parameters of the registered queries (the reference's defaults where it
# has one: top-k 5, min_cluster_size 3 with min_samples = min_cluster_size).
TOP_K = 5
MIN_SAMPLES = 3
FILTER_LABEL = 3
TOPIC_TARGET = 10
EMBEDDING_DIM = 64   # dimension of the driver's embeddings table
MIN_CLUSTER_SIZE = 3
EPSILON = 1.2        # selection epsilon for the epsilon query (Euclidean units)
CUT = 1.2            # weight cut for density components
# Layout parameters (the reference's: 40-d reduction with n_neighbors 5,
# min_dist 0.0, cosine, seed 42; 2-d plots with min_dist 0.1).
UMAP_NEIGHBORS = 5
UMAP_COMPONENTS = 40
UMAP_MIN_DIST = 0.0
VIZ_MIN_DIST = 0.1
SEED = 42
EPOCHS = 30


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _r6(c):
    return F.round(F.col(c), 6)


def q_knn_top5(spark, sf_dir):
    """Top-5 cosine neighbours of every embedding, excluding itself."""
    nn = knn.self_top_k(_emb(spark, sf_dir), TOP_K, id_col="vec_id", vec="embedding",
                        metric="cosine")
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id",
                     _r6("score").alias("score"))


def q_knn_filtered(spark, sf_dir):
    """Top-5 per embedding among index rows whose label passes the metadata
    pre-filter (applied before ranking, pushed to the scan)."""
    e = _emb(spark, sf_dir)
    nn = knn.filtered_top_k(e, e, TOP_K, F.col("label") == FILTER_LABEL,
                            q_id="vec_id", i_id="vec_id", q_vec="embedding",
                            i_vec="embedding", metric="cosine", exclude="vec_id")
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id",
                     _r6("score").alias("score"))


def q_knn_vote(spark, sf_dir):
    """Majority vote of the 5 nearest neighbours' labels; ties to the nearest."""
    e = _emb(spark, sf_dir)
    nn = knn.self_top_k(e, TOP_K, id_col="vec_id", vec="embedding", metric="cosine")
    v = vote.majority_vote(nn, e, q_id="vec_id", a_id="vec_id", a_cluster="label",
                           queries=e.select("vec_id"))
    return (e.select("vec_id", "label").join(v, "vec_id")
            .select("vec_id", F.col("label").cast("long").alias("label"),
                    F.col("predicted").cast("long").alias("predicted"),
                    "n_votes", "total_votes", "vote_dist"))


def core_distances(points: DataFrame, min_samples: int, *, id_col: str, vec: str,
                   metric: str = "euclidean") -> DataFrame:
    nn = knn.self_top_k(points, min_samples, id_col=id_col, vec=vec, metric=metric)
    return (nn.filter(F.col("rank") == min_samples)
            .select(id_col, F.col("score").alias("core_distance")))


def q_core_distance(spark, sf_dir):
    """Euclidean distance to the min_samples-th nearest other point."""
    cd = core_distances(_emb(spark, sf_dir), MIN_SAMPLES, id_col="vec_id", vec="embedding")
    return cd.select("vec_id", _r6("core_distance").alias("core_distance"))


def q_mutual_reachability(spark, sf_dir):
    """max(core(a), core(b), d(a, b)) on every kNN-graph edge (k = min_samples)."""
    e = _emb(spark, sf_dir)
    nn = cut_lineage(knn.self_top_k(e, MIN_SAMPLES, id_col="vec_id", vec="embedding",
                                    metric="euclidean"))
    core = (nn.filter(F.col("rank") == MIN_SAMPLES)
            .select("vec_id", F.col("score").alias("core")))
    out = (nn.join(core, "vec_id")
           .join(core.select(F.col("vec_id").alias("nbr_id"), F.col("core").alias("core_nbr")),
                 "nbr_id")
           .select("vec_id", "nbr_id", F.greatest("score", "core", "core_nbr").alias("mrd")))
    return out.select("vec_id", "nbr_id", _r6("mrd").alias("mrd"))


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def q_contingency(spark, sf_dir):
    """Contingency table of documents: language x source."""
    return (metrics.contingency(_docs(spark, sf_dir), "lang", "source")
            .select("lang", "source", F.col("n").cast("long").alias("n")))


def q_ari(spark, sf_dir):
    """Adjusted Rand index between two partitions of documents (lang, source)."""
    return metrics.adjusted_rand(_docs(spark, sf_dir), "lang", "source").select(_r6("ari").alias("ari"))


def q_silhouette(spark, sf_dir):
    """Mean Euclidean silhouette of the embeddings grouped by label."""
    e = _emb(spark, sf_dir)
    return metrics.silhouette(e, id_col="vec_id", vec="embedding", cluster="label").select(
        _r6("silhouette").alias("silhouette"))


def q_davies_bouldin(spark, sf_dir):
    """Davies-Bouldin index of the embeddings grouped by label."""
    e = _emb(spark, sf_dir)
    return metrics.davies_bouldin(e, id_col="vec_id", vec="embedding", cluster="label").select(
        _r6("davies_bouldin").alias("davies_bouldin"))


def q_run_metrics(spark, sf_dir):
    """The six run metrics for a run whose clusters are the kNN-vote
    predictions (confidence = winning votes / k), scored against labels."""
    e = _emb(spark, sf_dir)
    nn = knn.self_top_k(e, TOP_K, id_col="vec_id", vec="embedding", metric="cosine")
    v = vote.majority_vote(nn, e, q_id="vec_id", a_id="vec_id", a_cluster="label",
                           queries=e.select("vec_id"))
    assign = (v.join(e.select("vec_id", "label"), "vec_id")
              .select("vec_id", F.col("predicted").alias("cluster"),
                      (F.col("n_votes") / F.lit(float(TOP_K))).alias("confidence"), "label"))
    return metrics.run_metrics(assign, e, id_col="vec_id", cluster="cluster",
                               confidence="confidence", truth="label", vec="embedding")


def q_dominant_label(spark, sf_dir):
    """Per source: size, dominant language (ties to the first met in doc_id
    order) and the language distribution string."""
    d = _docs(spark, sf_dir)
    return (metrics.label_distribution(d, cluster="source", label="lang", pos="doc_id")
            .select("source", F.col("size").cast("long").alias("size"), "dominant",
                    "distribution", F.col("n_labels").cast("long").alias("n_labels")))


def _hits(spark, sf_dir):
    return SRC.pages_as_hits(read_table(spark, sf_dir, "pages"))


def _valid(spark, sf_dir):
    return ingest.clean_hits(_hits(spark, sf_dir), id_pattern=SRC.PAGES_ID_PATTERN, sources=None)


def _topics(spark, sf_dir):
    return SRC.topics_from_hits(_hits(spark, sf_dir), TOPIC_TARGET)


def q_page_canonical_url(spark, sf_dir):
    """URL without its query string."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", TX.canonical_url("url").alias("url_clean"))


def q_page_id_extract(spark, sf_dir):
    """Numeric ID from the canonical URL; non-matching pages dropped."""
    p = read_table(spark, sf_dir, "pages")
    return (p.select("page_id", TX.extract_id("url", SRC.PAGES_ID_PATTERN).alias("item_id"))
            .filter(F.col("item_id") != ""))


def q_page_text_fallback(spark, sf_dir):
    """Abstract by heading, else description longer than 80 chars, else none."""
    h = _hits(spark, sf_dir)
    return (h.select("page_id", TX.extract_abstract("content", "description").alias("abstract"))
            .filter(F.col("abstract").isNotNull() & (F.col("abstract") != "")))


def q_title_suffix_strip(spark, sf_dir):
    """Title without the site suffix, Python-strip semantics."""
    h = _hits(spark, sf_dir)
    return h.select("page_id", TX.strip_title_suffix("title").alias("title"))


def q_ascii_safe(spark, sf_dir):
    """Titles with every non-ASCII character replaced by '?'."""
    h = _hits(spark, sf_dir)
    return h.select("page_id", TX.ascii_safe(TX.strip_title_suffix("title")).alias("title"))


def q_first_seen_dedup(spark, sf_dir):
    """Global first-seen-wins dedup of valid hits by ID."""
    f = ingest.first_seen(_valid(spark, sf_dir), _topics(spark, sf_dir))
    return f.select("pmid", "page_id", "topic")


def q_topic_quota_after_dedup(spark, sf_dir):
    """Per-topic quota of 10, then cross-topic dedup (topics may end short)."""
    a = ingest.quota_after_dedup(_valid(spark, sf_dir), _topics(spark, sf_dir))
    return a.select("topic", "pmid", "page_id")


def q_topic_quota_before_dedup(spark, sf_dir):
    """Topics filled in order, skipping IDs taken by earlier topics."""
    a = ingest.quota_before_dedup(_valid(spark, sf_dir), _topics(spark, sf_dir))
    return a.select("topic", "pmid", "page_id")


def q_quota_status(spark, sf_dir):
    """Accepted count per topic against its target (dedup-before-quota mode)."""
    topics = _topics(spark, sf_dir)
    a = ingest.quota_before_dedup(_valid(spark, sf_dir), topics)
    return ingest.quota_status(a, topics).select(
        F.col("topic_id").cast("long").alias("topic_id"), "topic", "n", "target", "status")


def q_sample_titles(spark, sf_dir):
    """First two accepted titles per topic, ASCII-safe."""
    a = ingest.quota_before_dedup(_valid(spark, sf_dir), _topics(spark, sf_dir))
    return ingest.sample_titles(a, 2)


def q_dim_check(spark, sf_dir):
    """Embedding dimension check over all rows."""
    return ingest.dim_check(_emb(spark, sf_dir), "embedding", EMBEDDING_DIM)


def _doc_weights(spark, sf_dir):
    return FE.corpus_tfidf(_docs(spark, sf_dir), "doc_id", "text")


def q_tfidf_weights(spark, sf_dir):
    """L2-normalised TF-IDF weight of every (document, term)."""
    w, _ = _doc_weights(spark, sf_dir)
    return FE.entries(w).select("doc_id", "term", "term_id", _r6("weight").alias("weight"))


def q_vocab_index(spark, sf_dir):
    """Corpus vocabulary numbered in term-id order."""
    w, _ = _doc_weights(spark, sf_dir)
    return FE.vocabulary_index(w)


def q_doc_term_triples(spark, sf_dir):
    """Sparse document x column matrix as (doc_id, col, val) triples."""
    w, _ = _doc_weights(spark, sf_dir)
    return FE.doc_term_triples(w, FE.vocabulary_index(w)).select(
        "doc_id", "col", _r6("val").alias("val"))


def q_corpus_sparsity(spark, sf_dir):
    """Documents, vocabulary size, mean non-zeros per document."""
    w, _ = _doc_weights(spark, sf_dir)
    return FE.corpus_sparsity(w)


def _search_inputs(spark, sf_dir, vectors=lambda sparse, id_col: sparse):
    w, dfreq = _doc_weights(spark, sf_dir)
    docs = FE.sparse_vectors(w)
    bench = read_table(spark, sf_dir, "benchmark")
    qw = FE.query_tfidf(bench, "item_id", "text", dfreq)
    qs = FE.sparse_vectors(qw).withColumnRenamed("doc_id", "item_id")
    # the search counts both sides before it joins them: weigh the texts once
    return cut_lineage(vectors(docs, "doc_id")), cut_lineage(vectors(qs, "item_id"))


def q_sparse_top5(spark, sf_dir):
    """Top-5 documents per benchmark text by TF-IDF cosine (sparse dot)."""
    docs, qs = _search_inputs(spark, sf_dir)
    nn = knn.top_k(qs, docs, TOP_K, q_id="item_id", i_id="doc_id", q_vec=None, i_vec=None,
                   q_terms="terms", q_weights="weights", i_terms="terms", i_weights="weights",
                   metric="dot", round_digits=9, out_id="doc_id")
    return nn.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                     _r6("score").alias("score"))


def q_dense_embed(spark, sf_dir):
    """Offline dense embedding (signed projection of TF-IDF) of every document."""
    w, _ = _doc_weights(spark, sf_dir)
    e = FE.dense_embed(FE.sparse_vectors(w), FE.DENSE_DIM)
    return e.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def q_hybrid_top5(spark, sf_dir):
    """Hybrid search: dense dot + sparse dot, unweighted, top-5 per benchmark text."""
    # a document's dense vector is made beside its sparse one, so nothing is joined
    docs, qs = _search_inputs(spark, sf_dir, lambda sparse, id_col: FE.dense_embed(
        sparse, FE.DENSE_DIM, id_col=id_col, keep=True))
    nn = knn.top_k(qs, docs, TOP_K, q_id="item_id", i_id="doc_id", q_vec="embedding",
                   i_vec="embedding", q_terms="terms", q_weights="weights", i_terms="terms",
                   i_weights="weights", metric="hybrid", round_digits=9, out_id="doc_id")
    return nn.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                     _r6("score").alias("score"))


def _doc_points(spark, sf_dir):
    w, _ = _doc_weights(spark, sf_dir)
    return cut_lineage(FE.sparse_vectors(w))    # read by every step of the clustering


def cluster_documents(spark, sf_dir, method="eom", epsilon=0.0):
    """Raw-mode density clustering of documents on TF-IDF cosine distance."""
    pts = _doc_points(spark, sf_dir)
    r = density.hdbscan(pts, id_col="doc_id", vec=None, terms="terms", weights="weights",
                        metric="cosine", min_cluster_size=MIN_CLUSTER_SIZE, method=method,
                        epsilon=epsilon)
    return r


def q_hdbscan_eom(spark, sf_dir):
    """Documents clustered by density (EOM) on TF-IDF cosine, with language."""
    r = cluster_documents(spark, sf_dir, "eom")
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    return (r["assignments"].join(d, "id")
            .select(F.col("id").alias("doc_id"), "cluster",
                    F.round("confidence", 4).alias("confidence"), "lang"))


def _cluster_embeddings(spark, sf_dir, method="eom", epsilon=0.0):
    e = _emb(spark, sf_dir)
    return density.hdbscan(e, id_col="vec_id", vec="embedding", metric="euclidean",
                           min_cluster_size=MIN_CLUSTER_SIZE, method=method, epsilon=epsilon)


def q_hdbscan_leaf(spark, sf_dir):
    """Embeddings clustered by density with leaf selection (Euclidean)."""
    r = _cluster_embeddings(spark, sf_dir, "leaf")
    return r["assignments"].select(F.col("id").alias("vec_id"), "cluster",
                                   F.round("confidence", 4).alias("confidence"))


def q_hdbscan_epsilon(spark, sf_dir):
    """Embeddings clustered by density, EOM with a selection epsilon."""
    r = _cluster_embeddings(spark, sf_dir, "eom", EPSILON)
    return r["assignments"].select(F.col("id").alias("vec_id"), "cluster",
                                   F.round("confidence", 4).alias("confidence"))


def _mst(spark, sf_dir):
    """MST of the mutual-reachability graph of all embeddings (Euclidean,
    min_samples 3); one kNN pass gives core distances (and, for large inputs,
    candidate edges)."""
    e = _emb(spark, sf_dir)
    _, mst = density.core_and_mst(e, MIN_SAMPLES, e.count(), id_col="vec_id", vec="embedding")
    return e, mst


def q_mst_weight(spark, sf_dir):
    """Total weight and edge count of the mutual-reachability MST (Euclidean,
    min_samples 3) of all embeddings."""
    _, mst = _mst(spark, sf_dir)
    return mst.agg(F.round(F.sum("w"), 6).alias("mst_weight"),
                   F.count(F.lit(1)).cast("long").alias("n_edges"))


def q_density_components(spark, sf_dir):
    """Connected components of the mutual-reachability graph below a cut
    (= MST edges under the cut), labelled by their smallest id."""
    e, mst = _mst(spark, sf_dir)
    return density.components_below(mst, e.select(F.col("vec_id").alias("id")), CUT).select(
        F.col("id").alias("vec_id"), "component")


def flagship(spark, sf_dir):
    """documents -> TF-IDF -> kNN core distances -> density clusters ->
    composition of every cluster by language."""
    r = cluster_documents(spark, sf_dir, "eom")
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    a = r["assignments"].join(d, "id")
    return (metrics.label_distribution(a, cluster="cluster", label="lang", pos="id")
            .select("cluster", F.col("size").cast("long").alias("size"), "dominant",
                    "distribution", F.col("n_labels").cast("long").alias("n_labels")))


def vote_run(spark, sf_dir, k=TOP_K):
    """A run whose clusters are kNN-vote predictions over the embeddings:
    (id, cluster, confidence = winning votes / k, label)."""
    e = _emb(spark, sf_dir)
    nn = knn.self_top_k(e, k, id_col="vec_id", vec="embedding", metric="cosine")
    v = vote.majority_vote(nn, e, q_id="vec_id", a_id="vec_id", a_cluster="label",
                           queries=e.select("vec_id"))
    return cut_lineage(
        v.join(e.select("vec_id", "label"), "vec_id")
        .select(F.col("vec_id").alias("id"), F.col("predicted").cast("int").alias("cluster"),
                (F.col("n_votes") / F.lit(float(k))).alias("confidence"), "label"))


def q_cluster_summary(spark, sf_dir):
    """Per cluster: label, size, dominant label and distribution, with the
    run's cluster count, noise share and ARI."""
    return RP.cluster_summary(vote_run(spark, sf_dir))


def q_top_members(spark, sf_dir):
    """Five most confident members of every cluster and how many more."""
    return RP.top_members(vote_run(spark, sf_dir), 5)


def q_paper_lookup(spark, sf_dir):
    """Lookup of every embedding id: cluster, confidence, noise notice,
    cluster size and five most confident peers."""
    a = vote_run(spark, sf_dir)
    return RP.paper_lookup(a.select("id"), a, 5)


def q_lookup_suggestions(spark, sf_dir):
    """First 10 ids in string order."""
    return RP.lookup_suggestions(vote_run(spark, sf_dir), 10)


def q_noise_flags(spark, sf_dir):
    """Display label and low-confidence (< 0.5) flag per assignment."""
    return RP.noise_flags(vote_run(spark, sf_dir))


def q_label_codes(spark, sf_dir):
    """Document languages numbered in sorted order."""
    return RP.label_codes(_docs(spark, sf_dir), "lang")


def q_run_compare(spark, sf_dir):
    """Two runs (kNN vote with k = 5 and k = 3) side by side, plus the ARI
    between them."""
    return RP.run_compare(vote_run(spark, sf_dir, 5), vote_run(spark, sf_dir, 3))


def q_upsert_latest(spark, sf_dir):
    """Keyed upsert: the first turn of every conversation is the existing
    index; every turn is an update batch; the latest batch per key wins."""
    c = read_table(spark, sf_dir, "conversations")
    existing = c.filter(F.col("turn") == 0).select(F.col("conv_id").alias("id"), "role", "text")
    updates = c.select(F.col("conv_id").alias("id"), "role", "text", F.col("turn").alias("batch_no"))
    return ingest.upsert_latest(existing, updates, key="id", batch_col="batch_no")


def q_index_stats(spark, sf_dir):
    """Vector count, dimension range and label count of the embedding index."""
    e = _emb(spark, sf_dir)
    return e.agg(F.count(F.lit(1)).cast("long").alias("n_vectors"),
                 F.min(F.size("embedding")).cast("long").alias("min_dim"),
                 F.max(F.size("embedding")).cast("long").alias("max_dim"),
                 F.count_distinct("label").cast("long").alias("n_labels"))


def q_dense_sparse_join(spark, sf_dir):
    """Dense and sparse vectors of every document joined by id, with the
    count of dense rows lacking a sparse vector (must be 0)."""
    w, _ = _doc_weights(spark, sf_dir)
    # both vectors are read by the join and by the count: weighed and embedded once
    sp = cut_lineage(FE.sparse_vectors(w))
    de = cut_lineage(FE.dense_embed(sp, FE.DENSE_DIM))
    j = de.join(sp, "doc_id")
    missing = de.join(sp, "doc_id", "left_anti").agg(F.count(F.lit(1)).cast("long").alias("n_missing"))
    return metrics.attach(j.select("doc_id", F.size("embedding").cast("long").alias("dim"),
                                    F.size("terms").cast("long").alias("nnz")), missing)


def q_fuzzy_graph(spark, sf_dir):
    """Symmetric fuzzy 5-neighbour graph of the embeddings (cosine)."""
    g = layout.fuzzy_graph(_emb(spark, sf_dir), UMAP_NEIGHBORS, id_col="vec_id", vec="embedding")
    return g.select(F.col("i").alias("vec_id"), F.col("j").alias("nbr_id"), _r6("p").alias("p"))


def _layout(spark, sf_dir, n_components, min_dist):
    e = _emb(spark, sf_dir)
    g = layout.fuzzy_graph(e, UMAP_NEIGHBORS, id_col="vec_id", vec="embedding")
    return layout.layout(e, g, n_components=n_components, min_dist=min_dist, seed=SEED,
                         n_epochs=EPOCHS, id_col="vec_id", vec="embedding")


def q_umap_layout(spark, sf_dir):
    """40-d neighbour-graph layout of the embeddings."""
    pos = _layout(spark, sf_dir, UMAP_COMPONENTS, UMAP_MIN_DIST)
    return pos.select(F.col("id").alias("vec_id"),
                      F.transform("coords", lambda x: F.round(x, 4)).alias("coords"))


def q_plot_points_2d(spark, sf_dir):
    """2-d layout clustered by density, as a plotting table with labels."""
    pos = cut_lineage(_layout(spark, sf_dir, 2, VIZ_MIN_DIST))
    r = density.hdbscan(pos, id_col="id", vec="coords", min_cluster_size=MIN_CLUSTER_SIZE)
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    assign = r["assignments"].join(e, "id")
    return RP.plot_points(pos, assign).select(
        F.col("id").alias("vec_id"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        "cluster", "label", "colour_index")


def _conversation_texts(spark, sf_dir):
    """Every conversation turn as a new text with a consecutive id."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return consecutive_index(c, ["conv_id", "turn"], out="qid")


def q_project_new_points(spark, sf_dir):
    """Conversation turns placed into a 2-d layout of the documents (both
    embedded with the offline dense embedding against the corpus IDF).  One
    row a turn; turns without any corpus term have null coordinates."""
    w, dfreq = _doc_weights(spark, sf_dir)
    docs = FE.dense_embed(FE.sparse_vectors(w), FE.DENSE_DIM)
    conv = _conversation_texts(spark, sf_dir)
    cw = FE.query_tfidf(conv, "qid", "text", dfreq)
    cv = FE.dense_embed(FE.sparse_vectors(cw), FE.DENSE_DIM).withColumnRenamed("doc_id", "qid")
    g = layout.fuzzy_graph(docs, UMAP_NEIGHBORS, id_col="doc_id", vec="embedding")
    pos = layout.layout(docs, g, n_components=2, min_dist=VIZ_MIN_DIST, seed=SEED,
                        n_epochs=EPOCHS, id_col="doc_id", vec="embedding")
    pr = predict.project_new_points(cv, docs, pos, UMAP_NEIGHBORS, new_id="qid",
                                    train_id="doc_id", vec="embedding")
    return (conv.select("qid", "conv_id", "turn").join(pr, "qid", "left")
            .select("conv_id", "turn", F.transform("coords", lambda x: F.round(x, 4)).alias("coords")))


def q_project_start(spark, sf_dir):
    """Every embedding placed at the smooth-kNN weighted mean of its nearest
    other embeddings, whose coordinates are their first two components: where
    the transform into a layout starts."""
    e = _emb(spark, sf_dir)
    at = e.select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("coords"))
    pr = predict.project_start(e, e, at, UMAP_NEIGHBORS, new_id="vec_id", train_id="vec_id", vec="embedding",
                               self_join=True)
    return pr.select("vec_id", F.round(F.col("coords")[0], 6).alias("x"), F.round(F.col("coords")[1], 6).alias("y"))


def q_predict_in_layout(spark, sf_dir):
    """Conversation turns transformed into the documents' fitted 40-d layout
    and assigned by the hierarchy fitted there; turns without any corpus term
    are noise without coordinates."""
    w, dfreq = _doc_weights(spark, sf_dir)
    docs = cut_lineage(FE.dense_embed(FE.sparse_vectors(w), FE.DENSE_DIM))
    g = layout.fuzzy_graph(docs, UMAP_NEIGHBORS, id_col="doc_id", vec="embedding")
    pos = cut_lineage(layout.layout(docs, g, n_components=UMAP_COMPONENTS, min_dist=UMAP_MIN_DIST, seed=SEED,
                                    n_epochs=EPOCHS, id_col="doc_id", vec="embedding"))
    model = density.hdbscan(pos, id_col="id", vec="coords", min_cluster_size=MIN_CLUSTER_SIZE)
    model |= {"layout": pos, "train": docs.select(F.col("doc_id").alias("id"), "embedding")}
    conv = cut_lineage(_conversation_texts(spark, sf_dir))
    cw = FE.query_tfidf(conv, "qid", "text", dfreq)
    cv = FE.dense_embed(FE.sparse_vectors(cw), FE.DENSE_DIM).withColumnRenamed("doc_id", "qid")
    p = predict.predict_in_layout(model, cv, UMAP_NEIGHBORS, MIN_CLUSTER_SIZE, new_id="qid", vec="embedding",
                                  min_dist=UMAP_MIN_DIST, seed=SEED)
    return (conv.select("qid", "conv_id", "turn").join(p, "qid", "left")
            .select("conv_id", "turn", F.coalesce("cluster", F.lit(-1)).alias("cluster"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                    F.transform("coords", lambda x: F.round(x, 4)).alias("coords")))


def q_approximate_predict(spark, sf_dir):
    """Cluster and strength for every conversation turn from the documents'
    fitted density hierarchy (TF-IDF cosine, neighbours among the documents)."""
    w, dfreq = _doc_weights(spark, sf_dir)
    docs = cut_lineage(FE.sparse_vectors(w))
    model = density.hdbscan(docs, id_col="doc_id", vec=None, terms="terms", weights="weights",
                            metric="cosine", min_cluster_size=MIN_CLUSTER_SIZE)
    conv = cut_lineage(_conversation_texts(spark, sf_dir))
    cw = FE.query_tfidf(conv, "qid", "text", dfreq)
    cs = cut_lineage(FE.sparse_vectors(cw).withColumnRenamed("doc_id", "qid"))
    p = predict.approximate_predict(model, cs, docs, MIN_CLUSTER_SIZE, new_id="qid",
                                    train_id="doc_id", vec=None, terms="terms", weights="weights",
                                    metric="cosine")
    return (conv.select("qid", "conv_id", "turn").join(p, "qid", "left")
            .select("conv_id", "turn", F.coalesce("cluster", F.lit(-1)).alias("cluster"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence")))


def q_predict_report(spark, sf_dir):
    """Cluster and strength predicted for each request (a document id or a
    text), the cluster a known id actually has, and the composition of the
    predicted cluster: size, languages by count, five most confident members
    and how many more."""
    w, dfreq = _doc_weights(spark, sf_dir)
    docs = cut_lineage(FE.sparse_vectors(w))
    model = density.hdbscan(docs, id_col="doc_id", vec=None, terms="terms", weights="weights",
                            metric="cosine", min_cluster_size=MIN_CLUSTER_SIZE)
    req = cut_lineage(_resolved(spark, sf_dir))
    qs = cut_lineage(FE.sparse_vectors(FE.query_tfidf(req, "qid", "text", dfreq))
                     .withColumnRenamed("doc_id", "qid"))
    p = predict.approximate_predict(model, qs, docs, MIN_CLUSTER_SIZE, new_id="qid",
                                    train_id="doc_id", vec=None, terms="terms", weights="weights",
                                    metric="cosine")
    lang = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    run = cut_lineage(model["assignments"].join(lang, "id"))
    actual = run.select(F.col("id").alias("exclude_id"), F.col("cluster").alias("actual"))
    comp = RP.cluster_composition(run, 5, label="lang")
    return (req.select("qid", "req_id", "exclude_id").join(p, "qid", "left")
            .withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
            .join(actual, "exclude_id", "left").join(comp, "cluster", "left")
            .select("req_id", F.col("cluster").alias("predicted"), "actual",
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                    "size", "distribution", "top_members", "more"))


def q_sweep_ranked(spark, sf_dir):
    """Density-clustering sweep of the raw embeddings over the reference's
    min_cluster_size x method grid, scored against the labels and ranked."""
    e = _emb(spark, sf_dir)
    grid = SW.param_grid(spark, dims=[None], neighbors=[None], min_dists=[None])
    res = SW.run_sweep(e, e.select(F.col("vec_id").alias("id"), F.col("label").alias("truth")),
                       grid, id_col="vec_id", vec="embedding", reduce=False)
    return SW.rank_sweep(res)


def q_knn_lsh_recall(spark, sf_dir):
    """Recall of the LSH 5-NN graph against the exact one, over all embeddings."""
    e = _emb(spark, sf_dir)
    exact = knn.self_top_k(e, TOP_K, id_col="vec_id", vec="embedding", metric="cosine")
    approx = knn.lsh_top_k(e, TOP_K, id_col="vec_id", vec="embedding")
    hit = exact.join(approx.select("vec_id", "nbr_id"), ["vec_id", "nbr_id"], "left_semi")
    return metrics.attach(
        exact.agg(F.count(F.lit(1)).cast("long").alias("exact_pairs")),
        hit.agg(F.count(F.lit(1)).cast("long").alias("found_pairs"))).select(
        "exact_pairs", "found_pairs",
        F.round(F.col("found_pairs") / F.col("exact_pairs"), 4).alias("recall"))


def _recall(found, exact, key):
    """Share of neighbours found that are as near as the exact ones (of equally
    near ones any will do)."""
    far = exact.groupBy(key).agg(F.min("score").alias("far"))
    hit = found.join(far, key).filter(F.col("score") >= F.col("far") - 1e-9).groupBy().count()
    return exact.groupBy().count().select(
        F.col("count").alias("exact_pairs"),
        F.coalesce(hit.select("count").scalar(), F.lit(0)).alias("found_pairs")).withColumn(
        "recall", F.round(F.col("found_pairs") / F.col("exact_pairs"), 4))


def q_knn_descent_recall(spark, sf_dir):
    """Neighbour descent against the exact 5 nearest, over all embeddings and
    over the dense vectors of all documents: recall, rounds and pairs compared."""
    w, _ = _doc_weights(spark, sf_dir)
    docs = FE.dense_embed(FE.sparse_vectors(w), FE.DENSE_DIM).withColumnRenamed("doc_id", "vec_id")
    out = None
    for name, vecs in (("embeddings", _emb(spark, sf_dir)), ("documents", docs)):
        vecs = cut_lineage(vecs.select("vec_id", "embedding"))
        found, stats = descent.descent_top_k(vecs, TOP_K, id_col="vec_id", vec="embedding")
        exact = knn.self_top_k(vecs, TOP_K, id_col="vec_id", vec="embedding", metric="cosine", round_digits=9)
        row = _recall(found, exact, "vec_id").select(
            F.lit(name).alias("vectors"), "exact_pairs", "found_pairs", "recall",
            F.lit(stats["rounds"]).cast("long").alias("rounds"), F.lit(stats["compared"]).cast("long").alias("compared"))
        out = row if out is None else out.unionByName(row)
    return out


def q_stream_first_seen(spark, sf_dir):
    """Streaming first-seen dedup of page hits (one row per distinct ID)."""
    from dendra.streaming import dedup
    schema = read_table(spark, sf_dir, "pages").schema
    out = dedup.first_seen_stream(spark, SRC.table_glob(sf_dir, "pages"), schema, SRC.pages_as_hits,
                                  id_pattern=SRC.PAGES_ID_PATTERN, sources=None)
    return out.select("pmid")


def q_search_report(spark, sf_dir):
    """Search results as the reference prints them: numbered, score with 4
    decimals, upper-case category, title cut to 60 characters."""
    docs, qs = _search_inputs(spark, sf_dir)
    nn = knn.top_k(qs, docs, TOP_K, q_id="item_id", i_id="doc_id", q_vec=None, i_vec=None,
                   q_terms="terms", q_weights="weights", i_terms="terms", i_weights="weights",
                   metric="dot", round_digits=9, out_id="doc_id")
    d = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    return (nn.join(d, "doc_id")
            .select("item_id", F.col("rank").cast("long").alias("n"), "doc_id",
                    TX.fmt4(F.round("score", 9)).alias("score"),
                    F.upper(TX.default_str("lang")).alias("category"),
                    TX.truncate("text", 60).alias("title")))


def _requests(spark, sf_dir):
    """Requests: every labelled document by id, and every benchmark text."""
    lab = read_table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("req_id"),
        F.col("doc_id").cast("string").alias("input"))
    bench = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("text:"), F.col("item_id").cast("string")).alias("req_id"),
        F.col("text").alias("input"))
    return lab.unionByName(bench)


def _resolved(spark, sf_dir):
    """Requests (qid, req_id, text, exclude_id): a known document id stands for
    its text (and is excluded from its own matches), else the text as given."""
    d = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    req = consecutive_index(_requests(spark, sf_dir), ["req_id"], out="qid")
    return (req.join(d.select(F.col("doc_id").cast("string").alias("input"),
                              F.col("doc_id").alias("exclude_id"), F.col("text").alias("doc_text")),
                     "input", "left")
            .select("qid", "req_id", F.coalesce("doc_text", "input").alias("text"), "exclude_id"))


def q_related_vote(spark, sf_dir):
    """Related documents for each request (a known document id: its text,
    itself excluded; otherwise the text as given), top-5 by TF-IDF cosine,
    and the majority vote of the neighbours' languages."""
    w, dfreq = _doc_weights(spark, sf_dir)
    d = _docs(spark, sf_dir).select("doc_id", "lang")
    # the requests and both vectors are read several times (weights, search, vote)
    docs = cut_lineage(FE.sparse_vectors(w))
    resolved = cut_lineage(_resolved(spark, sf_dir))
    qw = FE.query_tfidf(resolved, "qid", "text", dfreq)
    qs = cut_lineage(FE.sparse_vectors(qw).withColumnRenamed("doc_id", "qid")
                     .join(resolved.select("qid", "exclude_id"), "qid"))
    nn = knn.top_k(qs, docs, TOP_K, q_id="qid", i_id="doc_id", q_vec=None, i_vec=None,
                   q_terms="terms", q_weights="weights", i_terms="terms", i_weights="weights",
                   metric="dot", exclude="exclude_id", round_digits=9, out_id="doc_id")
    v = vote.majority_vote(nn, d.select("doc_id", F.col("lang").alias("cluster")),
                           q_id="qid", nbr_id="doc_id", a_id="doc_id", a_cluster="cluster",
                           queries=resolved.select("qid"))
    return (resolved.select("qid", "req_id").join(v, "qid")
            .select("req_id", F.col("predicted").cast("string").alias("predicted"),
                    "n_votes", "total_votes", "vote_dist"))


def corpus_run(spark, sf_dir, sparse=False):
    """Metrics of one clustering run over the documents.  Dense: embedding ->
    40-d neighbour-graph layout (5 neighbours, min_dist 0.0, cosine, seed 42)
    -> density clusters (min_cluster_size 3, EOM, Euclidean).  Sparse: the
    neighbour graph is that of the TF-IDF vectors; the layout starts from their
    signed projection."""
    w, _ = _doc_weights(spark, sf_dir)
    sp = cut_lineage(FE.sparse_vectors(w))
    de = cut_lineage(FE.dense_embed(sp, FE.DENSE_DIM))
    g = (layout.fuzzy_graph(sp, UMAP_NEIGHBORS, id_col="doc_id", vec=None, terms="terms",
                            weights="weights") if sparse
         else layout.fuzzy_graph(de, UMAP_NEIGHBORS, id_col="doc_id", vec="embedding"))
    pos = cut_lineage(layout.layout(de, g, n_components=UMAP_COMPONENTS, min_dist=UMAP_MIN_DIST,
                                    seed=SEED, n_epochs=EPOCHS, id_col="doc_id", vec="embedding"))
    r = density.hdbscan(pos, id_col="id", vec="coords", min_cluster_size=MIN_CLUSTER_SIZE)
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang")
    a = r["assignments"].join(d, "id")
    return metrics.run_metrics(a, pos, id_col="id", truth="lang", vec="coords")


def q_cluster_corpus(spark, sf_dir):
    """The reference's main run on the documents: dense embedding ->
    40-d neighbour-graph layout (5 neighbours, min_dist 0.0, cosine, seed 42)
    -> density clusters (min_cluster_size 3, EOM, Euclidean) -> the six run
    metrics against the document language."""
    return corpus_run(spark, sf_dir)


def q_run_compare_corpora(spark, sf_dir):
    """The dense and the sparse clustering run of the documents, their six
    metrics side by side."""
    return RP.compare_metrics(cut_lineage(corpus_run(spark, sf_dir)),
                              cut_lineage(corpus_run(spark, sf_dir, sparse=True)),
                              ("dense", "sparse"))


QUERIES = {
    "knn_top5": q_knn_top5,
    "knn_filtered": q_knn_filtered,
    "knn_vote": q_knn_vote,
    "core_distance": q_core_distance,
    "mutual_reachability": q_mutual_reachability,
    "contingency": q_contingency,
    "ari": q_ari,
    "silhouette": q_silhouette,
    "davies_bouldin": q_davies_bouldin,
    "run_metrics": q_run_metrics,
    "dominant_label": q_dominant_label,
    "page_canonical_url": q_page_canonical_url,
    "page_id_extract": q_page_id_extract,
    "page_text_fallback": q_page_text_fallback,
    "title_suffix_strip": q_title_suffix_strip,
    "ascii_safe": q_ascii_safe,
    "first_seen_dedup": q_first_seen_dedup,
    "topic_quota_after_dedup": q_topic_quota_after_dedup,
    "topic_quota_before_dedup": q_topic_quota_before_dedup,
    "quota_status": q_quota_status,
    "sample_titles": q_sample_titles,
    "dim_check": q_dim_check,
    "tfidf_weights": q_tfidf_weights,
    "vocab_index": q_vocab_index,
    "doc_term_triples": q_doc_term_triples,
    "corpus_sparsity": q_corpus_sparsity,
    "sparse_top5": q_sparse_top5,
    "dense_embed": q_dense_embed,
    "hybrid_top5": q_hybrid_top5,
    "hdbscan_eom": q_hdbscan_eom,
    "hdbscan_leaf": q_hdbscan_leaf,
    "hdbscan_epsilon": q_hdbscan_epsilon,
    "mst_weight": q_mst_weight,
    "density_components": q_density_components,
    "cluster_summary": q_cluster_summary,
    "top_members": q_top_members,
    "paper_lookup": q_paper_lookup,
    "lookup_suggestions": q_lookup_suggestions,
    "noise_flags": q_noise_flags,
    "label_codes": q_label_codes,
    "run_compare": q_run_compare,
    "upsert_latest": q_upsert_latest,
    "index_stats": q_index_stats,
    "dense_sparse_join": q_dense_sparse_join,
    "fuzzy_graph": q_fuzzy_graph,
    "umap_layout": q_umap_layout,
    "plot_points_2d": q_plot_points_2d,
    "project_new_points": q_project_new_points,
    "project_start": q_project_start,
    "predict_in_layout": q_predict_in_layout,
    "approximate_predict": q_approximate_predict,
    "predict_report": q_predict_report,
    "sweep_ranked": q_sweep_ranked,
    "knn_lsh_recall": q_knn_lsh_recall,
    "knn_descent_recall": q_knn_descent_recall,
    "stream_first_seen": q_stream_first_seen,
    "search_report": q_search_report,
    "related_vote": q_related_vote,
    "cluster_corpus": q_cluster_corpus,
    "run_compare_corpora": q_run_compare_corpora,
}
