"""Fixed schemas of the data model (search hits, articles, embeddings, runs)."""

from pyspark.sql import types as T

SEARCH_HIT = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("query_no", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("relevance_score", T.DoubleType()),
])

TOPIC = T.StructType([
    T.StructField("topic_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("target", T.IntegerType()),
    T.StructField("queries", T.ArrayType(T.StringType())),
])

ARTICLE = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("relevance_score", T.DoubleType()),
])

DENSE_METADATA = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("relevance_score", T.DoubleType()),
])

DENSE_EMBEDDING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("values", T.ArrayType(T.FloatType())),
    T.StructField("metadata", DENSE_METADATA),
])

SPARSE_EMBEDDING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sparse_indices", T.ArrayType(T.LongType())),
    T.StructField("sparse_values", T.ArrayType(T.DoubleType())),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
])

ASSIGNMENT = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("cluster", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
])

UMAP_PARAMS = T.StructType([
    T.StructField("n_components", T.IntegerType()),
    T.StructField("n_neighbors", T.IntegerType()),
    T.StructField("min_dist", T.DoubleType()),
    T.StructField("metric", T.StringType()),
    T.StructField("random_state", T.IntegerType()),
])

HDBSCAN_PARAMS = T.StructType([
    T.StructField("min_cluster_size", T.IntegerType()),
    T.StructField("min_samples", T.IntegerType()),
    T.StructField("cluster_selection_epsilon", T.DoubleType()),
    T.StructField("cluster_selection_method", T.StringType()),
    T.StructField("metric", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("n_clusters", T.IntegerType()),
    T.StructField("noise_pct", T.DoubleType()),
    T.StructField("silhouette", T.DoubleType()),
    T.StructField("davies_bouldin", T.DoubleType()),
    T.StructField("ari_vs_categories", T.DoubleType()),
    T.StructField("ari_vs_ground_truth", T.DoubleType()),
    T.StructField("avg_membership_confidence", T.DoubleType()),
])

RUN_RESULT = T.StructType([
    T.StructField("embedding_type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("umap_params", UMAP_PARAMS),
    T.StructField("hdbscan_params", HDBSCAN_PARAMS),
    T.StructField("metrics", METRICS),
    T.StructField("assignments", T.ArrayType(T.StructType([
        T.StructField("pmid", T.StringType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("true_cluster", T.IntegerType()),
        T.StructField("cluster_name", T.StringType()),
        T.StructField("title", T.StringType()),
    ]))),
])

SWEEP_ROW = T.StructType([
    T.StructField("umap_dims", T.IntegerType()),
    T.StructField("umap_neighbors", T.IntegerType()),
    T.StructField("umap_min_dist", T.DoubleType()),
    T.StructField("hdbscan_min_cs", T.IntegerType()),
    T.StructField("hdbscan_method", T.StringType()),
    T.StructField("clusters", T.IntegerType()),
    T.StructField("noise_pct", T.DoubleType()),
    T.StructField("silhouette", T.DoubleType()),
    T.StructField("davies_bouldin", T.DoubleType()),
    T.StructField("ari", T.DoubleType()),
    T.StructField("avg_conf", T.DoubleType()),
])
