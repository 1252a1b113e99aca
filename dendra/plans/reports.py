"""Reports over a run's assignment table (id, cluster, confidence, label):
cluster summary, per-paper lookup with ranked peers, top members, flags,
label codes and run comparison.  All are joins, aggregates and bounded
windows: peers come from each cluster's top members (a WindowGroupLimit),
never from a self-join that would emit every pair inside a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.functions import text as TX
from dendra.operators import metrics
from dendra.operators.ordering import consecutive_index


def header_metrics(assign: DataFrame, *, truth: str = "label") -> DataFrame:
    """n_clusters, noise_pct and ARI of a run (one row)."""
    base = assign.agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).cast("long").alias("n_clusters"),
        F.round(F.try_divide(F.lit(100.0) * F.count_if(F.col("cluster") == -1), F.count(F.lit(1))), 1).alias("noise_pct"))
    ari = metrics.adjusted_rand(assign, truth, "cluster").select(F.round("ari", 4).alias("ari"))
    return metrics.attach(base, ari)


def cluster_summary(assign: DataFrame, *, pos: str = "id", label: str = "label") -> DataFrame:
    """One row per cluster: display label, size, dominant label, distribution,
    plus the run's header metrics."""
    dist = metrics.label_distribution(assign, cluster="cluster", label=label, pos=pos)
    head = header_metrics(assign, truth=label)
    return (metrics.attach(dist, head)
            .select("cluster", TX.cluster_label("cluster").alias("cluster_label"),
                    F.col("size").cast("long").alias("size"), "dominant", "distribution",
                    "n_clusters", "noise_pct", "ari"))


def top_members(assign: DataFrame, n: int = 5, *, id_col: str = "id") -> DataFrame:
    """Per non-noise cluster: the n most confident members (ties by id) and
    how many more there are."""
    a = assign.filter(F.col("cluster") != -1)
    w = Window.partitionBy("cluster").orderBy(F.col("confidence").desc(), F.col(id_col).asc())
    top = a.withColumn("member_rank", F.row_number().over(w)).filter(F.col("member_rank") <= n)
    sizes = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return (top.join(sizes, "cluster")
            .select("cluster", F.col("member_rank").cast("long").alias("member_rank"), id_col,
                    F.round("confidence", 4).alias("confidence"),
                    F.greatest(F.col("size") - F.lit(n), F.lit(0)).cast("long").alias("more")))


def paper_lookup(requests: DataFrame, assign: DataFrame, peers: int = 5, *,
                 req_id: str = "id", id_col: str = "id") -> DataFrame:
    """For a table of requested IDs: found flag, own cluster and confidence,
    noise notice, cluster size and the ``peers`` most confident other members
    (id list, confidence descending).  Noise papers get no peers."""
    a = assign.select(F.col(id_col).alias("_id"), "cluster", "confidence")
    req = requests.select(F.col(req_id).alias("_id")).distinct()
    sizes = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    w = Window.partitionBy("cluster").orderBy(F.col("confidence").desc(), F.col("_id").asc())
    # peers + 1 per cluster is enough: at most one of them is the paper itself
    cand = (a.filter(F.col("cluster") != -1).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= peers + 1)
            .select("cluster", F.col("_id").alias("_pid"), F.col("confidence").alias("_pc"), "_r"))
    found = req.join(a, "_id", "left")
    with_peers = (found.join(cand, "cluster", "left")
                  .filter(F.col("_pid").isNull() | (F.col("_pid") != F.col("_id")))
                  .groupBy("_id")
                  .agg(F.slice(F.array_sort(F.collect_list(
                      F.when(F.col("_pid").isNotNull(), F.struct("_r", "_pid")))), 1, peers)
                       .alias("_pl")))
    return (found.join(sizes, "cluster", "left").join(with_peers, "_id", "left")
            .select(F.col("_id").alias(req_id), F.col("cluster").isNotNull().alias("found"),
                    "cluster", F.round("confidence", 4).alias("confidence"),
                    (F.col("cluster") == -1).alias("is_noise"),
                    F.col("cluster_size").cast("long").alias("cluster_size"),
                    F.when(F.col("cluster") == -1, F.array().cast("array<long>"))
                    .otherwise(F.coalesce(F.col("_pl._pid"), F.array().cast("array<long>")))
                    .alias("peers")))


def lookup_suggestions(assign: DataFrame, n: int = 10, *, id_col: str = "id") -> DataFrame:
    """The first n IDs in string order (shown when a requested ID is missing)."""
    s = F.col(id_col).cast("string")
    return (assign.select(s.alias("suggestion")).orderBy("suggestion").limit(n)
            .withColumn("pos", F.row_number().over(Window.orderBy("suggestion")).cast("long")))


def noise_flags(assign: DataFrame, *, id_col: str = "id", low: float = TX.LOW_CONFIDENCE) -> DataFrame:
    """Display label and low-confidence flag per row."""
    return assign.select(id_col, "cluster", TX.cluster_label("cluster").alias("cluster_label"),
                         F.round("confidence", 4).alias("confidence"),
                         (F.col("confidence") < low).alias("low_confidence"))


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels -> 0-based integer codes."""
    d = df.select(F.col(label).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return consecutive_index(d, ["label"], out="code")


def run_compare(a: DataFrame, b: DataFrame, *, truth: str = "label", id_col: str = "id",
                names=("run_a", "run_b")) -> DataFrame:
    """Metrics of two runs side by side as (metric, run_a, run_b); a missing
    run gives NULLs.  Adds the ARI between the two runs' assignments."""
    def one(x):
        return x.agg(
            F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).cast("double").alias("n_clusters"),
            F.round(F.try_divide(F.lit(100.0) * F.count_if(F.col("cluster") == -1), F.count(F.lit(1))), 1).alias("noise_pct"),
            F.round(F.avg(F.when(F.col("cluster") != -1, F.col("confidence"))), 4).alias("avg_conf"))
    ma = metrics.attach(one(a), metrics.adjusted_rand(a, truth, "cluster").select(F.round("ari", 4).alias("ari")))
    mb = metrics.attach(one(b), metrics.adjusted_rand(b, truth, "cluster").select(F.round("ari", 4).alias("ari")))
    stack = "stack(4, 'n_clusters', n_clusters, 'noise_pct', noise_pct, 'ari', ari, 'avg_conf', avg_conf) as (metric, v)"
    ua = ma.selectExpr(stack).withColumnRenamed("v", names[0])
    ub = mb.selectExpr(stack).withColumnRenamed("v", names[1])
    both = (a.select(id_col, F.col("cluster").alias("ca"))
            .join(b.select(id_col, F.col("cluster").alias("cb")), id_col))
    cross = metrics.adjusted_rand(both, "ca", "cb").select(
        F.lit("ari_between_runs").alias("metric"), F.round("ari", 4).alias(names[0]),
        F.round("ari", 4).alias(names[1]))
    return ua.join(ub, "metric", "full_outer").unionByName(cross)


def compare_metrics(a: DataFrame, b: DataFrame | None, names=("run_a", "run_b")) -> DataFrame:
    """Two ``run_metrics`` rows side by side as (metric, run_a, run_b); a
    missing run (``b=None``) gives nulls."""
    cols = ["n_clusters", "noise_pct", "silhouette", "davies_bouldin", "ari",
            "avg_membership_confidence"]

    def long(x, name):
        return x.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in cols])))
    left = long(a, names[0])
    if b is None:
        return left.withColumn(names[1], F.lit(None).cast("double"))
    return left.join(long(b, names[1]), "metric", "full_outer")


def lookup_report(requests: DataFrame, assign: DataFrame, peers: int = 5, suggestions: int = 10, *,
                  req_id: str = "id", id_col: str = "id") -> DataFrame:
    """``paper_lookup`` with the first IDs (string order) as suggestions on the
    rows whose ID is unknown (empty otherwise)."""
    s = lookup_suggestions(assign, suggestions, id_col=id_col)
    first = s.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "suggestion"))),
                              lambda x: x["suggestion"]).alias("suggestions"))   # at most `suggestions`
    r = metrics.attach(paper_lookup(requests, assign, peers, req_id=req_id, id_col=id_col), first)
    return r.withColumn("suggestions", F.when(F.col("found"), F.array().cast("array<string>"))
                        .otherwise(F.col("suggestions")))


def matches_with_clusters(matches: DataFrame, assign: DataFrame, *, match_id: str = "nbr_id",
                          id_col: str = "id") -> DataFrame:
    """Search matches with the cluster label of each match; ``?`` for matches
    that are not part of the run."""
    a = assign.select(F.col(id_col).alias(match_id), "cluster", "confidence")
    return (matches.join(a, match_id, "left")
            .withColumn("cluster_label", TX.cluster_label("cluster")))


def cluster_composition(assign: DataFrame, n: int = 5, *, id_col: str = "id",
                        label: str = "label") -> DataFrame:
    """One row per non-noise cluster: size, labels by count, the ``n`` most
    confident members and how many more there are."""
    a = assign.filter(F.col("cluster") != -1)
    dist = metrics.label_distribution(a, cluster="cluster", label=label, pos=id_col)
    # at most n rows per cluster
    top = (top_members(a, n, id_col=id_col).groupBy("cluster")
           .agg(F.array_sort(F.collect_list(F.struct("member_rank", F.col(id_col).alias("m"))))
                .alias("_t"), F.max("more").alias("more")))
    return (dist.join(top, "cluster")
            .select("cluster", F.col("size").cast("long").alias("size"), "dominant", "distribution",
                    F.col("_t.m").alias("top_members"), "more"))


def named_clusters(assign: DataFrame, names: DataFrame) -> DataFrame:
    """Size of every non-noise cluster under its display name; ``names`` is
    (cluster, name), clusters without a name read ``Cluster <n>``."""
    sizes = (assign.filter(F.col("cluster") != -1).groupBy("cluster")
             .agg(F.count(F.lit(1)).alias("size")))
    return (sizes.join(names.select("cluster", "name"), "cluster", "left")
            .select("cluster", TX.display_name("name", "cluster").alias("name"), "size"))


def id_misses(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of both tables, of ``a`` only and of ``b`` only."""
    j = (a.select(key).distinct().withColumn("_a", F.lit(1))
         .join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer"))
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
                 F.count_if(F.col("_b").isNull()).alias("n_only_a"),
                 F.count_if(F.col("_a").isNull()).alias("n_only_b"))


def plot_points(coords: DataFrame, assign: DataFrame, *, id_col: str = "id",
                palette: int = 10) -> DataFrame:
    """2-D point table for plotting: x, y, cluster, label and colour index."""
    return (coords.join(assign, id_col)
            .select(id_col, F.element_at("coords", 1).alias("x"), F.element_at("coords", 2).alias("y"),
                    "cluster", "label",
                    F.when(F.col("cluster") == -1, F.lit(-1))
                    .otherwise(F.pmod(F.col("cluster"), F.lit(palette))).alias("colour_index")))
