"""Clustering quality metrics as aggregations.

ARI comes from one ``cube`` over (truth, predicted): partial aggregation
makes a label holding a third of all rows cost nothing extra.  Silhouette
and Davies–Bouldin need distances between points (or centroids); they run
as bounded block products and aggregate per (point, cluster) - no pair table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.functions import vectors as V
from dendra.functions.text import HEALTHY_NOISE_PCT
from dendra.operators.knn import DEFAULT_BLOCK_ROWS, DENSE_PAIRS, block_pairs, deal, dense_size, plan_blocks
from dendra.operators.ordering import consecutive_index
from dendra.session import cut_lineage

# Sweep sentinels when a metric is undefined.
SWEEP_SIL_UNDEFINED = 0.0
SWEEP_DB_UNDEFINED = 99.0
SWEEP_CONF_UNDEFINED = 0.0


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: sum of squared cell, row and column counts and N."""
    g = (df.select(F.col(truth).alias("_t"), F.col(pred).alias("_p"))
         .cube("_t", "_p").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))
    n2 = F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")   # exact
    return g.agg(
        F.sum(F.when(F.col("gid") == 0, n2)).alias("sum_cells"),
        F.sum(F.when(F.col("gid") == 1, n2)).alias("sum_rows"),
        F.sum(F.when(F.col("gid") == 2, n2)).alias("sum_cols"),
        F.max(F.when(F.col("gid") == 3, F.col("n"))).cast("decimal(19,0)").alias("n_total"))


def ari_column(sum_cells="sum_cells", sum_rows="sum_rows", sum_cols="sum_cols",
               n_total="n_total"):
    """Adjusted Rand index from pair counts (pair-confusion form); 1.0 when
    the two partitions agree on every pair."""
    sc, sr, sk, n = (F.col(sum_cells), F.col(sum_rows), F.col(sum_cols), F.col(n_total))
    same = (sr == sc) & (sk == sc)
    tp, fp, fn, tn = (x.cast("double") for x in (
        sc - n, sk - sc, sr - sc, n * n - (sk - sc) - (sr - sc) - sc))
    den = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    return (F.when(same, F.lit(1.0))
             .otherwise(F.lit(2.0) * (tp * tn - fn * fp) / den))


def adjusted_rand(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """ARI over all rows; noise (-1) counts as an ordinary cluster."""
    return pair_counts(df, truth, pred).select(ari_column().alias("ari"))


# Stands for no cluster in the block sums of the silhouette.
_NO_CLUSTER = -(1 << 62)


def silhouette_samples(points: DataFrame, *, id_col: str, vec: str, cluster: str,
                       block_rows: int | None = None,
                       n_rows: int | None = None) -> DataFrame:
    """Per-point silhouette with Euclidean distance (noise rows must already
    be removed).  Singleton clusters and a = b = 0 give 0.

    The points on the right are blocked in cluster order, so a cluster lies
    whole in one block or at the edges of its neighbours.  A block task returns
    per left point the least mean distance to the whole clusters in it, and
    distance sums only of the point's own cluster and of clusters cut by the
    block's edges: at most four rows per point and block, however many
    clusters there are.  Rows sent grow with the number of blocks, so blocks are
    those of the dense search, compared tile by tile."""
    p = points.select(F.col(id_col).alias("pid"), V.as_double(vec).alias("v"),
                      F.col(cluster).cast("long").alias("c"))
    n = n_rows
    if n is None or block_rows is None:
        n, rows = dense_size(p, "v")
        block_rows = block_rows or rows
    b, b2 = plan_blocks(points.sparkSession, n, n, block_rows, DENSE_PAIRS)
    pid_t = points.schema[id_col].dataType
    schema = T.StructType([T.StructField("pid", pid_t), T.StructField("own", T.LongType()),
                           T.StructField("oc", T.LongType()), T.StructField("dsum", T.DoubleType()),
                           T.StructField("least", T.DoubleType())])

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"pid": lp["pid"].iloc[:0], "own": np.zeros(0, np.int64),
                                 "oc": np.zeros(0, np.int64), "dsum": np.zeros(0),
                                 "least": np.zeros(0)})
        rp = rp.sort_values("idx", kind="stable")
        cs, starts, counts = np.unique(rp["c"].to_numpy(), return_index=True, return_counts=True)
        whole = counts == rp["sz"].to_numpy()[starts]
        cut = np.flatnonzero(~whole)
        pid, own = lp["pid"].to_numpy(), lp["c"].to_numpy()
        at = np.minimum(np.searchsorted(cs, own), len(cs) - 1)
        parts = []
        L, R = V.stack(lp["v"]), V.stack(rp["v"])

        def finish(first, sums):
            i = np.arange(first, first + len(sums))
            mine = cs[at[i]] == own[i]
            # the point's own cluster, if it is whole here, and the clusters cut by an edge
            r = np.flatnonzero(mine & whole[at[i]])
            r, c = np.append(r, np.repeat(i - first, len(cut))), np.append(at[i][r], np.tile(cut, len(i)))
            parts.append(pd.DataFrame({"pid": pid[r + first], "own": own[r + first], "oc": cs[c],
                                       "dsum": sums[r, c], "least": np.inf}))
            sums /= counts
            sums[:, cut] = np.inf
            sums[np.flatnonzero(mine), at[i][mine]] = np.inf
            least = sums.min(axis=1)
            r = np.flatnonzero(np.isfinite(least))
            parts.append(pd.DataFrame({"pid": pid[r + first], "own": own[r + first], "oc": _NO_CLUSTER,
                                       "dsum": 0.0, "least": least[r]}))

        for first, col, D in V.distance_tiles(L, R):
            if col == 0:
                sums = np.zeros((len(D), len(cs)))
            here = np.searchsorted(starts, col, side="right") - 1, np.searchsorted(starts, col + D.shape[1])
            sums[:, slice(*here)] += np.add.reduceat(D, np.maximum(starts[slice(*here)] - col, 0), axis=1)
            if col + D.shape[1] == len(R):
                finish(first, sums)
        return pd.concat(parts, ignore_index=True)

    sizes = cut_lineage(p.groupBy("c").agg(F.count(F.lit(1)).alias("sz")))
    rows = max(1, math.ceil(n / b2))
    left = (p.withColumn("lb", F.pmod(F.xxhash64("pid"), F.lit(b)).cast("int"))
            .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(b2 - 1)))))
    right = (consecutive_index(p.join(sizes, "c"), ["c", "pid"])
             .withColumn("rb", F.floor(F.col("idx") / rows).cast("int"))
             .withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))))
    left, right = deal(left, b * b2), deal(right, b * b2)
    sums = (left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(kernel, schema)
            .groupBy("pid", "own", "oc").agg(F.sum("dsum").alias("dsum"), F.min("least").alias("least")))
    is_own, no_cluster = F.col("oc") == F.col("own"), F.col("oc") == _NO_CLUSTER
    means = (sums.join(sizes.withColumnRenamed("c", "oc"), "oc", "left")
             .withColumn("a", F.when(is_own & (F.col("sz") > 1), F.col("dsum") / (F.col("sz") - 1)))
             .withColumn("b", F.when(no_cluster, F.col("least"))
                         .when(~is_own, F.col("dsum") / F.col("sz"))))
    per = (means.groupBy("pid", "own")
           .agg(F.max("a").alias("a"), F.min("b").alias("b"),
                F.max(F.when(is_own, F.col("sz"))).alias("own_size")))
    s = (F.when((F.col("own_size") <= 1) | F.col("b").isNull(), F.lit(0.0))
          .when(F.greatest("a", "b") == 0, F.lit(0.0))
          .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
    return per.select(F.col("pid").alias(id_col), F.col("own").alias(cluster), s.alias("silhouette"))


def silhouette(points: DataFrame, **kw) -> DataFrame:
    return silhouette_samples(points, **kw).agg(F.avg("silhouette").alias("silhouette"))


def centroids(points: DataFrame, *, vec: str, cluster: str) -> DataFrame:
    """Element-wise mean vector per cluster (JVM Summarizer, no explode)."""
    return (points.select(F.col(cluster).alias("c"), array_to_vector(V.as_double(vec)).alias("_v"))
            .groupBy("c").agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select("c", vector_to_array("_m").alias("centroid")))


def davies_bouldin(points: DataFrame, *, id_col: str, vec: str, cluster: str,
                   block_rows: int | None = None) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j); zero centroid
    distance counts as infinite; 0.0 when all scatters or all centroid
    distances are (close to) zero."""
    cen = centroids(points, vec=vec, cluster=cluster)
    scat = (points.select(F.col(cluster).alias("c"), V.as_double(vec).alias("v"))
            .join(cen, "c")
            .groupBy("c").agg(F.avg(V.euclidean("v", "centroid")).alias("s")))
    cs = cut_lineage(cen.join(scat, "c"))
    k = cs.count()
    b = max(1, math.ceil(k / (block_rows or DEFAULT_BLOCK_ROWS)))
    schema = "c long, r double, dmax double"

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"c": np.zeros(0, np.int64), "r": np.zeros(0), "dmax": np.zeros(0)})
        D = V.dense_scores(V.stack(lp["centroid"]), V.stack(rp["centroid"]), "euclidean")
        num = lp["s"].to_numpy()[:, None] + rp["s"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            R = np.where(D == 0, 0.0, num / np.where(D == 0, 1.0, D))
        return pd.DataFrame({"c": lp["c"].to_numpy().astype(np.int64), "r": R.max(axis=1),
                             "dmax": D.max(axis=1)})

    left = cs.select(F.col("c").cast("long").alias("c"), "centroid", "s")
    per = (block_pairs(left, left, "c", "c", b, b).applyInPandas(kernel, schema)
           .groupBy("c").agg(F.max("r").alias("r"), F.max("dmax").alias("dmax")))
    out = per.join(left.select("c", "s"), "c").agg(
        F.avg("r").alias("db"), F.max(F.abs("s")).alias("max_s"), F.max("dmax").alias("max_d"))
    tol = 1e-8
    return out.select(F.when((F.col("max_s") <= tol) | (F.col("max_d") <= tol), F.lit(0.0))
                      .otherwise(F.col("db")).alias("davies_bouldin"))


def run_metrics(assign: DataFrame, points: DataFrame | None = None, *,
                id_col: str, cluster: str = "cluster", confidence: str = "confidence",
                truth: str | None = None, vec: str | None = None,
                undefined: str = "null", block_rows: int | None = None) -> DataFrame:
    """The reference's six run metrics in one row.

    n_clusters (noise excluded), noise_pct (1 decimal), silhouette and
    Davies–Bouldin on non-noise points when n_clusters >= 2 and non-noise
    points > n_clusters, ARI over all rows including noise, mean confidence
    of non-noise rows.  ``undefined='null'`` leaves undefined metrics NULL
    (single runs); ``'sweep'`` uses the sweep sentinels 0.0 / 99.0 / 0.0.
    All are rounded to 4 decimals after aggregation."""
    # read by every metric: computed once
    assign = cut_lineage(assign.select(
        *dict.fromkeys(c for c in (id_col, cluster, confidence, truth) if c)))
    base = assign.agg(
        F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("n_clusters"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(cluster) == -1).alias("n_noise"),
        F.avg(F.when(F.col(cluster) != -1, F.col(confidence))).alias("avg_conf_raw"),
        F.count_if(F.col(confidence) < 0.5).alias("n_low_confidence"))
    row = base
    if truth is not None:
        row = attach(row, adjusted_rand(assign, truth, cluster).withColumnRenamed("ari", "ari_raw"))
    else:
        row = row.withColumn("ari_raw", F.lit(None).cast("double"))
    if points is not None and vec is not None:
        non_noise = cut_lineage(assign.filter(F.col(cluster) != -1).select(id_col, cluster)
                                .join(points.select(id_col, vec), id_col))
        sil = silhouette(non_noise, id_col=id_col, vec=vec, cluster=cluster, block_rows=block_rows)
        db = davies_bouldin(non_noise, id_col=id_col, vec=vec, cluster=cluster, block_rows=block_rows)
        row = attach(attach(row, sil.withColumnRenamed("silhouette", "sil_raw")),
                      db.withColumnRenamed("davies_bouldin", "db_raw"))
    else:
        row = row.withColumn("sil_raw", F.lit(None).cast("double")).withColumn(
            "db_raw", F.lit(None).cast("double"))
    defined = (F.col("n_clusters") >= 2) & ((F.col("n_rows") - F.col("n_noise")) > F.col("n_clusters"))
    sil_c = F.when(defined, F.round("sil_raw", 4))
    db_c = F.when(defined, F.round("db_raw", 4))
    conf_c = F.round("avg_conf_raw", 4)
    if undefined == "sweep":
        sil_c = F.coalesce(sil_c, F.lit(SWEEP_SIL_UNDEFINED))
        db_c = F.coalesce(db_c, F.lit(SWEEP_DB_UNDEFINED))
        conf_c = F.coalesce(conf_c, F.lit(SWEEP_CONF_UNDEFINED))
    noise_pct = F.round(F.try_divide(F.lit(100.0) * F.col("n_noise"), F.col("n_rows")), 1)   # no rows: null
    return row.select(
        F.col("n_clusters").cast("long").alias("n_clusters"),
        noise_pct.alias("noise_pct"),
        sil_c.alias("silhouette"), db_c.alias("davies_bouldin"),
        F.round("ari_raw", 4).alias("ari"), conf_c.alias("avg_membership_confidence"),
        F.col("n_low_confidence").cast("long").alias("n_low_confidence"),
        (noise_pct < HEALTHY_NOISE_PCT).alias("noise_healthy"))


def attach(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a single-row table to every row, as a scalar subquery
    (no join; more than one row is an error)."""
    one = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return (rows.withColumn("_one", one)
            .select(*[F.col(c) for c in rows.columns],
                    *[F.col("_one")[c].alias(c) for c in one_row.columns]))


def label_distribution(df: DataFrame, *, cluster: str, label: str, pos: str) -> DataFrame:
    """Per cluster: size, dominant label (max count, tie to the label met
    first in row order ``pos``) and the distribution string
    ``label(n), ...`` ordered by count desc then first appearance."""
    cnt = (df.groupBy(cluster, label)
           .agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos")))
    w = Window.partitionBy(cluster).orderBy(F.col("n").desc(), F.col("first_pos").asc())
    ranked = cnt.withColumn("_o", F.row_number().over(w))
    return (ranked.groupBy(cluster)
            .agg(F.sum("n").alias("size"),
                 F.max(F.when(F.col("_o") == 1, F.col(label))).alias("dominant"),
                 F.array_join(F.transform(
                     F.array_sort(F.collect_list(F.struct("_o", label, "n"))),
                     lambda s: F.format_string("%s(%d)", s[label], s["n"])), ", ").alias("distribution"),
                 F.count(F.lit(1)).alias("n_labels")))
