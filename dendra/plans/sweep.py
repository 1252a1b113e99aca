"""Hyper-parameter sweep of reduction + density clustering.

The grid is configuration (576 rows for the reference's ranges).  Runs are
grouped so that work is shared: one layout per reduction key (dims,
neighbours, min_dist), one core-distance / MST / condensed tree per
(reduction, min_cluster_size) - min_samples follows min_cluster_size - and
both selection methods reuse that tree.  Every run is a distributed job; the
driver only walks the grid.  Undefined metrics take the sweep sentinels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendra import schemas
from dendra.operators import density, layout, metrics
from dendra.session import cut_lineage

# The reference's sweep ranges.
UMAP_N_COMPONENTS = [2, 5, 10, 20, 40, 60]
UMAP_N_NEIGHBORS = [3, 5, 10, 15]
UMAP_MIN_DIST = [0.0, 0.05, 0.1]
HDBSCAN_MIN_CLUSTER_SIZE = [3, 5, 8, 10]
HDBSCAN_METHOD = ["eom", "leaf"]


def param_grid(spark: SparkSession, dims=UMAP_N_COMPONENTS, neighbors=UMAP_N_NEIGHBORS,
               min_dists=UMAP_MIN_DIST, min_cs=HDBSCAN_MIN_CLUSTER_SIZE,
               methods=HDBSCAN_METHOD) -> DataFrame:
    """Cartesian grid by successive explodes of literal arrays, with the
    position each combination has in nested-loop order (grid_pos)."""
    def arr(vals, t):
        return F.array(*[F.lit(v).cast(t) for v in vals])
    g = (spark.range(1)
         .select(F.posexplode(arr(dims, "int")).alias("p0", "umap_dims"))
         .select("*", F.posexplode(arr(neighbors, "int")).alias("p1", "umap_neighbors"))
         .select("*", F.posexplode(arr(min_dists, "double")).alias("p2", "umap_min_dist"))
         .select("*", F.posexplode(arr(min_cs, "int")).alias("p3", "hdbscan_min_cs"))
         .select("*", F.posexplode(arr(methods, "string")).alias("p4", "hdbscan_method")))
    n1, n2, n3, n4 = len(neighbors), len(min_dists), len(min_cs), len(methods)
    pos = (((F.col("p0") * n1 + F.col("p1")) * n2 + F.col("p2")) * n3 + F.col("p3")) * n4 + F.col("p4")
    return g.select(pos.cast("long").alias("grid_pos"), "umap_dims", "umap_neighbors",
                    "umap_min_dist", "hdbscan_min_cs", "hdbscan_method")


def _score(assign: DataFrame, pts: DataFrame, truth: DataFrame) -> dict:
    a = assign.join(truth, "id")
    m = metrics.run_metrics(a, pts, id_col="id", cluster="cluster", confidence="confidence",
                            truth="truth", vec="coords", undefined="sweep").first()
    return m.asDict()


def run_sweep(points: DataFrame, truth: DataFrame, grid: DataFrame, *, id_col: str = "id",
              vec: str = "vec", reduce: bool = True, n_epochs: int = 30, seed: int = 42) -> DataFrame:
    """Score every grid row.  ``truth`` is (id, truth).  With ``reduce=False``
    the points are clustered as they are (raw mode) and the reduction columns
    of the grid are carried through unchanged."""
    spark = points.sparkSession
    rows = [r.asDict() for r in grid.orderBy("grid_pos").collect()]   # configuration only
    base = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("coords"))
    tr = truth.select(F.col("id").cast("long").alias("id"), "truth")
    out = []
    reductions = {}
    for r in rows:
        key = (r["umap_dims"], r["umap_neighbors"], r["umap_min_dist"]) if reduce else None
        reductions.setdefault(key, {}).setdefault(r["hdbscan_min_cs"], []).append(r)
    for key, by_mcs in reductions.items():
        if reduce:
            g = layout.fuzzy_graph(base, key[1], id_col="id", vec="coords")
            pts = cut_lineage(layout.layout(base, g, n_components=key[0], min_dist=key[2],
                                            seed=seed, n_epochs=n_epochs, id_col="id", vec="coords"))
        else:
            pts = cut_lineage(base)
        n = pts.count()
        # one neighbour pass per reduction: every core distance and the tree's candidates
        k = max(1, min(max([15, *by_mcs]), n - 1))
        nn = cut_lineage(density.knn_distances(pts, k, id_col="id", vec="coords"))
        for mcs, runs in by_mcs.items():
            ms = max(1, min(mcs, n - 1))
            core = cut_lineage(nn.filter(F.col("rank") == ms).select(
                F.col("i").alias("id"), F.col("d").alias("core")))
            mst = cut_lineage(density.mst_boruvka(pts, core, id_col="id", vec="coords",
                                                  candidates=nn.select("i", "j", "d")))
            tree = density.condensed_tree(mst, pts.select("id"), mcs)
            closed = density.closed_clusters(tree)
            for r in runs:
                sel = (density.select_eom(closed) if r["hdbscan_method"] == "eom"
                       else density.select_leaf(tree))
                ls = density.labels_and_strengths(tree, cut_lineage(sel))
                assign = density.number_clusters(ls)
                assign = pts.select("id").join(assign, "id", "left").select(
                    "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"),
                    F.coalesce("strength", F.lit(0.0)).alias("confidence"))
                m = _score(cut_lineage(assign), pts, tr)
                out.append((r["grid_pos"], r["umap_dims"], r["umap_neighbors"], r["umap_min_dist"],
                            r["hdbscan_min_cs"], r["hdbscan_method"], int(m["n_clusters"]),
                            float(m["noise_pct"]), float(m["silhouette"]),
                            float(m["davies_bouldin"]),
                            float(m["ari"]) if m["ari"] is not None else 0.0,
                            float(m["avg_membership_confidence"])))
    fields = list(schemas.SWEEP_ROW.fields)
    schema = "grid_pos long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return spark.createDataFrame(out, schema)


def rank_sweep(results: DataFrame) -> DataFrame:
    """Order by ARI desc, silhouette desc, noise asc; ties keep grid order."""
    w = Window.orderBy(F.col("ari").desc(), F.col("silhouette").desc(),
                       F.col("noise_pct").asc(), F.col("grid_pos").asc())
    return results.withColumn("sweep_rank", F.row_number().over(w).cast("long"))


def best(results: DataFrame, n: int = 30, dims: int | None = None) -> DataFrame:
    """Top n of the ranking (optionally only rows with the given dims)."""
    r = results if dims is None else results.filter(F.col("umap_dims") == dims)
    return r.orderBy(F.col("ari").desc(), F.col("silhouette").desc(), F.col("noise_pct").asc(),
                     F.col("grid_pos").asc()).limit(n)


def perfect_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("ari") == 1.0).cast("long").alias("perfect"),
                       F.count(F.lit(1)).cast("long").alias("runs"))
