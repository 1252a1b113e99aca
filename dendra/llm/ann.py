"""Approximate nearest neighbours on low-dimensional stable projections.

Vectors are projected on a few Gaussian directions; for a pair at distance d
the squared projected distance over d^2 follows a chi-square law.  Each shard
of vectors keeps a kd-tree over its projections.  A query visits the leaves in
order of projected distance and verifies the vectors it meets in full.  It
stops when a neighbour closer than the k-th best so far would, by the
chi-square law, have shown up already with probability ``CONFIDENCE``.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.session import cut_lineage

# Projected dimensions (even: the chi-square law then has a closed form).
DIMS = 8
CONFIDENCE = 0.98
LEAF = 64
# Vectors a shard and queries a block (bounded memory of a task).
SHARD_ROWS, QUERY_BLOCK = 8192, 1024


def chi2_cdf(x: float, dims: int) -> float:
    """P(chi-square with an even number ``dims`` of degrees <= x)."""
    if x > 700:
        return 1.0
    term, total = 1.0, 1.0
    for j in range(1, dims // 2):
        term *= x / 2 / j
        total += term
    return 1.0 - math.exp(-x / 2) * total


def build_tree(p: np.ndarray, leaf: int = LEAF) -> list[tuple]:
    """kd-tree over the rows of ``p``: nodes (low, high, rows | None, children)."""
    nodes: list = []

    def add(rows: np.ndarray) -> int:
        low, high = p[rows].min(0), p[rows].max(0)
        nodes.append(None)
        me, axis = len(nodes) - 1, int((high - low).argmax())
        if len(rows) <= leaf or low[axis] == high[axis]:
            nodes[me] = (low, high, rows, ())
        else:
            half = len(rows) // 2
            rows = rows[np.argpartition(p[rows, axis], half)]
            nodes[me] = (low, high, None, (add(rows[:half]), add(rows[half:])))
        return me

    add(np.arange(len(p)))
    return nodes


def search(tree, vecs, ids, proj, q, qid, qp, k: int, confidence: float):
    """The query's k best (distance, id) among the shard's vectors, each id
    once."""
    def gap(n):
        low, high = tree[n][:2]
        return float((np.maximum(0, np.maximum(low - qp, qp - high)) ** 2).sum())

    heap = [(gap(0), 0)]
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    wait_d, wait_r = np.empty(0), np.empty(0, np.int64)     # met, but not yet nearest
    while heap or len(wait_r):
        while heap and tree[heap[0][1]][2] is None:
            _, n = heapq.heappop(heap)
            for c in tree[n][3]:
                heapq.heappush(heap, (gap(c), c))
        if heap:
            _, n = heapq.heappop(heap)
            rows = tree[n][2]
            wait_d = np.concatenate([wait_d, ((proj[rows] - qp) ** 2).sum(1)])
            wait_r = np.concatenate([wait_r, rows])
        front = heap[0][0] if heap else math.inf
        ready = wait_d <= front
        rows, wait_d, wait_r = wait_r[ready], wait_d[~ready], wait_r[~ready]
        rows = rows[ids[rows] != qid]
        if len(rows):
            diff = vecs[rows] - q
            best_d = np.concatenate([best_d, np.sqrt((diff * diff).sum(1))])
            best_i = np.concatenate([best_i, ids[rows]])
            o = np.lexsort((best_i, best_d))
            best_d, best_i = best_d[o], best_i[o]
            # one place for each id
            o = np.sort(np.unique(best_i, return_index=True)[1])[:k]
            best_d, best_i = best_d[o], best_i[o]
        if len(best_d) == k and front < math.inf:
            kth = best_d[-1] ** 2
            if kth == 0 and front > 0 or kth > 0 and chi2_cdf(front / kth, qp.size) >= confidence:
                break
    return best_d, best_i


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with vectors as doubles; null, empty and zero vectors and
    those with null or non-finite components are left out."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter(F.coalesce(ok, F.lit(False)) & F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, query_every: int = 100, k: int = 10, dims: int = DIMS,
            confidence: float = CONFIDENCE, id_col: str = "vec_id",
            vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by Euclidean distance
    of every row whose id is divisible by ``query_every``, among all other
    rows; ties go to the smaller id; fewer rows if there are fewer candidates.

    Rows with an unusable vector take no part (see ``usable``).  Repeated rows
    (same id and vector) count as one.  An id with several vectors is one
    candidate, at the smallest of their distances from any of the query's
    vectors; a query's own id never is one.  A vector is only compared with
    vectors of its own length.  An empty table gives an empty result.

    Scale: every vector is indexed, in shards of about ``SHARD_ROWS`` by a hash
    of the id; the stated query set meets every shard in blocks of
    ``QUERY_BLOCK`` queries, and each meeting leaves at most ``k`` rows a
    query vector.  Repeated rows are folded by a shuffle of the vectors.  Projection directions follow from ``seed`` alone."""
    rows = cut_lineage(usable(vectors, id_col, vec_col).distinct()
                       .withColumn("n_dim", F.size("v")))
    n = rows.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    blocks = max(1, math.ceil(n / query_every / QUERY_BLOCK))
    shard_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = rows.withColumn("shard", shard_of).withColumn("block", every(blocks))
    asked = (rows.filter(F.col("vec_id") % query_every == 0)
             .withColumn("block", block_of).withColumn("shard", every(shards)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, qs in right.groupby("n_dim"):
            own = left[left["n_dim"] == size]
            if not len(own):
                continue
            vecs, ids = np.stack(own["v"].to_numpy()), own["vec_id"].to_numpy()
            directions = np.random.default_rng([seed, int(size)]).standard_normal((int(size), dims))
            proj = vecs @ directions
            tree = build_tree(proj)
            for qid, v in zip(qs["vec_id"], qs["v"]):
                d, i = search(tree, vecs, ids, proj, v, qid, v @ directions, k, confidence)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": i, "score": d}))
        return pd.concat(out) if out else pd.DataFrame(
            {"query_id": [], "vec_id": [], "score": []})

    found = (index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInPandas(meet, "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
