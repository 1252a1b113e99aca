"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.session import cut_lineage

MAX_ROUNDS = 60


def _shortcut(parent: DataFrame) -> DataFrame:
    """Follow parents (v, p; p < v or p = v) up to the roots."""
    for _ in range(MAX_ROUNDS):
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = cut_lineage(parent.join(up, "p")
                             .select("v", F.col("pp").alias("p"),
                                     (F.col("pp") != F.col("p")).alias("moved")))
        if parent.filter("moved").isEmpty():
            return parent.select("v", "p")
    raise RuntimeError("pointer jumping did not converge")


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every end of an edge (``a``, ``b``); ``comp`` is the
    smallest vertex reachable.  Each round every root hooks onto its smallest
    neighbour and paths are halved until they are flat, so rounds grow with
    the logarithm of the longest path.  Raises if it does not converge."""
    edges = cut_lineage(edges.select("a", "b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = None
    for _ in range(MAX_ROUNDS):
        parent = cut_lineage(both.groupBy(F.col("a").alias("v"))
                             .agg(F.min("b").alias("p"))
                             .select("v", F.least("v", "p").alias("p")))
        parent = _shortcut(parent)
        if label is None:
            label = parent.select("v", F.col("p").alias("comp"))
        else:
            label = label.join(parent.select(F.col("v").alias("comp"), "p"), "comp", "left") \
                .select("v", F.coalesce("p", "comp").alias("comp"))
        label = cut_lineage(label)
        a = parent.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        b = parent.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        both = cut_lineage(both.join(a, "a").join(b, "b").filter("ra <> rb")
                           .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if both.isEmpty():
            return label
    raise RuntimeError("components did not converge")
