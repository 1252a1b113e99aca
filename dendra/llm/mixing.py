"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has
handed out up to and including it, in a shuffled order, divided by the
source's target.  All copies are then put in one global order of finish time
and taken until the total budget is spent, so every source advances at the
rate of its target.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import n_words, partitions_for
from dendra.session import cut_lineage

# Ordered slots per unit of virtual time.
SLOTS = 1024
# Finish times above this share wider, logarithmic slots.
LINEAR_UNTIL = 64


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget_ratio: float = 1.5,
                   max_repeats: int = 2) -> DataFrame:
    """Targets per source by water filling.

    ``sizes``: one row per source (``_null``, ``_src``, ``source_size``).
    Sources in code-point order (null last) take ``weights`` in turn and share
    ``budget_ratio`` times all sizes; a target stops at ``max_repeats`` times
    its source's size and the excess goes to the others by weight.  The common
    level is the largest (budget - capped sizes before) / (weights from here
    on) when sources are ordered by cap / weight.  The windows here run over
    one row per source."""
    order = Window.orderBy("_null", "_src")
    ws = F.array(*[F.lit(int(w)) for w in weights])
    w = (sizes.withColumn("_rank", F.row_number().over(order))
         .withColumn("weight", ws[(F.col("_rank") - 1) % len(weights)].cast("long"))
         .withColumn("_cap", F.col("source_size") * max_repeats))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    return (w.withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(budget_ratio)))
            .withColumn("_level",
                        (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                        / F.sum("weight").over(onward))
            .withColumn("target", F.least(F.col("_cap").cast("double"),
                                          F.max("_level").over(every) * F.col("weight")))
            .select("_null", "_src", "source_size", "target", "_budget"))


def shuffle_key(doc_id, text, seed: str):
    """The random order as two longs: the first 30 hex digits of an md5 of the
    id, of the text's md5 where the id is null."""
    digits = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(
        doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))))
    return [F.conv(F.substring(digits, at, 15), 16, 10).cast("long") for at in (1, 16)]


def queues(docs: DataFrame, weights, budget_ratio: float, max_repeats: int, seed: str) -> DataFrame:
    """One row per document with its source's target and ``_cum``, the words
    its source hands out up to and including it.

    Documents are range sorted by (source, key), so that a source of any share
    of the rows spreads over many partitions, also one of equal ids; sums per
    (source, partition) carry the running totals across."""
    base = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
        F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_src"),
        n_words(F.col("text")).alias("size"),
        *[k.alias(n) for k, n in zip(shuffle_key(F.col("doc_id"), F.col("text"), seed), ("_k1", "_k2"))],
        F.monotonically_increasing_id().alias("_row")))
    order = ["_null", "_src", "_k1", "_k2", "doc_id", "size", "_row"]
    ranged = cut_lineage(
        base.repartitionByRange(partitions_for(docs.sparkSession), *order).sortWithinPartitions(*order)
        .select("doc_id", "source", "_null", "_src", "size", F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().alias("_at")))
    src = ["_null", "_src"]
    sums = cut_lineage(ranged.groupBy(*src, "_part").agg(F.sum("size").alias("_sum")))
    before = Window.partitionBy(*src).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*src, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    targets = source_targets(sums.groupBy(*src).agg(F.sum("_sum").alias("source_size")),
                             weights, budget_ratio, max_repeats)
    run = (Window.partitionBy(*src, "_part").orderBy("_at")
           .rowsBetween(Window.unboundedPreceding, 0))
    return cut_lineage(
        ranged.withColumn("_cum", F.sum("size").over(run))
        .join(offsets.join(targets, src), [*src, "_part"])
        .withColumn("_cum", F.col("_cum") + F.col("_off")).drop("_off", "_at", "_part"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), budget_ratio: float = 1.5,
                max_repeats: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size`` (words),
    ``source_size``, ``target`` (its source's), ``taken`` (words the mix takes,
    a repeated document counted each time, at most ``max_repeats`` times).

    Null and empty texts have size 0 and are taken 0 times.  A null source is
    a source of its own, after all others.  Repeated rows are separate
    documents.  An empty table gives an empty result.  The shuffle key is an
    md5 of the id, so reruns agree.

    Scale: one pass over the texts writes slim rows; everything after reads
    those.  The global order is cut into slots of virtual time.  Slots that end
    before the budget are taken whole, slots that start behind it not at all,
    and only the one slot in which the budget ends is put in order row by row.
    So a document's share follows from its own row and one cut point, and
    nothing is joined back.  The windows without a key run over one row per
    source or slot."""
    queued = queues(docs, weights, budget_ratio, max_repeats, seed)
    copies = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda c: F.struct(
        ((c * F.col("source_size") + F.col("_cum")) / F.col("target")).alias("finish"),
        F.col("_null").alias("null"), F.col("_src").alias("src"), c.alias("copy"), F.col("_cum").alias("cum")))
    takes_part = (F.col("size") > 0) & (F.col("target") > 0)

    def slot(finish):
        return F.when(finish < LINEAR_UNTIL, F.floor(finish * SLOTS)).otherwise(
            F.lit(LINEAR_UNTIL * SLOTS) + F.floor(F.log2(finish) * SLOTS))

    copied = (queued.filter(takes_part).select("size", "_budget", F.explode(copies).alias("_c"))
              .withColumn("_slot", slot(F.col("_c.finish"))))
    in_order = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = (copied.groupBy("_slot").agg(F.sum("size").alias("_sum"), F.max("_budget").alias("_budget"))
             .withColumn("_end", F.sum("_sum").over(in_order)))
    last = slots.filter(F.col("_end") > F.col("_budget")).agg(
        F.min(F.struct("_slot", (F.col("_end") - F.col("_sum")).alias("start"), "_budget"))).collect()[0][0]
    taken = F.size(copies)
    if last is not None:
        by_copy = Window.partitionBy("_slot").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
        cut = (copied.filter(F.col("_slot") == last["_slot"])
               .withColumn("_total", F.sum("size").over(by_copy) + F.lit(last["start"]))
               .filter(F.col("_total") <= F.lit(last["_budget"]))
               .agg(F.max("_c").alias("_cut")).scalar())
        queued = queued.withColumn("_cut", cut)
        taken = F.size(F.filter(copies, lambda c: (slot(c["finish"]) < last["_slot"]) | (
            (slot(c["finish"]) == last["_slot"]) & F.coalesce(c <= F.col("_cut"), F.lit(False)))))
    return queued.select("doc_id", "source", "size", "source_size", "target",
                         F.when(takes_part, F.col("size") * taken).otherwise(F.lit(0)).cast("long").alias("taken"))
