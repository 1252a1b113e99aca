"""Prefix trie of conversations, screened by a count-min sketch.

Every conversation is a path of turns; a node of the trie is a distinct
sequence of first turns.  A prefix is known by a 128-bit digest: sums, in four
lanes, of hashes of (position, role, text), so that long conversations can be
summed in pieces.  A count-min sketch of all digests proves most prefixes to
belong to one conversation alone: an estimate of one is never too low.  From
the first such prefix of a conversation on, its nodes are emitted where they
are; only the prefixes before it are shuffled and grouped exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import partitions_for
from dendra.session import cut_lineage

# Conversations c and c - c % FAMILY share first turns; up to FORKS - 1 of them.
FAMILY, FORKS = 100, 6
# Cells per row of the sketch: four per prefix, within these bounds.  A full
# sketch proves less, so more is shuffled; the result stays exact.
LEAST_CELLS, MOST_CELLS = 1 << 12, 1 << 25
CHUNK = 1 << 16
# Nodes of one path that are summed in one window.
PIECE = 4096
# Bytes of one joined piece of conversation ids.
JOINED = 1 << 20

LANES = ("c1", "c2", "c3", "c4")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pid, mid, x1, x2, chars``: one row per turn; within a
    conversation ``mid`` follows (turn with null first, role, text).

    Turns are range partitioned on that order, so a conversation that holds a
    third of all turns spreads over many partitions (``pid``).  Texts end
    here: two hashes and the length go on."""
    order = ["conv_id", "turn", "role", "text"]
    t = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                              F.col("turn").cast("long").alias("turn"),
                              F.coalesce("role", F.lit("")).alias("role"),
                              F.coalesce("text", F.lit("")).alias("text"))
         .filter(F.col("conv_id").isNotNull()))
    mid = F.monotonically_increasing_id()
    return cut_lineage(
        t.repartitionByRange(partitions_for(t.sparkSession), *order).sortWithinPartitions(*order)
        .select("conv_id", mid.alias("mid"), F.spark_partition_id().alias("pid"),
                F.xxhash64("role", "text").alias("x1"),
                F.xxhash64(F.lit("second"), "text", "role").alias("x2"),
                F.length("text").cast("long").alias("chars")))


def lanes(depth: Column, x1: Column, x2: Column) -> list[Column]:
    """Four 32-bit numbers of a turn at a position (their sums fit a long)."""
    out = []
    for h in (F.xxhash64(depth.cast("long"), x1), F.xxhash64(x2, depth.cast("long"))):
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def digest(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth.cast("long"), *sums), F.xxhash64(*reversed(sums), depth.cast("long"))]


def rebuilt_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations after the fork, as ``(paths, convs)``.

    ``paths``: a row per prefix of one turn and more: ``conv_id, depth, length``
    (turns of the whole conversation), ``chars`` (of the last text), ``k1, k2``
    (the prefix), ``p1, p2`` (the prefix before).  ``convs``: ``conv_id,
    length`` of every conversation, also of those without turns left."""
    pieces = turns.groupBy("conv_id", "pid").agg(F.min("mid").alias("_first"), F.count("*").alias("_n"))
    by_conv = Window.partitionBy("conv_id")               # one row per partition that holds a part
    pieces = cut_lineage(
        pieces.withColumn("_off", F.coalesce(F.sum("_n").over(
            by_conv.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_own", F.sum("_n").over(by_conv)).withColumn("_parts", F.count("*").over(by_conv)))

    pos = F.col("mid") - F.col("_first") + F.col("_off")
    first_turns = (turns.filter(F.col("conv_id") % FAMILY == 0)
                   .join(pieces.filter(F.col("_off") < FORKS - 1), ["conv_id", "pid"])
                   .withColumn("pos", pos).filter(F.col("pos") < FORKS - 1))
    ls = lanes(F.col("pos") + 1, F.col("x1"), F.col("x2"))
    shared = (first_turns.groupBy(F.col("conv_id").alias("_base"))     # FORKS - 1 rows at most
              .agg(F.sort_array(F.collect_list(F.struct("pos", "chars", *[
                  x.alias(n) for x, n in zip(ls, LANES)]))).alias("_shared")))
    # running sums over those few turns, with their own share beside them
    shared = shared.withColumn("_shared", F.expr(
        "transform(_shared, (x, i) -> named_struct('chars', x.chars, "
        + ", ".join(f"'{c}', aggregate(slice(_shared, 1, i + 1), 0L, (a, y) -> a + y.{c}), 'o{c[1]}', x.{c}"
                    for c in LANES) + "))"))

    convs = pieces.groupBy("conv_id").agg(F.max("_own").alias("_own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % FORKS).cast("int")
    convs = cut_lineage(
        convs.withColumn("_h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(shared, "_base", "left")
        .withColumn("_shared", F.expr("slice(_shared, 1, _h)"))
        .withColumn("_nb", F.coalesce(F.array_size("_shared"), F.lit(0)))
        .withColumn("length", F.col("_nb") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0)))
        .select("conv_id", "_h", "_nb", "_shared", "length"))

    at = [F.expr(f"coalesce(try_element_at(_shared, greatest(_nb, 1)).{c}, 0L)").alias(f"_{c}") for c in LANES]
    info = pieces.join(convs.select("conv_id", "_h", "_nb", "length", *at), "conv_id")
    rest = (turns.join(info, ["conv_id", "pid"]).withColumn("_pos", pos)
            .filter(F.col("_pos") >= F.col("_h"))
            .withColumn("depth", F.col("_nb") + F.col("_pos") - F.col("_h") + 1))
    ls = lanes(F.col("depth"), F.col("x1"), F.col("x2"))
    rest = rest.select("conv_id", "pid", "mid", "depth", "length", "chars", "_parts",
                       *[F.col(f"_{c}") for c in LANES], *[x.alias(f"o{c[1]}") for x, c in zip(ls, LANES)])
    # sums of the parts before, for conversations cut by partitions: at most
    # two such parts per partition, hence the broadcasts
    cut = info.filter(F.col("_parts") > 1)
    parts = (turns.join(F.broadcast(cut), ["conv_id", "pid"]).withColumn("_pos", pos)
             .filter(F.col("_pos") >= F.col("_h"))
             .withColumn("depth", F.col("_nb") + F.col("_pos") - F.col("_h") + 1))
    parts = parts.groupBy("conv_id", "pid").agg(*[
        F.sum(x).alias(f"s{c[1]}") for x, c in zip(lanes(F.col("depth"), F.col("x1"), F.col("x2")), LANES)])
    earlier = by_conv.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "pid", *[
        F.coalesce(F.sum(f"s{c[1]}").over(earlier), F.lit(0)).alias(f"e{c[1]}") for c in LANES])
    run = Window.partitionBy("conv_id", "pid").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    rest = (rest.select("*", *[F.sum(f"o{c[1]}").over(run).alias(f"r{c[1]}") for c in LANES])
            .join(F.broadcast(parts), ["conv_id", "pid"], "left"))
    for c in LANES:
        rest = rest.withColumn(c, F.col(f"_{c}") + F.col(f"r{c[1]}") + F.coalesce(f"e{c[1]}", F.lit(0)))
    kept = ["conv_id", "depth", "length", "chars", *LANES, "o1", "o2", "o3", "o4"]
    before = (convs.select("conv_id", "length", F.posexplode("_shared").alias("_i", "_t"))
              .select("conv_id", (F.col("_i") + 1).cast("long").alias("depth"), "length", "_t.chars",
                      *[f"_t.{c}" for c in LANES], *[f"_t.o{c[1]}" for c in LANES]))
    both = rest.select(*kept).unionByName(before.select(*kept))
    k = digest(F.col("depth"), [F.col(c) for c in LANES])
    p = digest(F.col("depth") - 1, [F.col(c) - F.col(f"o{c[1]}") for c in LANES])
    paths = cut_lineage(both.select("conv_id", F.col("depth").cast("long").alias("depth"),
                                    F.col("length").cast("long").alias("length"), "chars",
                                    k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2")))
    return paths, convs.select("conv_id", F.col("length").cast("long").alias("length"))


def root_key() -> list[Column]:
    return digest(F.lit(0), [F.lit(0).cast("long")] * len(LANES))


def sketch(paths: DataFrame, cells: int) -> np.ndarray:
    """Counts (0, 1, 2 for more) of the prefixes in two rows of ``cells``.

    Each task counts its rows; the counts are added up chunk by chunk in
    tasks.  The driver gets the finished sketch, ``2 * MOST_CELLS`` bytes at
    most, whatever the input."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, cells), np.uint8)
        for b in batches:
            for row, name in enumerate(("k1", "k2")):
                at, n = np.unique(b[name].to_numpy() & (cells - 1), return_counts=True)
                seen[row][at] = np.minimum(seen[row][at] + np.minimum(n, 2), 2)
        for row in range(2):
            for c, part in enumerate(seen[row].reshape(-1, min(CHUNK, cells))):
                if part.any():
                    yield pd.DataFrame({"row": [row], "chunk": [c], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for b in batches:
            for row, c, part in zip(b["row"], b["chunk"], b["counts"]):
                part = np.frombuffer(zlib.decompress(part), np.uint8)
                total[row, c] = np.minimum(total[row, c] + part, 2) if (row, c) in total else part
        for (row, c), part in total.items():
            yield pd.DataFrame({"row": [row], "chunk": [c], "counts": [zlib.compress(part.tobytes(), 1)]})

    schema = "row int, chunk int, counts binary"
    chunks = (paths.select("k1", "k2").mapInPandas(count, schema)
              .repartition(partitions_for(paths.sparkSession), "row", "chunk").mapInPandas(add, schema))
    out = np.zeros((2, cells), np.uint8)
    size = min(CHUNK, cells)
    for row, c, part in chunks.collect():
        out[row][c * size:(c + 1) * size] = np.frombuffer(zlib.decompress(part), np.uint8)
    return out


def screened(paths: DataFrame, cells: int) -> DataFrame:
    """``paths`` with ``single`` (this prefix is proven to be of one
    conversation) and ``tail`` (so is the prefix before it)."""
    spark = paths.sparkSession
    counts = spark.sparkContext.broadcast(sketch(paths, cells))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counts.value
        for b in batches:
            def once(a, z):
                return np.minimum(c[0][b[a].to_numpy() & (cells - 1)], c[1][b[z].to_numpy() & (cells - 1)]) < 2
            yield b.assign(single=once("k1", "k2"), tail=once("p1", "p2") & (b["depth"].to_numpy() > 1))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema)
    return cut_lineage(paths.mapInPandas(test, f"{schema}, single boolean, tail boolean"), partition_by="tail")


def joined_hashes(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: SHA-256 of each group's ids, ascending and
    comma-joined.

    A range sort on (group, id) lets many tasks join runs of ids; a hash is a
    chain, so the few joined pieces of a group then pass one task in order,
    as a stream that keeps only the state of the hash."""
    n = partitions_for(ends.sparkSession)
    order = ["k1", "k2", "conv_id"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, first, size = None, [], 0, 0

        def piece():
            return pd.DataFrame({"k1": [key[0]], "k2": [key[1]], "conv_id": [first], "ids": [",".join(ids)]})
        for b in batches:
            for k1, k2, c in zip(b["k1"].tolist(), b["k2"].tolist(), b["conv_id"].tolist()):
                if key != (k1, k2) or size > JOINED:
                    if ids:
                        yield piece()
                    key, ids, first, size = (k1, k2), [], c, 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(b["k1"].tolist(), b["k2"].tolist(), b["ids"]):
                if key == (k1, k2):
                    state.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    pieces = (ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
              .mapInPandas(join, "k1 long, k2 long, conv_id long, ids string"))
    return (pieces.repartition(n, "k1", "k2").sortWithinPartitions(*order)
            .mapInPandas(chain, "k1 long, k2 long, ends_sha256 string"))


def sums_above(nodes: DataFrame) -> DataFrame:
    """``k1, k2, f_above, leaf_above``: sums over the nodes above on the same
    path with the same smallest member.  Paths are summed in pieces of
    ``PIECE`` depths, then the pieces before are added."""
    n = nodes.withColumn("_piece", F.floor(F.col("depth") / PIECE))
    up = Window.partitionBy("rep", "_piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("rep").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (n.groupBy("rep", "_piece").agg(F.sum("f").alias("_f"), F.sum("leaf").alias("_l"))
              .select("rep", "_piece", F.sum("_f").over(before).alias("_f"), F.sum("_l").over(before).alias("_l"))
              .filter(F.col("_f").isNotNull()))
    return (n.select("rep", "_piece", "k1", "k2", F.sum("f").over(up).alias("f_above"),
                     F.sum("leaf").over(up).alias("leaf_above"))
            .join(pieces, ["rep", "_piece"], "left")
            .select("k1", "k2", (F.coalesce("f_above", F.lit(0)) + F.coalesce("_f", F.lit(0))).alias("f_above"),
                    (F.coalesce("leaf_above", F.lit(0)) + F.coalesce("_l", F.lit(0))).alias("leaf_above")))


def conversation_trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    ``conversations``: ``conv_id, turn, role, text``; other columns are
    ignored.  Columns out: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Rows without a conv_id are left out; a null role or text is empty; turns
    go null first; turns of one number follow role and text in code-point
    order and repeated rows are turns of their own.  Conversations without
    turns left are members of the root.  An empty table has no node.

    Why subtree sums need no walk: a node belongs to its smallest member, and
    what a conversation owns is the lower end of its path.  So a node's subtree
    is all that its members own, less what its own smallest member owns above
    it; both are plain grouped sums."""
    paths, convs = rebuilt_paths(ordered_turns(conversations))
    n = paths.count()
    cells = int(min(max(LEAST_CELLS, 1 << max(4 * n, 1).bit_length()), most_cells))
    marked = screened(paths, cells)
    none, one = F.sha2(F.lit(""), 256), F.sha2(F.col("conv_id").cast("string"), 256)

    def alone(df, parent):
        """Nodes that one conversation has for itself."""
        return df.select("conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                         (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
                         F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                         F.when(F.col("depth") < F.col("length"), none).otherwise(one).alias("ends_sha256"))

    # the first proven prefix of a conversation; a later one may look shared again
    open_ = marked.filter(~F.col("tail"))
    first = open_.filter("single").groupBy("conv_id").agg(F.min("depth").alias("_alone"))
    open_ = cut_lineage(open_.join(first, "conv_id", "left")
                        .withColumn("kind", F.when(F.col("depth") == F.col("_alone"), "first")
                                    .when(F.col("depth") > F.col("_alone"), "tail").otherwise("shared"))
                        .drop("single", "tail", "_alone"), partition_by="kind")
    tails = alone(marked.filter("tail"), F.col("conv_id")).unionByName(
        alone(open_.filter("kind = 'tail'"), F.col("conv_id")))
    firsts = open_.filter("kind = 'first'")
    shared = open_.filter("kind = 'shared'")

    nodes = cut_lineage(
        shared.groupBy("k1", "k2").agg(
            F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"),
            F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
            F.max(F.col("length") > F.col("depth")).alias("_on"))
        .withColumn("f", (F.col("n_convs") - 1) * F.col("chars"))
        .withColumn("leaf", (~F.col("_on")).cast("long")))
    owned = (nodes.select(F.col("rep").alias("conv_id"), "f", "leaf")
             .unionByName(firsts.select("conv_id", F.lit(0).cast("long").alias("f"), F.lit(1).cast("long").alias("leaf")))
             .groupBy("conv_id").agg(F.sum("f").alias("f"), F.sum("leaf").alias("leaf")))
    below = (shared.select("k1", "k2", "conv_id").join(owned, "conv_id")
             .groupBy("k1", "k2").agg(F.sum("f").alias("_f"), F.sum("leaf").alias("_leaf")))
    children = (nodes.select("p1", "p2").unionByName(firsts.select("p1", "p2"))
                .groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")))

    root = root_key()
    ends = (shared.filter("depth = length").select("k1", "k2", "conv_id")
            .unionByName(convs.filter("length = 0").select(root[0].alias("k1"), root[1].alias("k2"), "conv_id")))
    hashes = cut_lineage(joined_hashes(ends))
    all_convs = convs.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("_parent")).unionByName(
        all_convs.select(root[0].alias("p1"), root[1].alias("p2"), F.col("rep").alias("_parent")))

    inner = (nodes.join(below, ["k1", "k2"]).join(sums_above(nodes), ["k1", "k2"])
             .join(children, ["k1", "k2"], "left").join(hashes, ["k1", "k2"], "left")
             .join(parents, ["p1", "p2"], "left")
             .select(F.col("rep").alias("conv_id"), "depth", F.col("_parent").alias("parent_conv_id"), "n_convs",
                     F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                     (F.col("_leaf") - F.col("leaf_above")).alias("n_leaves"),
                     (F.col("_f") - F.col("f_above")).alias("saved_tokens"),
                     F.coalesce("ends_sha256", none).alias("ends_sha256")))
    under = alone(firsts.join(parents, ["p1", "p2"], "left"), F.col("_parent"))
    parts = (nodes.select("depth", "f", "leaf").unionByName(
        firsts.select("depth", F.lit(0).cast("long").alias("f"), F.lit(1).cast("long").alias("leaf"))))
    at_root = hashes.filter((F.col("k1") == root[0]) & (F.col("k2") == root[1]))

    def total(df, what, empty):
        return F.coalesce(df.select(what.alias("v")).scalar(), empty)

    top = (all_convs.filter("n_convs > 0")
           .select(F.col("rep").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
                   F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                   total(parts, F.sum((F.col("depth") == 1).cast("long")), F.lit(0)).alias("n_children"),
                   total(parts, F.sum("leaf"), F.lit(1)).alias("n_leaves"),
                   total(parts, F.sum("f"), F.lit(0)).alias("saved_tokens"),
                   total(at_root, F.max("ends_sha256"), none).alias("ends_sha256")))
    return top.unionByName(inner).unionByName(under).unionByName(tails).select(*NODE)
