"""Exact k-nearest-neighbour search as a distributed block product.

Both sides are hashed into blocks of at most ``block_rows`` rows (dense and
sparse vectors: of bounded bytes, compared tile by tile).  Every
query block meets every index block in one ``cogroup`` task that emits only its
per-row top-k; a final ``row_number`` window
(planned as a partial + final ``WindowGroupLimit``) keeps the global top-k.

Sparse blocks are rows of a table: a Cartesian product reads every pair where it was
written, a task keeps the top-k of its queries, and no vector is shuffled.

Nothing is collected to the driver, no task holds more than a few blocks, and
the pair matrix is never written out: shuffle volume is
``n_q * B_index + n_index * B_query`` rows, not ``n_q * n_index``.
For a small query table (B_query = 1) the index is read once.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.functions import vectors as V
from dendra.session import cut_lineage

DEFAULT_BLOCK_ROWS = 2048
# Dense blocks: the rows sent grow with the number of blocks, so these are large.
DENSE_BLOCK_BYTES = 32 << 20
# Sparse blocks on the left and on the right, whose postings are sorted beside them.
SPARSE_LEFT_BYTES, SPARSE_RIGHT_BYTES = 128 << 20, 96 << 20
# Sparse blocks that are one row, read where they were written; left ones a task holds.
SPARSE_ROW_BYTES, HELD_BLOCKS = 32 << 20, 4


MIN_BLOCK_ROWS = 256


# Pairs a core for dense blocks: pairs meet in partitions by hash, which evens out with several.
DENSE_PAIRS = 6


def plan_blocks(spark, n_left: int, n_right: int, block_rows: int = DEFAULT_BLOCK_ROWS,
                per_core: int = 2, right_rows: int | None = None):
    """Block counts (B_left, B_right): blocks of at most ``block_rows`` rows
    (on the right ``right_rows``, if given), then split further (down to ``MIN_BLOCK_ROWS``) until there are at least
    ``per_core`` block pairs per core, so small inputs still use the whole cluster."""
    bl = max(1, math.ceil(n_left / block_rows))
    br = max(1, math.ceil(n_right / (right_rows or block_rows)))
    target = per_core * max(1, spark.sparkContext.defaultParallelism)
    while bl * br < target:
        can_l = n_left / (bl + 1) >= MIN_BLOCK_ROWS
        can_r = n_right / (br + 1) >= MIN_BLOCK_ROWS
        if can_r and (n_right / br >= n_left / bl or not can_l):
            br += 1
        elif can_l:
            bl += 1
        else:
            break
    return bl, br


def deal(df: DataFrame, pairs: int) -> DataFrame:
    """Rows by block pair (lb, rb) in so many partitions that cores stay busy:
    their number is fixed, since partitions merged by size leave a few tasks."""
    most = 8 * max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(2 * pairs, most)), "lb", "rb")


def block_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                b_left: int, b_right: int):
    """Cogroup every left block with every right block.

    A row's block is ``pmod(xxhash64(key), B)``; the left side is replicated
    once per right block and vice versa, so each (lb, rb) group holds one
    bounded block from each side.  Returns a ``PandasCogroupedOps``."""
    # fresh attribute ids on each side, so a table can be paired with itself
    left = left.select([F.col(c).alias(c) for c in left.columns])
    right = right.select([F.col(c).alias(c) for c in right.columns])
    lq = (left.withColumn("lb", F.pmod(F.xxhash64(left_key), F.lit(b_left)).cast("int"))
          .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(b_right - 1)))))
    rq = (right.withColumn("rb", F.pmod(F.xxhash64(right_key), F.lit(b_right)).cast("int"))
          .withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(b_left - 1)))))
    lq, rq = deal(lq, b_left * b_right), deal(rq, b_left * b_right)
    return lq.groupBy("lb", "rb").cogroup(rq.groupBy("lb", "rb"))


def _spark_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def top_k(queries: DataFrame, index: DataFrame, k: int, *,
          q_id: str = "id", i_id: str = "id",
          q_vec: str | None = "vec", i_vec: str | None = "vec",
          q_terms: str | None = None, q_weights: str | None = None,
          i_terms: str | None = None, i_weights: str | None = None,
          metric: str = "cosine", alpha: float | None = None,
          exclude: str | None = None, self_join: bool = False,
          block_rows: int | None = None,
          n_queries: int | None = None, n_index: int | None = None,
          out_id: str = "nbr_id", out_score: str = "score",
          round_digits: int | None = None) -> DataFrame:
    """Top-k index rows per query row.

    metric: ``cosine`` (vectors L2-normalised in Spark first), ``dot``,
    ``euclidean`` (distance, ascending) or ``hybrid`` (dense dot + sparse dot,
    optionally ``alpha * dense + (1 - alpha) * sparse``).  Sparse vectors are
    (terms BIGINT[], weights DOUBLE[]) column pairs.  ``exclude`` names a query
    column whose value is never returned as a neighbour (``self_join`` excludes
    the query's own id).  Ties order by neighbour id ascending;
    ``round_digits`` rounds scores before ranking so exact duplicates tie
    regardless of floating summation order.  Without ``block_rows``, blocks of
    dense vectors hold DENSE_BLOCK_BYTES, of sparse ones SPARSE_ROW_BYTES, others
    DEFAULT_BLOCK_ROWS rows.  The search of sparse vectors is run at once.

    Returns (q_id, rank, out_id, out_score)."""
    use_dense = q_vec is not None and i_vec is not None and metric != "sparse"
    use_sparse = q_terms is not None and i_terms is not None
    if not use_dense and not use_sparse:
        raise ValueError("need dense and/or sparse vector columns")
    larger_better = metric != "euclidean"

    if use_dense and not use_sparse:
        partial = _dense_pairs(queries, index, k, q_id=q_id, i_id=i_id, q_vec=q_vec, i_vec=i_vec,
                               metric=metric, exclude=q_id if self_join else exclude,
                               block_rows=block_rows, n_queries=n_queries, n_index=n_index,
                               round_digits=round_digits)
        return _best(partial, k, larger_better, q_id, out_id, out_score)
    if not use_dense and larger_better and alpha is None:
        partial = _sparse_pairs(queries, index, k, q_id=q_id, i_id=i_id, q_terms=q_terms, q_weights=q_weights,
                                i_terms=i_terms, i_weights=i_weights, exclude=q_id if self_join else exclude,
                                block_rows=block_rows, round_digits=round_digits)
        return _best(partial, k, larger_better, q_id, out_id, out_score)
    q_cols = [F.col(q_id).alias("qid")]
    i_cols = [F.col(i_id).alias("iid")]
    if use_dense:
        qv, iv = V.as_double(q_vec), V.as_double(i_vec)
        if metric == "cosine":
            qv, iv = V.l2_normalize(qv), V.l2_normalize(iv)
        q_cols.append(qv.alias("qv"))
        i_cols.append(iv.alias("iv"))
    if use_sparse:
        q_cols += [F.col(q_terms).alias("qt"), F.col(q_weights).cast("array<double>").alias("qw")]
        i_cols += [F.col(i_terms).alias("it"), F.col(i_weights).cast("array<double>").alias("iw")]
    if self_join:
        q_cols.append(F.col(q_id).alias("qx"))
    elif exclude is not None:
        q_cols.append(F.col(exclude).alias("qx"))
    has_x = self_join or exclude is not None

    nq = n_queries if n_queries is not None else queries.count()
    ni = n_index if n_index is not None else index.count()
    bq, bi = plan_blocks(queries.sparkSession, nq, ni, block_rows or DEFAULT_BLOCK_ROWS)
    pairs = block_pairs(queries.select(*q_cols), index.select(*i_cols), "qid", "iid", bq, bi)

    qid_t = _spark_type(queries, q_id)
    iid_t = _spark_type(index, i_id)
    out_schema = T.StructType([
        T.StructField("qid", qid_t), T.StructField("iid", iid_t),
        T.StructField("score", T.DoubleType())])
    dense_metric = "dot" if metric in ("cosine", "hybrid") else metric
    a = alpha

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"qid": lp["qid"].iloc[:0], "iid": rp["iid"].iloc[:0],
                                 "score": np.zeros(0)})
        S = None
        if use_dense:
            S = V.dense_scores(V.stack(lp["qv"]), V.stack(rp["iv"]), dense_metric)
            if a is not None and use_sparse:
                S = a * S
        if use_sparse:
            Ss = V.sparse_scores(list(lp["qt"]), list(lp["qw"]), list(rp["it"]), list(rp["iw"]))
            if a is not None and use_dense:
                Ss = (1.0 - a) * Ss
            S = Ss if S is None else S + Ss
        if round_digits is not None:
            S = np.round(S, round_digits)
        r_ids = rp["iid"].to_numpy()
        mask = None
        if has_x:
            mask = lp["qx"].to_numpy()[:, None] == r_ids[None, :]
        rows, cols, sc, _ = V.top_k_rows(S, r_ids, k, larger_better, mask)
        return pd.DataFrame({"qid": lp["qid"].to_numpy()[rows], "iid": r_ids[cols], "score": sc})

    return _best(pairs.applyInPandas(kernel, out_schema), k, larger_better, q_id, out_id, out_score)


def _vector_column(df: DataFrame, vec: str):
    """The vectors as floats or doubles, as they are stored."""
    kind = _spark_type(df, vec).simpleString()
    return F.col(vec) if kind in ("array<float>", "array<double>") else V.as_double(vec)


def dense_size(df: DataFrame, vec: str) -> tuple[int, int]:
    """Number of rows, and of rows in a block of DENSE_BLOCK_BYTES."""
    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    return n, max(DEFAULT_BLOCK_ROWS, DENSE_BLOCK_BYTES // (8 * max(1, dim or 1)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count or len(pc.unique(pc.list_value_length(column))) != 1:
        raise ValueError("vectors must not be null and must have one length")
    values = pa.concat_arrays([c.flatten() for c in column.chunks])
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(
        len(column), len(values) // len(column))


def _left_out(left: pa.ChunkedArray, right: pa.ChunkedArray):
    """Both columns as numbers, equal where the values are; null equals nothing."""
    ids = pc.unique(right)
    return (pc.fill_null(pc.index_in(c, value_set=ids, skip_nulls=True), none).to_numpy().astype(np.int64)
            for c, none in ((left, -1), (right, len(ids))))


def _dense_pairs(queries: DataFrame, index: DataFrame, k: int, *, q_id: str, i_id: str, q_vec: str,
                 i_vec: str, metric: str, exclude: str | None, block_rows: int | None,
                 n_queries: int | None, n_index: int | None, round_digits: int | None) -> DataFrame:
    """The k best rows (qid, iid, score) of every index block for every query."""
    if n_index is None or block_rows is None:
        n_index, rows = dense_size(index, i_vec)
        block_rows = block_rows or rows
    if n_queries is None:
        n_queries = n_index if queries is index else queries.count()
    bq, bi = plan_blocks(queries.sparkSession, n_queries, n_index, block_rows, DENSE_PAIRS)
    q_cols = [F.col(q_id).alias("qid"), _vector_column(queries, q_vec).alias("qv")]
    i_cols = [F.col(i_id).alias("iid"), _vector_column(index, i_vec).alias("iv")]
    if exclude is not None:
        q_cols.append(F.col(exclude).try_cast(_spark_type(index, i_id)).alias("qx"))
    pairs = block_pairs(queries.select(*q_cols), index.select(*i_cols), "qid", "iid", bq, bi)
    schema = T.StructType([T.StructField("qid", _spark_type(queries, q_id)),
                           T.StructField("iid", _spark_type(index, i_id)),
                           T.StructField("score", T.DoubleType())])
    kind = "euclidean" if metric == "euclidean" else "dot"
    unit = metric == "cosine"
    has_x = exclude is not None

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        qid, iid, score = lt["qid"].slice(0, 0), rt["iid"].slice(0, 0), np.zeros(0)
        if len(lt) and len(rt):
            rt = rt.take(pc.sort_indices(rt["iid"]))
            L, R = _matrix(lt["qv"]), _matrix(rt["iv"])
            if unit:
                L, R = V.unit_rows(L), V.unit_rows(R)
            l_out = r_out = None
            if has_x:
                l_out, r_out = _left_out(lt["qx"], rt["iid"])
            rows, cols, score = V.nearest_rows(L, R, k, kind, l_out, r_out, round_digits)
            qid, iid = lt["qid"].take(pa.array(rows)), rt["iid"].take(pa.array(cols))
        return pa.table({"qid": qid, "iid": iid, "score": pa.array(score, pa.float64())})

    return pairs.applyInArrow(kernel, schema)


def sparse_size(df: DataFrame, terms: str, most_bytes: int) -> tuple[int, int]:
    """Number of rows, and of rows of a block of ``most_bytes``."""
    n, entries = df.agg(F.count(F.lit(1)), F.sum(F.size(terms).cast("long"))).first()
    each = 16 * max(1, math.ceil((entries or 0) / max(1, n)))
    return n, max(MIN_BLOCK_ROWS, most_bytes // each)


def flat_vectors(terms: pa.ChunkedArray, weights: pa.ChunkedArray) -> tuple:
    """Sparse vectors as (starts, terms, weights), see ``V.SparseBlock``."""
    if terms.null_count or weights.null_count:
        raise ValueError("vectors must not be null")
    lens = pc.list_value_length(terms).to_numpy().astype(np.int64)
    if not (lens == pc.list_value_length(weights).to_numpy()).all():
        raise ValueError("vectors must have a weight for every term")
    t, w = (pa.concat_arrays([c.flatten() for c in x.chunks]).to_numpy(zero_copy_only=False)
            for x in (terms, weights))
    return np.concatenate([[0], np.cumsum(lens)]), t, w


def sparse_blocks(df: DataFrame, key: str, terms: str, weights: str, rows: int, beside: dict | None = None) -> DataFrame:
    """Sparse vectors as a written table of blocks of at most ``rows`` vectors, a block a
    row: ids ascending, the columns ``beside`` (by name) in their order, and
    ``flat_vectors`` as bytes."""
    cols = [F.col(key).alias("ids"), F.col(terms).cast("array<long>").alias("t"),
            F.col(weights).cast("array<double>").alias("w")]
    fields = [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(_spark_type(df, key)))]
    for name, col in (beside or {}).items():
        cols.append(col.alias(name))
        fields.append(T.StructField(name, T.ArrayType(df.select(col.alias(name)).schema[name].dataType)))
    lists = [f.name for f in fields[1:]]
    fields += [T.StructField(c, T.BinaryType()) for c in ("start", "t", "w")]

    def block(batches: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        t = t.take(pc.sort_indices(t["ids"]))
        row = {"block": pa.array([uuid.uuid4().int >> 65])}
        for c in lists:
            x = t[c].combine_chunks()
            row[c] = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for c, x in zip(("start", "t", "w"), flat_vectors(t["t"], t["w"])):
            row[c] = pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.RecordBatch.from_pydict(row)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return cut_lineage(df.select(*cols).mapInArrow(pack, T.StructType(fields)))


@contextmanager
def row_batches(spark):
    """Rows that are whole blocks reach Python one by one, in what is run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def blocks_met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of ``left`` beside every block of ``right`` (its columns as r_...), a
    left block's pairs one after the other, in a few tasks a core."""
    right = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    cores = max(1, left.sparkSession.sparkContext.defaultParallelism)
    return left.crossJoin(right.hint("shuffle_replicate_nl")).coalesce(8 * cores)


def block_vectors(row: dict, side: str = "") -> tuple:
    """``flat_vectors`` of a block's row."""
    return tuple(np.frombuffer(row[side + c], dtype=kind)
                 for c, kind in (("start", np.int64), ("t", np.int64), ("w", np.float64)))


def _sparse_pairs(queries: DataFrame, index: DataFrame, k: int, *, q_id: str, i_id: str, q_terms: str,
                  q_weights: str, i_terms: str, i_weights: str, exclude: str | None,
                  block_rows: int | None, round_digits: int | None) -> DataFrame:
    """The k best rows (qid, iid, score) that a task found for each of its queries."""
    spark = queries.sparkSession
    n_index, rows = sparse_size(index, i_terms, SPARSE_ROW_BYTES)
    n_queries, q_rows = sparse_size(queries, q_terms, SPARSE_ROW_BYTES)
    bq, bi = plan_blocks(spark, n_queries, n_index, block_rows or q_rows, right_rows=block_rows or rows)
    out = {} if exclude is None else {"out": F.col(exclude).try_cast(_spark_type(index, i_id))}
    left = sparse_blocks(queries, q_id, q_terms, q_weights, max(1, math.ceil(n_queries / bq)), out)
    if queries is index and (q_id, q_terms, q_weights) == (i_id, i_terms, i_weights):
        right = left.drop("out")
    else:
        right = sparse_blocks(index, i_id, i_terms, i_weights, max(1, math.ceil(n_index / bi)))
    schema = T.StructType([T.StructField("qid", _spark_type(queries, q_id)),
                           T.StructField("iid", _spark_type(index, i_id)),
                           T.StructField("score", T.DoubleType())])

    has_x = exclude is not None

    def kernel(batches):
        held = {}       # left blocks: ids, what they leave out, vectors, best rows so far
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch[c][r] for c in batch.schema.names}
                name = row["block"].as_py()
                if name not in held:
                    if len(held) == HELD_BLOCKS:
                        yield found(held.pop(next(iter(held))))
                    held[name] = {"ids": row["ids"].values, "out": row["out"].values if has_x else None,
                                  "vectors": block_vectors({c: row[c].as_py() for c in ("start", "t", "w")}),
                                  "best": None}
                mine, iid = held[name], pa.chunked_array([row["r_ids"].values])
                l_out, r_out = _left_out(pa.chunked_array([mine["out"]]), iid) if has_x else (None, None)
                at, col, score = V.nearest_sparse(mine["vectors"], block_vectors(
                    {c: row[c].as_buffer() for c in ("r_start", "r_t", "r_w")}, "r_"), k, l_out, r_out, round_digits)
                new = pa.table({"at": at, "iid": iid.take(pa.array(col)), "score": score})
                mine["best"] = new if mine["best"] is None else _first_rows(pa.concat_tables([mine["best"], new]), k)
        for mine in held.values():
            yield found(mine)

    def found(mine: dict) -> pa.RecordBatch:
        at, iid, score = (mine["best"][c].combine_chunks() for c in ("at", "iid", "score"))
        return pa.RecordBatch.from_pydict({"qid": mine["ids"].take(at), "iid": iid, "score": score})

    with row_batches(spark):
        return cut_lineage(blocks_met(left, right).mapInArrow(kernel, schema))


def _first_rows(rows: pa.Table, k: int) -> pa.Table:
    """The k first rows (at, iid, score) of every ``at``: largest scores, then smallest iid."""
    rows = rows.sort_by([("at", "ascending"), ("score", "descending"), ("iid", "ascending")])
    at = rows["at"].to_numpy()
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    return rows.filter(pa.array(rank < k))


def _best(partial: DataFrame, k: int, larger_better: bool, q_id: str, out_id: str, out_score: str) -> DataFrame:
    order = F.col("score").desc() if larger_better else F.col("score").asc()
    w = Window.partitionBy("qid").orderBy(order, F.col("iid").asc())
    return (partial.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(F.col("qid").alias(q_id), "rank", F.col("iid").alias(out_id),
                    F.col("score").alias(out_score)))


def self_top_k(df: DataFrame, k: int, *, id_col: str = "id", vec: str | None = "vec",
               terms: str | None = None, weights: str | None = None,
               metric: str = "cosine", block_rows: int | None = None,
               n_rows: int | None = None, out_id: str = "nbr_id",
               out_score: str = "score", round_digits: int | None = None) -> DataFrame:
    """k nearest *other* rows of every row (the kNN graph)."""
    if n_rows is None and (vec is None or terms is not None):
        n_rows = df.count()
    return top_k(df, df, k, q_id=id_col, i_id=id_col, q_vec=vec, i_vec=vec,
                 q_terms=terms, q_weights=weights, i_terms=terms, i_weights=weights,
                 metric=metric, self_join=True, block_rows=block_rows,
                 n_queries=n_rows, n_index=n_rows, out_id=out_id, out_score=out_score,
                 round_digits=round_digits)


def filtered_top_k(queries: DataFrame, index: DataFrame, k: int, condition, **kw) -> DataFrame:
    """Metadata pre-filter, applied *before* ranking so k rows survive it
    (the filter reaches the parquet scan as a pushed predicate)."""
    return top_k(queries, index.filter(condition), k, **kw)


def lsh_top_k(df: DataFrame, k: int, *, id_col: str = "id", vec: str = "vec",
              bands: int = 8, bits: int = 8, seed: int = 42,
              block_rows: int | None = None) -> DataFrame:
    """Approximate cosine kNN graph by random-hyperplane LSH.

    Each band hashes a vector to ``bits`` sign bits of seeded random
    hyperplanes; rows sharing a (band, bucket) are candidates.  A bucket is
    never expanded into all its pairs: it is cut into sub-blocks of at most
    ``block_rows`` rows (so a bucket holding a third of all rows is spread
    over many tasks) and every sub-block pair runs the exact top-k kernel.
    No candidate is capped; results are exact scores re-ranked across bands.
    Rows that met fewer than ``k`` others are searched exactly, so every row
    gets ``k`` neighbours (all others, if fewer).  ``bits`` sets the bucket
    size: about n / 2**bits rows, so take log2(n / rows wanted per bucket)."""
    first = df.select(F.size(vec)).first()
    dim = int(first[0]) if first else 0
    rng = np.random.default_rng(seed)
    H = rng.normal(size=(bands * bits, dim))
    Hl = [float(x) for x in H.ravel()]
    nb = bands * bits

    def sig(batches):
        Hm = np.asarray(Hl).reshape(nb, dim)
        weights = (1 << np.arange(bits)).astype(np.int64)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = V.stack(pdf["v"])
            S = (X @ Hm.T) >= 0
            codes = (S.reshape(len(pdf), bands, bits) * weights).sum(axis=2)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), bands),
                                "band": np.tile(np.arange(bands), len(pdf)),
                                "bucket": codes.ravel().astype(np.int64)})

    pts = df.select(F.col(id_col).alias("id"), V.l2_normalize(V.as_double(vec)).alias("v"))
    id_t = df.schema[id_col].dataType.simpleString()
    sigs = pts.mapInPandas(sig, f"id {id_t}, band int, bucket long")
    sizes = sigs.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"))
    nsub = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows or DEFAULT_BLOCK_ROWS))).cast("int")
    tagged = (sigs.join(sizes, ["band", "bucket"])
              .withColumn("ns", nsub)
              .withColumn("sb", F.pmod(F.xxhash64("id"), F.col("ns")).cast("int"))
              .join(pts, "id"))
    left = (tagged.withColumn("lb", F.col("sb"))
            .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
            .select("band", "bucket", "lb", "rb", F.col("id").alias("qid"), F.col("v").alias("qv")))
    right = (tagged.withColumn("rb", F.col("sb"))
             .withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
             .select("band", "bucket", "lb", "rb", F.col("id").alias("iid"), F.col("v").alias("iv")))
    right = right.select([F.col(c).alias(c) for c in right.columns])
    schema = f"qid {id_t}, iid {id_t}, score double"

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"qid": lp["qid"].iloc[:0], "iid": rp["iid"].iloc[:0],
                                 "score": np.zeros(0)})
        S = V.stack(lp["qv"]) @ V.stack(rp["iv"]).T
        r_ids = rp["iid"].to_numpy()
        mask = lp["qid"].to_numpy()[:, None] == r_ids[None, :]
        rows, cols, sc, _ = V.top_k_rows(S, r_ids, k, True, mask)
        return pd.DataFrame({"qid": lp["qid"].to_numpy()[rows], "iid": r_ids[cols], "score": sc})

    keys = ["band", "bucket", "lb", "rb"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(kernel, schema)
    best = part.groupBy("qid", "iid").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("iid").asc())
    found = cut_lineage(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                        .select(F.col("qid").alias(id_col), "rank", F.col("iid").alias("nbr_id"),
                                "score"))
    full = found.filter(F.col("rank") == k).select(id_col)
    short = cut_lineage(df.select(id_col, vec).join(full, id_col, "left_anti"))
    exact = top_k(short, df, k, q_id=id_col, i_id=id_col, q_vec=vec, i_vec=vec, metric="cosine",
                  exclude=id_col, block_rows=block_rows)
    return found.join(full, id_col, "left_semi").unionByName(
        exact.select(id_col, F.col("rank").cast("int").alias("rank"), "nbr_id", "score"))
