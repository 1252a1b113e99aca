"""Lexical features: tokens, TF-IDF sparse vectors, vocabulary columns and an
offline dense embedding (signed random projection of TF-IDF).

A corpus is counted and weighed a document a row (``corpus_tfidf``): texts are split
in the JVM, their terms counted and weighed by Arrow batches, and only terms and their
document frequencies are shuffled.  The frequencies of at most ``KNOWN_TERMS`` terms,
the most frequent, reach every task; those of the others come back by joins, except
that a term not known from two documents or more has the frequency 1.
Document frequency is a partial-aggregated ``groupBy(term)``, so a stop word
present in every document costs one row per partition before the shuffle.
Term ids are stable 60-bit integers from MD5 (the same in Spark, SQL engines
and Python), standing in for the large hashed indices of a learned sparse
model.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.session import cut_lineage

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
DENSE_DIM = 64
# Fixed values of the projection hash (a Lehmer-style integer mix).
HASH_PRIME = 2147483647
HASH_A = 16807
HASH_B = 48271
HASH_C = 69621
# Terms whose document frequencies every task holds; documents weighed at once.
KNOWN_TERMS = 1 << 20
BATCH_DOCS = 2048


def term_id(term) -> F.Column:
    """First 15 hex digits of MD5(term) as BIGINT."""
    t = F.col(term) if isinstance(term, str) else term
    return F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long")


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term) rows, one per token occurrence, whole text."""
    return (docs.select(F.col(id_col).alias("doc_id"),
                        F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("term"))
            .filter(F.col("term") != ""))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tokens(docs, id_col, text_col).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf"))


def document_frequency(tc: DataFrame) -> DataFrame:
    """(term, df) plus the corpus size as column n_docs."""
    n_docs = tc.select("doc_id").distinct().count()
    return (tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .withColumn("n_docs", F.lit(n_docs).cast("long")))


def idf_column() -> F.Column:
    """Smoothed IDF: ln((1 + N) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)


def tfidf(tc: DataFrame, dfreq: DataFrame) -> DataFrame:
    """L2-normalised TF-IDF weight per (doc_id, term); terms without a
    document frequency (out of the corpus vocabulary) are dropped.  The
    document norm is a window over the document's terms (one shuffle by
    doc_id, no second pass over the term counts)."""
    w = (tc.join(dfreq, "term")
         .withColumn("raw", F.col("tf") * idf_column()))
    nrm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", term_id("term").alias("term_id"),
                    (F.col("raw") / nrm).alias("weight"))


def sparse_vectors(weights: DataFrame) -> DataFrame:
    """(doc_id, terms BIGINT[], weights DOUBLE[]) sorted by term id."""
    if by_document(weights):
        return weights.select("doc_id", F.col("term_id").alias("terms"), F.col("weight").alias("weights"))
    return (weights.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("_e"))
            .select("doc_id", F.col("_e.term_id").alias("terms"), F.col("_e.weight").alias("weights")))


def by_document(weights: DataFrame) -> bool:
    """Whether rows are documents with arrays of entries, not entries."""
    return isinstance(weights.schema["term_id"].dataType, T.ArrayType)


def entries(weights: DataFrame, *cols: str) -> DataFrame:
    """One row per (document, term): doc_id and ``cols`` (term, term_id and weight)."""
    cols = cols or ("term", "term_id", "weight")
    if not by_document(weights):
        return weights.select("doc_id", *cols)
    return weights.select("doc_id", F.inline(F.arrays_zip(*cols)))


def _flat_lists(column: pa.Array) -> tuple:
    """Length of every list (null: 0), and all values."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return lens, column.flatten()


def _lists(lens: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), values)


def document_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term[], tf[]) of every document with a term, its distinct terms and
    their counts; rows of one id count as one document.  A written table."""
    def count(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(s, BATCH_DOCS)
                lens, words = _flat_lists(part["words"])
                words = words.dictionary_encode()
                names = words.dictionary
                # documents x terms as numbers in the order of documents
                key = np.repeat(np.arange(len(lens)) * max(1, len(names)), lens) + words.indices.to_numpy()
                key, tf = np.unique(key, return_counts=True)
                row, code = np.divmod(key, max(1, len(names)))
                full = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code]
                row, code, tf = row[full], code[full], tf[full]
                lens = np.bincount(row, minlength=len(lens))
                out = pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "term": _lists(lens, names.take(pa.array(code))),
                    "tf": _lists(lens, pa.array(tf.astype(np.int64)))})
                yield out.filter(pa.array(lens > 0))

    id_t = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_t), T.StructField("term", T.ArrayType(T.StringType())),
                           T.StructField("tf", T.ArrayType(T.LongType()))])
    counted = cut_lineage(docs.select(F.col(id_col).alias("doc_id"),
                                      F.split(F.lower(F.col(text_col)), TOKEN_SPLIT).alias("words"))
                          .mapInArrow(count, schema))
    again = cut_lineage(counted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
                        .select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return counted
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    parts = counted.join(again, same, "left_semi").select("doc_id", F.inline(F.arrays_zip("term", "tf")))
    merged = (parts.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")).groupBy("doc_id")
              .agg(F.collect_list(F.struct("term", "tf")).alias("_e"))
              .select("doc_id", F.col("_e.term").alias("term"), F.col("_e.tf").alias("tf")))
    return cut_lineage(counted.join(again, same, "left_anti").unionByName(merged))


def _known_terms(seen: DataFrame) -> tuple:
    """Terms and idf of the largest document frequencies, at most KNOWN_TERMS, as a table
    (None: none), and the other rows of ``seen`` (term, df, idf; None: none)."""
    least = 2
    sizes = {r["df"]: r["n"] for r in seen.groupBy(F.least("df", F.lit(1 << 16)).alias("df"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}       # at most 2^16 rows
    total = sum(sizes.values())
    while total > KNOWN_TERMS:
        total -= sizes.get(least, 0)
        least += 1
    if not total:
        return None, seen if sizes else None
    known = seen.filter(F.col("df") >= least).select("term", "idf").toArrow()
    return known, seen.filter(F.col("df") < least) if least > 2 else None


def corpus_tfidf(docs: DataFrame, id_col: str, text_col: str):
    """TF-IDF weights of a corpus, a document a row (doc_id, term[], term_id[], weight[],
    in the order of term ids; ``entries`` has a row an entry), and its
    document-frequency table."""
    counted = document_terms(docs, id_col, text_col)
    n_docs = counted.count()
    dfreq = (counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
             .withColumn("n_docs", F.lit(n_docs).cast("long")))
    seen = cut_lineage(dfreq.filter(F.col("df") > 1).select("term", "df", idf_column().alias("idf")))
    known, rare = _known_terms(seen)
    spark = docs.sparkSession
    once = (spark.range(1).select(F.lit(1).cast("long").alias("df"), F.lit(n_docs).cast("long").alias("n_docs"))
            .select(idf_column()).first()[0])
    held = spark.sparkContext.broadcast(None if known is None else (
        known["term"].combine_chunks().cast(pa.string()), known["idf"].to_numpy()))
    rows = counted
    if rare is not None:        # frequencies too many to be held: back to their documents by joins
        more = (counted.select("doc_id", F.explode("term").alias("term")).join(rare.select("term", "idf"), "term")
                .groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("term", "idf")).alias("_e"))
                .select("_id", F.col("_e.term").alias("r_term"), F.col("_e.idf").alias("r_idf")))
        rows = counted.join(more, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    schema = T.StructType([counted.schema["doc_id"], T.StructField("term", T.ArrayType(T.StringType())),
                           T.StructField("term_id", T.ArrayType(T.LongType())),
                           T.StructField("weight", T.ArrayType(T.DoubleType()))])

    def weigh(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(s, BATCH_DOCS)
                lens, terms = _flat_lists(part["term"])
                terms = terms.dictionary_encode()
                names = terms.dictionary
                idf = np.full(len(names), once)
                tables = [] if held.value is None else [held.value]
                if "r_term" in part.schema.names:
                    tables.append((_flat_lists(part["r_term"])[1], _flat_lists(part["r_idf"])[1].to_numpy()))
                for some, values in tables:
                    at = pc.fill_null(pc.index_in(names, value_set=some), -1).to_numpy()
                    idf[at >= 0] = values[at[at >= 0]]
                ids = np.fromiter((int(hashlib.md5(t).hexdigest()[:15], 16) for t in names.cast(pa.binary()).to_pylist()),
                                  dtype=np.int64, count=len(names))
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), dtype=np.int64)
                place[order] = np.arange(len(ids))
                code = terms.indices.to_numpy()
                by = np.argsort(np.repeat(np.arange(len(lens)) * max(1, len(ids)), lens) + place[code])
                code = code[by]
                raw = _flat_lists(part["tf"])[1].to_numpy()[by] * idf[code]
                first = np.cumsum(lens) - lens
                norm = np.sqrt(np.add.reduceat(raw * raw, first)) if len(raw) else raw
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "term": _lists(lens, names.take(pa.array(code))),
                    "term_id": _lists(lens, pa.array(ids[code])),
                    "weight": _lists(lens, pa.array(raw / np.repeat(norm, lens)))})
    return rows.mapInArrow(weigh, schema), dfreq


def vocabulary_index(weights: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct terms numbered 0.. in term-id order (W7 / V3).

    A global ``row_number`` would run in one task; instead terms are range
    partitioned by id, counted per partition, and each partition adds the
    running total of the partitions before it."""
    vocab = entries(weights, "term", "term_id").select("term", "term_id").distinct()
    parts = partitions or max(1, vocab.sparkSession.sparkContext.defaultParallelism)
    ranged = cut_lineage(vocab.repartitionByRange(parts, "term_id")
                         .withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_off"))
    w = Window.partitionBy("_p").orderBy("term_id")
    return (ranged.withColumn("_r", F.row_number().over(w))
            .join(F.broadcast(offs), "_p")  # one row per partition
            .select("term", "term_id",
                    (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_r") - 1).cast("long").alias("col")))


def doc_term_triples(weights: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, col, val) with duplicate cells summed (CSR construction)."""
    # a column has one term id, by which the join has dealt the rows already
    return (entries(weights, "term_id", "weight").join(vocab.select("term_id", "col"), "term_id")
            .groupBy("doc_id", "term_id", "col").agg(F.sum("weight").alias("val")).drop("term_id"))


def corpus_sparsity(weights: DataFrame) -> DataFrame:
    """Documents, vocabulary size and mean non-zeros per document (1 decimal)."""
    a = entries(weights, "term").agg(F.count(F.lit(1)).alias("nnz"),
                    F.count_distinct("doc_id").cast("long").alias("n_docs"),
                    F.count_distinct("term").cast("long").alias("vocab_size"))
    return a.select("n_docs", "vocab_size", F.round(F.col("nnz") / F.col("n_docs"), 1).alias("avg_nnz"))


def query_tfidf(queries: DataFrame, id_col: str, text_col: str, dfreq: DataFrame) -> DataFrame:
    """TF-IDF of new texts against a corpus' document frequencies."""
    return tfidf(term_counts(queries, id_col, text_col), dfreq)


# --------------------------------------------------------------- dense embed

def _signs(tid: np.ndarray, dim: int) -> np.ndarray:
    """+-1 projection entries for term ids (rows) x dimensions (cols)."""
    a = (tid % HASH_PRIME)[:, None]
    j = np.arange(dim, dtype=np.int64)[None, :]
    h = (a * HASH_A + j * HASH_B + 1) % HASH_PRIME
    h = (h * HASH_C) % HASH_PRIME
    h = (h * HASH_B) % HASH_PRIME
    return np.where(h < HASH_PRIME // 2, 1.0, -1.0)


def dense_embed(sparse: DataFrame, dim: int = DENSE_DIM, id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """Offline default for the dense embedding service: signed random
    projection of the TF-IDF vector, L2-normalised.  Runs per Arrow batch
    (``mapInPandas``); a custom ``embed_fn`` can replace it.  ``keep`` returns the
    sparse vectors beside the dense ones, which saves a join."""
    out_schema = f"{id_col} {sparse.schema[id_col].dataType.simpleString()}, embedding array<double>"
    if keep:
        out_schema += ", terms array<long>, weights array<double>"

    def fn(batches):
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            lens = pdf["terms"].map(len).to_numpy()
            tid = np.concatenate([np.asarray(t, dtype=np.int64) for t in pdf["terms"]]) if lens.sum() else np.zeros(0, np.int64)
            w = np.concatenate([np.asarray(v, dtype=np.float64) for v in pdf["weights"]]) if lens.sum() else np.zeros(0)
            row = np.repeat(np.arange(n), lens)
            out = np.zeros((n, dim))
            step = 100_000
            for s in range(0, len(tid), step):
                # signs once per distinct term; a row's terms lie together
                terms, at = np.unique(tid[s:s + step], return_inverse=True)
                signs = _signs(terms, dim)
                for c in range(0, len(at), 8192):
                    contrib = signs[at[c:c + 8192]]
                    contrib *= w[s:s + step][c:c + 8192, None]
                    r = row[s:s + step][c:c + 8192]
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    out[r[first]] += np.add.reduceat(contrib, first, axis=0)
            nrm = np.sqrt((out * out).sum(axis=1))
            out = np.where(nrm[:, None] > 0, out / np.where(nrm[:, None] > 0, nrm[:, None], 1.0), out)
            held = {c: pdf[c].to_numpy() for c in ("terms", "weights")} if keep else {}
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(out), **held})

    return sparse.select(id_col, "terms", "weights").mapInPandas(fn, out_schema)
