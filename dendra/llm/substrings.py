"""Removal of byte strings that repeat anywhere in the corpus.

Two equal 400-byte strings hold the same smallest hash of their 24-byte
grams.  Every text is cut into runs of starts with the same smallest hash (the
anchor); a run with the bytes its strings cover is a region.  Equal strings lie
in regions of one anchor, so anchors are independent of each other: regions
found twice are repeated throughout, and the different regions of an anchor
are compared in suffix-array shards (see ``suffix``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import partitions_for, small_batches, texts
from dendra.llm.suffix import repeated_starts
from dendra.session import cut_lineage

LENGTH, GRAM = 400, 24
# Bytes a suffix-array shard; an anchor with more in its different regions is
# compared by hashes of all its strings instead.
SHARD_BYTES, ANCHOR_BYTES = 2 << 20, 8 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Polynomial hashes of any substrings of ``data``."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sum = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * _power(_BASE, len(b)), out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _power(_INVERSE, len(self.sum))
        return _mix((self.sum[end] - self.sum[start]) * inv[start]
                    + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sum) - size
        return _mix((self.sum[size:] - self.sum[:n]) * _power(_INVERSE, n) + np.uint64(size))


def _sliding(x: np.ndarray, w: int, f, fill) -> np.ndarray:
    """f (minimum or maximum) over every window of ``w`` values."""
    n = len(x)
    pad = np.full(-n % w, fill, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    left = f.accumulate(blocks, axis=1).ravel()
    right = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[:n - w + 1], left[w - 1:n])


def regions(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchor, region hash, first start, last start, repeats inside?) arrays."""
    h = _Hashes(data)
    g = h.all(gram)
    w = length - gram + 1
    low = _sliding(g, w, np.minimum, np.uint64(2**64 - 1))
    cut = np.flatnonzero(low[1:] != low[:-1])
    first = np.concatenate([[0], cut + 1])
    last = np.concatenate([cut, [len(low) - 1]])
    anchor = low[first]
    # grams that are the smallest of some window; an anchor found twice may
    # repeat inside one region
    pad = np.zeros(w - 1, np.uint64)
    top = _sliding(np.concatenate([pad, low, pad]), w, np.maximum, np.uint64(0))
    u, c = np.unique(g[g == top], return_counts=True)
    twice = np.isin(anchor, u[c > 1])
    return anchor, h.of(first, last + length), first, last, twice


def _region_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Regions of the distinct texts of each task."""
    names = ["anchor", "region", "tkey", "first", "last", "twice"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            out = []
            for t, key in zip(b.column("text").to_pylist(), b.column("tkey").to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                if len(data) < length or key in seen:
                    continue
                seen.add(key)
                a, r, f, e, tw = regions(data, length, gram)
                out.append((a.view(np.int64), r.view(np.int64), np.full(len(a), key, np.int64),
                            f.astype(np.int32), e.astype(np.int32), tw))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*out)], names)

    return docs.select("text", "tkey").mapInArrow(
        cut, "anchor long, region long, tkey long, first int, last int, twice boolean")


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(),
                    starts[np.concatenate([cut, [len(starts) - 1]])].tolist()))


_PIECE = "anchor long, region long, bytes binary"
_FOUND = "anchor long, region long, a int, b int"


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
        ["anchor", "region", "a", "b"])


def _pieces(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted regions, one representative each."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["anchor"] for w in want], pa.int64()),
                     pa.array([w["region"] for w in want], pa.int64()),
                     pa.array([data[w["first"]:w["last"] + length] for w in want], pa.binary())],
                    ["anchor", "region", "bytes"])

    # regions of one text: bounded by its length
    wants = reps.groupBy("row_id", "tkey").agg(
        F.collect_list(F.struct("anchor", "region", "first", "last")).alias("want"))
    return docs.join(wants, ["row_id", "tkey"]).select("text", "want").mapInArrow(cut, _PIECE)


def _by_suffix_array(pieces: DataFrame, shards: int, length: int) -> DataFrame:
    """Repeated starts of the regions, anchors sharded by hash."""
    def sort(table: pa.Table) -> pa.Table:
        rows = {}
        for a, r, data in zip(*(table.column(c).to_pylist() for c in ("anchor", "region", "bytes"))):
            rows[a, r] = data
        keys = sorted(rows)
        found = repeated_starts([rows[k] for k in keys], length)
        return pa.Table.from_batches([_found_batch(
            [(*k, a, b) for k, starts in zip(keys, found) for a, b in _runs(starts)])])

    return (pieces.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
            .applyInArrow(sort, _FOUND))


def _by_hashes(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated starts of the regions of very large anchors: every string's
    hash is counted, pre-aggregated, so no task holds an anchor's regions."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, r, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "region", "bytes"))):
                h = _Hashes(data).all(length).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * n, pa.int64()), pa.array([r] * n, pa.int64()), pa.array(h),
                     pa.array(np.arange(n, dtype=np.int32))], ["anchor", "region", "h", "a"])

    rows = pieces.dropDuplicates(["anchor", "region"]).mapInArrow(
        explode, "anchor long, region long, h long, a int")
    again = (rows.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
             .select("anchor", "h"))
    return rows.join(again, ["anchor", "h"]).select("anchor", "region", "a", F.col("a").alias("b"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` (of the bytes left) and
    ``spans`` (the removed byte ranges as (start, end)).

    A byte goes if a ``length``-byte string that covers it also starts anywhere
    else, in the same or any other document; strings are judged on the input.
    Null texts count as empty; texts shorter than ``length`` keep everything;
    repeated rows are documents that repeat each other.  An empty table gives
    an empty result.

    Equal texts are one (their strings all repeat).  Regions found once under
    an anchor found once never leave the first aggregation.  ``ANCHOR_BYTES``
    bounds what one task sorts; larger anchors are compared by 64-bit hashes
    of their strings, which gives the same starts."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = (texts(docs).withColumn("tkey", F.xxhash64("text"))
            .withColumn("row_id", F.coalesce("doc_id", F.lit(-1 << 63))))
    same_text = docs.groupBy("tkey").agg(F.count(F.lit(1)).alias("copies"),
                                         F.min("row_id").alias("row_id"))
    rows = cut_lineage(_region_rows(docs, length, gram))
    per_anchor = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"),
                                            F.max("twice").alias("any_twice"))
    shared = cut_lineage(rows.join(per_anchor.filter("c > 1 OR any_twice").select("anchor"), "anchor"))
    distinct = cut_lineage(shared.groupBy("anchor", "region").agg(
        F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice"),
        F.min(F.struct("tkey", "first", "last")).alias("rep")))
    mixed = (distinct.groupBy("anchor")
             .agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("any_twice"),
                  F.sum(F.col("rep.last") - F.col("rep.first") + length).alias("size"))
             .filter("k > 1 OR any_twice").select("anchor", "size"))
    reps = cut_lineage(distinct.join(mixed, "anchor")
                       .select("anchor", "region", "size", "rep.*")
                       .join(same_text.select("tkey", "row_id"), "tkey"))
    total = reps.agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    small = reps.filter(F.col("size") <= anchor_bytes)
    large = reps.filter(F.col("size") > anchor_bytes)
    shards = max(partitions_for(spark), math.ceil(total / shard_bytes))
    found = _by_suffix_array(_pieces(docs, small, length), shards, length)
    if not large.isEmpty():
        found = found.unionByName(_by_hashes(_pieces(docs, large, length), length))

    at = shared.join(distinct.select("anchor", "region", "c"), ["anchor", "region"])
    whole = at.filter("c > 1").select("tkey", F.col("first").alias("a"), F.col("last").alias("b"))
    parts = (at.filter("c = 1").join(found, ["anchor", "region"])
             .select("tkey", (F.col("first") + F.col("a")).alias("a"),
                     (F.col("first") + F.col("b")).alias("b")))
    # starts of one text: bounded by its length
    marks = (whole.unionByName(parts).distinct().groupBy("tkey")
             .agg(F.collect_list(F.struct("a", "b")).alias("starts")))
    marks = (same_text.filter("copies > 1").select("tkey", F.lit(True).alias("copied"))
             .join(marks, "tkey", "full"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        for b in batches:
            out = []
            for t, starts, copied in zip(*(b.column(c).to_pylist()
                                           for c in ("text", "starts", "copied"))):
                data = t.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                if copied and len(data) >= length:
                    spans = [[0, len(data)]]
                else:
                    for s in sorted((x["a"], x["b"] + length) for x in starts or []):
                        if spans and s[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], s[1])
                        else:
                            spans.append(list(s))
                digest, at_ = hashlib.sha256(), 0
                for s, e in spans:
                    digest.update(data[at_:s])
                    at_ = e
                digest.update(data[at_:])
                out.append((len(data), sum(e - s for s, e in spans), len(spans),
                            digest.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return (docs.join(marks, "tkey", "left").select("doc_id", "text", "starts", "copied")
            .mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                               "kept_sha256 string, spans array<struct<start:int,end:int>>"))
