"""Similarity join of documents by the Jaccard index of their word 5-grams.

A document's set holds 63-bit hashes of its distinct 5-grams in one global
order: light n-grams by hash, then heavy ones (found often within a task).
Equal sets are one class.  Two sets with Jaccard >= 3/4 share one of the first
n - ceil(3n/4) + 1 elements of each, so only those prefixes are shuffled, and
elements met in one class alone are dropped.  Candidate partners of a set are
held as a trie of their ordered n-grams, which the set traverses: partners with
a common beginning share its partial overlap, and a subtree is pruned when the
elements left cannot reach the overlap that is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import partitions_for, small_batches, texts
from dendra.operators.components import components
from dendra.session import cut_lineage

SHINGLE = 5
# Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
# An n-gram found in this many distinct sets within a window of n-grams of one
# task is heavy.  Only the global order depends on it, never the result.
HEAVY_COUNT, HEAVY_WINDOW, HEAVY_MAX = 8, 1 << 22, 200_000
# Prefix elements per shuffle partition, and ways a heavy element is split.
PREFIX_ROWS, HEAVY_SPLIT = 1_500_000, 64
# Rounds that test classes against a few pivots before the rest, and the
# pivots per class and round.  Only the work depends on them, never the result.
PIVOT_ROUNDS, PIVOTS = 2, 3

_ODD = [int(x) | 1 for x in np.random.default_rng(5).integers(1, 2**63, 2 * SHINGLE)]
_HEAVY_BIT = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the n-word shingles (words between
    ASCII white space, A-Z lower-cased); shorter texts give their whole
    sequence as one, texts without a word give none."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(n, len(ws))
    out = np.zeros(len(ws) - k + 1, np.uint64)
    for j in range(k):
        out += h[j:len(ws) - k + 1 + j] * np.uint64(_ODD[j + (0 if k == n else SHINGLE)])
    return np.unique(_mix(out + np.uint64(k)) >> np.uint64(1))


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set: its class."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def linked(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= PERCENT * (a + b - inter)


def trie_links(x: np.ndarray, partners: list[tuple[int, np.ndarray]]) -> list[int]:
    """The partners (key, ordered set) whose Jaccard index with ``x`` reaches
    the threshold.  The partners, sorted, are the trie's leaves from left to
    right; the traversal keeps the state of each node on the current path."""
    x = x.tolist()
    nx = len(x)
    need_x = -(-PERCENT * nx // 100)            # any partner needs this overlap
    out = []
    path: list[int] = []
    state = [(0, 0)]                            # (place in x, overlap) at each depth
    dead = None                                 # depth of a pruned node
    for s, key in sorted((p.tolist(), key) for key, p in partners):
        d, top = 0, min(len(path), len(s))
        while d < top and path[d] == s[d]:
            d += 1
        if dead is not None and d >= dead:
            continue                            # inside a pruned subtree
        dead = None
        del state[d + 1:]
        i, got = state[d]
        n = len(s)
        need = max(need_x, -(-PERCENT * (nx + n) // (100 + PERCENT)))
        path = s
        while d < n:
            if got + nx - i < need_x:
                dead = d
                break
            if got + min(n - d, nx - i) < need:
                break
            t = s[d]
            while i < nx and x[i] < t:
                i += 1
            if i < nx and x[i] == t:
                got += 1
                i += 1
            d += 1
            state.append((i, got))
        path = s[:d]
        if dead is None and linked(got, nx, n) and d == n:
            out.append(key)
    return out


def _profile_sets(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, key, key2, n, cls) per document, and (gram,
    cnt) for n-grams that are frequent within a task."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "key2", "n", "cls", "gram", "cnt"]
        window, held, seen = [], 0, set()

        def heavy():
            u, c = np.unique(np.concatenate(window), return_counts=True)
            u, c = u[c >= HEAVY_COUNT].view(np.int64), c[c >= HEAVY_COUNT]
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 5 + [pa.array(u), pa.array(c)], names)

        for b in batches:
            ns, cs = [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t)
                c = class_of(s)
                ns.append(len(s))
                cs.append(c if len(s) else None)
                if len(s) and c not in seen:
                    seen.add(c)
                    window.append(s)
                    held += len(s)
                if held >= HEAVY_WINDOW:
                    yield heavy()
                    window, held, seen = [], 0, set()
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), b.column("key2"), pa.array(ns, pa.int64()),
                 pa.array(cs, pa.int64()), none, none], names)
        if window:
            yield heavy()

    return docs.mapInArrow(scan, "doc_id long, key long, key2 long, n long, cls long, gram long, "
                           "cnt long")


def _ordered(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The set in global order: heavy elements get the top bit, so they come
    last."""
    if len(heavy) and len(s):
        at = np.searchsorted(heavy, s)
        at[at == len(heavy)] = 0
        s = np.sort(np.where(heavy[at] == s, s | _HEAVY_BIT, s))
    return s


def _prefixes(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(gram, cls, place in the set) of the prefix elements, once per class and
    task."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            grams, cls = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            pos = [np.empty(0, np.int32)]
            for t in b.column("text").to_pylist():
                s = shingle_set(t)
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                p = _ordered(s, heavy)[:prefix_length(len(s))]
                grams.append(p)
                cls.append(np.full(len(p), c, np.int64))
                pos.append(np.arange(len(p), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(cls)),
                 pa.array(np.concatenate(pos))], ["gram", "cls", "pos"])

    return docs.mapInArrow(scan, "gram long, cls long, pos int")


def _shared(prefixes: DataFrame, partitions: int) -> DataFrame:
    """The distinct prefix rows whose element is in several classes.  Heavy
    elements (negative as signed) are dealt ``HEAVY_SPLIT`` ways and all kept."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(x).to_numpy(zero_copy_only=False) for x in ("gram", "cls", "pos")]
               for b in batches]
        if not got:
            return
        g, c, p = (np.concatenate(x) for x in zip(*got))
        del got
        o = np.lexsort((c, g))
        g, c, p = g[o], c[o], p[o]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        g, c, p = g[first], c[first], p[first]
        if not len(g):
            return
        same = np.zeros(len(g), bool)
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= same[1:]
        ok = same | (g < 0)
        g, c, p = g[ok], c[ok], p[ok]
        for i in range(0, len(g), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 65536]) for x in (g, c, p)],
                                             ["gram", "cls", "pos"])

    way = F.when(F.col("gram") < 0, F.pmod("cls", F.lit(HEAVY_SPLIT))).otherwise(F.lit(0))
    return (prefixes.repartition(partitions, F.xxhash64("gram", way))
            .mapInArrow(keep, "gram long, cls long, pos int"))


def _sets_of(docs: DataFrame, wanted: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(cls, set) of the wanted classes (``key`` of one of its rows, ``cls``)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, sets = [], []
            for t, c in zip(b.column("text").to_pylist(), b.column("cls").to_pylist()):
                s = shingle_set(t)
                if class_of(s) == c:             # else another text with this key
                    cls.append(c)
                    sets.append(_ordered(s, heavy).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "set"])

    return (docs.join(wanted, "key").select("text", "cls")
            .mapInArrow(scan, "cls long, set binary").dropDuplicates(["cls"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that link.  ``b``'s partners form the trie."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(),
                       batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            out = []
            for b, group in groupby(rows, key=lambda r: r[0]):
                group = list(group)
                x = np.frombuffer(group[0][3], np.uint64)
                out += [(a, b) for a in trie_links(
                    x, [(r[1], np.frombuffer(r[2], np.uint64)) for r in group])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()),
                 pa.array([r[1] for r in out], pa.int64())], ["a", "b"])

    sa = sets.select(F.col("cls").alias("a"), F.col("set").alias("sa"))
    sb = sets.select(F.col("cls").alias("b"), F.col("set").alias("sb"))
    return (pairs.join(sa, "a").join(sb, "b").sortWithinPartitions("b")
            .mapInArrow(check, "a long, b long"))


def _overlap(a: str, b: str):
    """Common elements of a linked pair, at least, from its sizes."""
    return F.ceil(F.lit(PERCENT) * (F.col(a) + F.col(b)) / (100 + PERCENT))


def _needed(a: str, b: str):
    """Common prefix elements that a linked pair must have, from its sizes: its
    overlap is at most these plus what the shorter rest can give."""
    need = _overlap(a, b)
    rest = F.greatest(F.ceil(F.col(a) * PERCENT / 100), F.ceil(F.col(b) * PERCENT / 100)) - 1
    return F.greatest(F.lit(1), need - rest)


def _fits(a: str, b: str):
    return ((F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT))


def _pivot_pairs(at: DataFrame, first, step: int) -> DataFrame:
    """(a, b): each class with the ``PIVOTS`` pivots of another component that
    it shares most elements with.  An element's pivot is the class that comes
    first by ``first``, then by a hash that differs from step to step."""
    pivots = (at.groupBy("gram")
              .agg(F.min(F.struct(first.alias("o"), F.xxhash64("cls", F.lit(step)).alias("h"),
                                  "cls", "n", "comp")).alias("p"))
              .select("gram", F.col("p.cls").alias("b"), F.col("p.n").alias("nb"),
                      F.col("p.comp").alias("cb")))
    near = (at.join(pivots, "gram").filter((F.col("comp") != F.col("cb")) & _fits("n", "nb"))
            .groupBy(F.col("cls").alias("a"), "b")
            .agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("nb").alias("nb")))
    best = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    return (near.filter(2 * F.col("c") >= _needed("n", "nb"))
            .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PIVOTS)
            .select("a", "b"))


def _all_pairs(at: DataFrame) -> DataFrame:
    """(a, b): every two classes of different components whose sizes fit and
    that may link.  They meet at an element that can be their first common one:
    what is left of either set from there on must hold the whole overlap.  A
    class with too few elements left in blocks of several components (``k``)
    meets nobody."""
    at = at.drop("k").join(at.groupBy("cls").agg(F.count(F.lit(1)).alias("k")), "cls")

    def side(x: str) -> DataFrame:
        return at.select("gram", F.col("cls").alias(x), F.col("n").alias("n" + x),
                         F.col("comp").alias("c" + x), F.col("k").alias("k" + x),
                         (F.col("n") - F.col("pos")).alias("rest" + x))

    x, y = side("a"), side("b")
    return (x.join(y, (x["gram"] == y["gram"]) & F.expr("a < b AND ca <> cb") & _fits("na", "nb")
                   & (F.least("resta", "restb") >= _overlap("na", "nb"))
                   & (F.least("ka", "kb") >= _needed("na", "nb")))
            .select("a", "b").distinct())


def _keys() -> list:
    """Two hashes of a row's id and text; a null id counts as none."""
    return [F.xxhash64(F.lit(i), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                       F.coalesce(F.col("text"), F.lit(""))) for i in range(2)]


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, key, key2, n, comp) of every row; ``comp`` is the component's
    smallest class, null without words."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts(docs)
    docs = docs.select("*", *[k.alias(n) for k, n in zip(_keys(), ("key", "key2"))])
    scanned = cut_lineage(_profile_sets(docs))
    rows = scanned.filter(F.col("n").isNotNull()).select("doc_id", "key", "key2", "n", "cls")
    # at most HEAVY_MAX numbers
    heavy = np.sort(np.array([r[0] for r in (
        scanned.filter(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("cnt").alias("c"))
        .orderBy(F.desc("c"), "gram").limit(HEAVY_MAX).select("gram").collect())],
        np.int64).view(np.uint64))
    classes = cut_lineage(rows.filter("n > 0").groupBy("cls")
                          .agg(F.min("key").alias("key"), F.first("n").alias("n")))
    size = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    blocks = cut_lineage(_shared(_prefixes(docs, heavy),
                                 max(partitions_for(spark), -(-int(size) // PREFIX_ROWS)))
                         .join(classes.select("cls", "n"), "cls"))

    # share of a class's prefix that other classes have too: near 1 for the
    # middle of a group of copies, so these become the first pivots
    blocks = blocks.join(blocks.groupBy("cls").agg(F.count(F.lit(1)).alias("k")), "cls")
    middle = -F.floor(100 * F.col("k") / (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1))

    links, label, sets = None, None, None
    for step in range(PIVOT_ROUNDS + 1):
        at = blocks
        if label is not None:
            at = (blocks.join(label.withColumnRenamed("v", "cls"), "cls", "left")
                  .withColumn("comp", F.coalesce("comp", "cls")))
            mixed = at.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
                .filter("lo <> hi").select("gram")
            at = cut_lineage(at.join(mixed, "gram"))
        else:
            at = at.withColumn("comp", F.col("cls"))
        if step < PIVOT_ROUNDS:
            pairs = _pivot_pairs(at, middle if step == 0 else F.lit(0), step)
        else:
            pairs = _all_pairs(at)
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            continue
        wanted = (pairs.select(F.col("a").alias("cls"))
                  .unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
        if sets is not None:
            wanted = wanted.join(sets.select("cls"), "cls", "left_anti")
        more = cut_lineage(_sets_of(docs, wanted.join(classes.select("cls", "key"), "cls"), heavy))
        sets = more if sets is None else sets.unionByName(more)
        found = cut_lineage(_verified(pairs, sets))
        links = found if links is None else cut_lineage(links.unionByName(found))
        label = components(links)

    rows = rows.withColumn("comp", F.col("cls"))
    if label is not None:
        rows = (rows.drop("comp").join(label.withColumnRenamed("v", "cls"), "cls", "left")
                .withColumn("comp", F.coalesce("comp", "cls")))
    return rows.select("doc_id", "key", "key2", "n", "comp")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` (size of its set) and
    ``component_id`` (smallest doc_id reachable by links, itself included).

    Null and empty texts have empty sets and link with nothing.  Texts of
    fewer than five words are one shingle, so equal ones link.  Repeated rows
    each give a row; rows with a null id keep a null ``component_id`` only if
    nothing with an id is reachable.  An empty table gives an empty result.

    Exact: every pair with Jaccard >= 3/4 shares a prefix element.  Classes
    are first linked to a pivot of their shared elements (few pairs, which
    unite hot groups of near copies); then every remaining pair of classes in
    different components that shares enough prefix elements is verified.

    Scale: one slim row per document and the prefixes (about a quarter of all
    n-grams, 16 bytes each) are shuffled; whole sets only for classes in
    candidate pairs.  Groups are joined, never collected."""
    rows = cut_lineage(_members(docs))
    lowest = (rows.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    return (rows.join(lowest, "comp", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest id (null comes last),
    then the smallest hash of its text; of repeated rows with the same id and
    text one stays.  Rows without words all stay, and rows outside a component
    with several rows are not touched.

    Scale: rows are told apart by ``_keys``; only the keys of rows that go or
    are repeated meet the documents."""
    keys = (_members(docs).filter("n > 0").groupBy("comp", "key", "key2")
            .agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c")))
    keys = cut_lineage(keys)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "key2")
    first = (keys.groupBy("comp").agg(F.min(order).alias("o"), F.sum("c").alias("total"))
             .filter("total > 1").select("comp", F.col("o.key").alias("k"),
                                         F.col("o.key2").alias("k2")))
    known = keys.join(first, "comp")
    stays = (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2"))
    goes = known.filter(~stays).select(F.col("key").alias("_k"), F.col("key2").alias("_k2"))
    repeated = known.filter(stays & (F.col("c") > 1)) \
        .select(F.col("key").alias("_k"), F.col("key2").alias("_k2"))

    key, key2 = _keys()
    same = (key == F.col("_k")) & (key2 == F.col("_k2"))
    several = goes.unionByName(repeated)
    once = docs.join(several, same, "left_anti").select(docs.columns)
    # one whole row of each repeated key
    one = (docs.join(repeated, same).groupBy("_k", "_k2")
           .agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*"))
    return once.unionByName(one)
