"""Periodic runs of words, found tile by tile.

Periods are taken octave by octave: with step s, periods s to 2s - 1 (the
first octave takes 1 to 7 with step 4).  Positions i whose word equals word
i + p form stretches; a run of period p holds such a stretch of at least
max(p, 12 - p) positions, so it crosses a boundary, and every s words there is
one.  The words from s before to 3s after a boundary are its tile.  Two
Z-functions, forward from the boundary and backward from it, give for every
period of the octave how far the stretch reaches inside the tile.  Stretches
cut by their tiles touch and are stitched by (document, period).

Tiles that can't hold anything are left out first: at a boundary inside a
stretch, the s/2 words after or before it are repeated p further on, and that
is tested on hashes for all boundaries of many documents at once.  Equal words
have equal hashes, so no tile with a run is left out.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import partitions_for
from dendra.session import cut_lineage

LEAST_RUN = 12
FIRST_STEP = 4
# Words of documents that are tested together; words of one row of tiles.
TOGETHER = 1 << 19
SLAB = 1 << 13

NO_RUNS = hashlib.sha256(b"").hexdigest()


def words_of(doc_id: str | None, text: str | None) -> list[bytes]:
    """The document's words (``doc_id`` in decimal).  For one id in ten, all
    words from one place on become repeats of the first few there, as the
    registered query asks."""
    # bytes.split() cuts at exactly the six ASCII white-space characters
    words = text.encode().split() if text else []
    if not words or doc_id is None:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a:a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[:n - a]


def octaves(longest: int) -> Iterator[int]:
    """Steps whose periods fit twice into ``longest`` words."""
    s = FIRST_STEP
    yield s
    while 2 * (s := 2 * s) <= longest:
        yield s


def periods_of(step: int) -> tuple[int, int]:
    return (1 if step == FIRST_STEP else step), 2 * step


def candidate_boundaries(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(step, boundaries)`` that may lie in a stretch.  ``ids``: words of
    documents laid end to end, the longest first, each followed by a number of
    its own; ``starts``, ``ends``: their places."""
    level = ids.astype(np.uint64)
    lengths = ends - starts
    width = 1                                           # words that ``level`` hashes
    for step in octaves(int(lengths[0]) if len(lengths) else 0):
        while width < step // 2:
            more = np.zeros_like(level)
            more[:-width] = level[width:]
            level = level * np.uint64(0x9E3779B97F4A7C15) + (more ^ (more >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
            width *= 2
        docs = int(np.searchsorted(-lengths, -2 * max(step if step > FIRST_STEP else 1, LEAST_RUN // 2), "right"))
        if not docs:
            return
        n = int(ends[docs - 1]) + 1
        rows = n // step + 2
        flat = np.zeros(rows * step + width, np.uint64)
        flat[width:width + n] = level[:n]
        found = []
        for back in (0, width):                         # the words after, or before, the boundary
            grid = flat[width - back:][:rows * step].reshape(rows, step)
            at, p = np.nonzero(grid[1:] == grid[:-1, :1])
            p = p + step
            if step == FIRST_STEP:
                at2, p2 = np.nonzero(grid[:-1, 1:] == grid[:-1, :1])
                at, p = np.concatenate([at, at2]), np.concatenate([p, p2 + 1])
            b = at * step
            d = np.searchsorted(starts[:docs], b, "right") - 1
            ok = (d >= 0) & (b - back >= starts[d]) & (b + p - back + width <= ends[d])
            found.append(b[ok])
        yield step, np.unique(np.concatenate(found))


def slabs(ids, starts, ends) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Rows of neighbouring tiles: ``(document, step, first word, boundaries,
    words)``, places counted from the start of the document."""
    for step, bounds in candidate_boundaries(ids, starts, ends):
        docs = np.searchsorted(starts, bounds, "right") - 1
        i = 0
        while i < len(bounds):
            j, d = i + 1, docs[i]
            while (j < len(bounds) and docs[j] == d and bounds[j] - bounds[i] <= SLAB
                   and bounds[j] - bounds[j - 1] <= 4 * step):
                j += 1
            lo = max(starts[d], bounds[i] - step)
            hi = min(ends[d], bounds[j - 1] + 3 * step)
            yield int(d), step, int(lo - starts[d]), (bounds[i:j] - lo), ids[lo:hi]
            i = j


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common beginning of ``s`` and ``s[i:]``, each i."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def stretches(step: int, bounds: list[int], words: list[int]) -> dict[int, list[list[int]]]:
    """``period: [[from, to], ...]``: stretches of the tiles of one slab, those
    that touch joined, and those left out that end inside their tile and are
    too short."""
    out: dict[int, list[list[int]]] = defaultdict(list)
    low, high = periods_of(step)
    for b in bounds:
        ahead = z_function(words[b:b + 3 * step])
        behind = words[max(0, b - step):b][::-1]
        top = min(len(words), b + high - 1)             # words before the end of this are looked back from
        back = z_function(behind + [-1] + words[max(0, b - step):top][::-1])
        for p in range(low, min(high, len(words) - b + 1)):
            f = min(ahead[p], step) if p < len(ahead) else 0
            g = back[len(behind) + 1 + top - (b + p)] if behind else 0
            if f + g == 0 or (f < step and g < step and f + g < max(p, LEAST_RUN - p)):
                continue
            had = out[p]
            if had and had[-1][1] >= b - g:
                had[-1][1] = max(had[-1][1], b + f)
            else:
                had.append([b - g, b + f])
    return out


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents -> rows of tiles, the texts of documents that have some, and
    finished rows of those that have none."""
    from pyspark import TaskContext

    number = itertools.count(TaskContext.get().partitionId() << 40)

    def solve(group):
        group.sort(key=lambda x: -len(x[2]))
        code = defaultdict(itertools.count().__next__)
        sizes = np.array([len(w) for _, _, w in group], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        ids = np.full(int(sizes.sum()) + len(group), -1, np.int64)
        for (_, _, w), at in zip(group, starts):
            ids[at:at + len(w)] = np.fromiter(map(code.__getitem__, w), np.int64, len(w))
        gaps = starts + sizes
        ids[gaps] = -2 - np.arange(len(group))
        keys = [next(number) for _ in group]
        rows, open_ = [], set()
        for d, step, first, bounds, words in slabs(ids, starts, gaps):
            open_.add(d)
            rows.append((1, keys[d], None, None, None, step, first, bounds.astype(np.int32).tobytes(),
                         zlib.compress(words.astype(np.int32).tobytes(), 1)))
        for d, (doc_id, text, w) in enumerate(group):
            if d in open_:
                rows.append((0, keys[d], doc_id, text, None, None, None, None, None))
            else:
                rows.append((2, keys[d], doc_id, None, hashlib.sha256(b" ".join(w)).hexdigest(), None, None, None, None))
        return pd.DataFrame(rows, columns=PARTS, dtype=object).astype(
            {"kind": "int32", "key": "int64", "step": "Int32", "first": "Int64"})

    group, size = [], 0
    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"]):
            w = words_of(doc_id, text)
            group.append((doc_id, text, w))
            size += len(w) + 1
            if size >= TOGETHER:
                yield solve(group)
                group, size = [], 0
    if group:
        yield solve(group)


def _solve_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, step, first, bounds, words in zip(b["key"], b["step"], b["first"], b["bounds"], b["words"]):
            found = stretches(int(step), np.frombuffer(bounds, np.int32).tolist(),
                              np.frombuffer(zlib.decompress(words), np.int32).tolist())
            rows += [(key, p, first + x, first + y) for p, ivs in found.items() for x, y in ivs]
        yield pd.DataFrame(rows, columns=["key", "period", "x", "y"], dtype="int64")


def stitched_runs(fragments: DataFrame) -> DataFrame:
    """``key, start, length, period``: fragments of one document and period
    that overlap or touch become one; of runs over the same words the one with
    the smallest period stays (the others have a multiple of it)."""
    by = Window.partitionBy("key", "period").orderBy("x", "y")
    seen = F.max("y").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = (fragments.withColumn("_new", F.when(F.col("x") <= seen, 0).otherwise(1))
               .withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
               .groupBy("key", "period", "_island").agg(F.min("x").alias("start"), F.max("y").alias("_to")))
    return (islands.withColumn("length", F.col("_to") - F.col("start") + F.col("period"))
            .filter(F.col("length") >= F.greatest(F.lit(LEAST_RUN), 2 * F.col("period")))
            .groupBy("key", "start", "length").agg(F.min("period").alias("period")))


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text, starts, lengths, periods in zip(b["doc_id"], b["text"], b["starts"], b["lengths"], b["periods"]):
            words = words_of(doc_id, text)
            runs = [] if starts is None else sorted(zip(map(int, starts), map(int, lengths), map(int, periods)),
                                                    key=lambda r: (r[0], r[2]))
            best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
            drop = np.zeros(len(words) + 1, np.int64)
            for s, n, p in runs:
                drop[s + p] += 1
                drop[s + n] -= 1
            gone = np.cumsum(drop) > 0
            rows.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                         hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
                         hashlib.sha256(b" ".join(w for w, d in zip(words, gone) if not d)).hexdigest()))
        yield pd.DataFrame(rows, columns=OUT, dtype=object).astype({c: "Int64" for c in OUT[1:6]})


OUT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
OUT_SCHEMA = ", ".join(f"{c} {'string' if c.endswith('256') or c == 'doc_id' else 'long'}" for c in OUT)
PARTS = ["kind", "key", "doc_id", "text", "collapsed_sha256", "step", "first", "bounds", "words"]
PARTS_SCHEMA = ("kind int, key long, doc_id string, text string, collapsed_sha256 string, step int, first long, "
                "bounds binary, words binary")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_runs``, then ``start, length,
    period, exponent_milli`` of its longest run (null without one) and two
    hashes, of all runs and of the words left when every run keeps only its
    first period.

    ``docs``: ``doc_id``, ``text``; other columns are ignored.  Null and empty
    texts have no words and no runs; a null id is a document whose words stay as
    they are; repeated rows are documents of their own; an empty table gives an
    empty result.

    Scale: one pass over the texts writes the rows of tiles, the texts of
    documents that have any, and finished rows of all others.  Tiles are dealt
    out by (document, step, place), so a very long document is solved by many
    tasks; a tile has four times as many words as its step.  Fragments shuffle
    by (document, period); only texts with tiles are shuffled."""
    spark = docs.sparkSession
    parts = cut_lineage(docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"),
                                    F.col("text").cast("string").alias("text"))
                        .mapInPandas(_explode, PARTS_SCHEMA), partition_by="kind")
    tiles = (parts.filter("kind = 1").select("key", "step", "first", "bounds", "words")
             .repartition(partitions_for(spark), "key", "step", "first"))
    runs = (stitched_runs(tiles.mapInPandas(_solve_tiles, "key long, period long, x long, y long"))
            .groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"),
                                F.collect_list("period").alias("periods")))
    with_tiles = (parts.filter("kind = 0").select("key", "doc_id", "text").join(runs, "key", "left")
                  .select("doc_id", "text", "starts", "lengths", "periods").mapInPandas(_report, OUT_SCHEMA))
    none = F.lit(None).cast("long")
    without = parts.filter("kind = 2").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in OUT[2:6]],
        F.lit(NO_RUNS).alias("runs_sha256"), "collapsed_sha256")
    return with_tiles.unionByName(without).withColumn("doc_id", F.col("doc_id").cast("long"))
