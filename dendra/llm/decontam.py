"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed pattern over consecutive words: some positions are ignored,
the others are hashed together.  Benchmark items and documents are hashed at
every position under every pattern, and the hashes are joined.  Around each
hit the words of document and item are compared along the diagonal, and the
pair is kept when a stretch of words agrees in at least ``MIN_SIMILARITY`` of
its positions.

No overlap that passes is lost.  Cut a stretch of 16 words into eight pairs: four
substitutions, the most that 0.75 allows, leave four whole, and two of those
lie one or two pairs apart (12 to 15 words: three substitutions, three pairs of
six).  So two patterns of four words, at every position, suffice for items of
12 words and more; two substitutions in 8 to 11 words need a third one, three
pairs apart, and one in 5 to 7 words any four of five words.

A document position is hashed in steps: only where the first two words of a
pattern may be those of a benchmark pattern is the whole pattern hashed, and
only where that may be the benchmark's does the position become a row.  Both
tests are Bloom filters, which drop nothing that matches.  DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendra.session import cut_lineage

# Fewest words compared, unless the item is shorter and compared whole.
SPAN = 12
# Items of fewer words match nothing.
MIN_WORDS = 5
# Item lengths (from, to) of each group of patterns.
GROUPS = {"long": (SPAN, None), "middle": (8, SPAN - 1), "short": (MIN_WORDS, 7)}
# Hashes of two words: (words between them, as the distance of the second).
PAIRS = {"_t1": 1, "_t2": 2}
# Patterns of a group: (first pair, second pair, distance, words spanned).
PATTERNS = {
    "long": [("_t1", "_t1", 2, 4), ("_t1", "_t1", 4, 6)],
    "middle": [("_t1", "_t1", 2, 4), ("_t1", "_t1", 4, 6), ("_t1", "_t1", 6, 8)],
    "short": [("_t1", "_t1", 2, 4), ("_t1", "_t1", 3, 5), ("_t1", "_t2", 2, 5), ("_t2", "_t1", 3, 5)],
}
EVERY = list(dict.fromkeys(x for g in PATTERNS.values() for x in g))
# Length of the stretch that is compared, and the share that must agree.
STRETCH = 16
MIN_SIMILARITY = 0.75
# Words on either side of a seed that are compared with the item.
REACH = 32
# Benchmark hashes up to this many rows (about 1 KB each) are broadcast.
BROADCAST_SEEDS = 100_000
# Bits of the pre-filter: 16 per benchmark hash, within these bounds.
MIN_BITS, MAX_BITS = 1 << 14, 1 << 24
NON_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def word_hashes(ws: Column) -> Column:
    """Each word hashed once, so that windows hash numbers."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def _pair(name: str, at: Column) -> Column:
    """Hash of the pair of words at a position, from the word hashes."""
    return F.xxhash64(F.lit(PAIRS[name]), F.get("_h", at), F.get("_h", at + PAIRS[name]))


def _pattern(pattern: tuple, at: Column) -> Column:
    """Hash of a pattern at a position.  Past the end of a text it lacks words
    and equals no item's."""
    first, second, by, _ = pattern
    return F.xxhash64(F.lit(EVERY.index(pattern)), _pair(first, at), _pair(second, at + by))


def _around(ws: Column, p: Column) -> Column:
    """The words from ``REACH`` before to ``REACH`` after the window at ``p``."""
    return F.slice(ws, F.greatest(p - REACH, F.lit(0)) + 1, SPAN + 2 * REACH)


def _item_seeds(items: DataFrame, groups: list[str]) -> DataFrame:
    """(hash of the pattern, of its first pair, item_id, words around it,
    position among them, words compared at least) of every item position under
    every pattern of its length."""
    p = F.col("_p")
    seeds = None
    for g in groups:
        low, high = GROUPS[g]
        own = (items.filter(F.col("_in").between(low, high or (1 << 30))).withColumn("_h", word_hashes(F.col("_iws")))
               .withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_in") - 1))))
        found = F.explode(F.array(*[F.struct(F.lit(x[3]).alias("span"), _pattern(x, p).alias("_hash"),
                                             _pair(x[0], p).alias("_first")) for x in PATTERNS[g]]))
        rows = (own.select("item_id", "_iws", "_in", "_p", found.alias("_s"))
                .filter(p + F.col("_s.span") <= F.col("_in")))
        seeds = rows if seeds is None else seeds.unionByName(rows)
    return seeds.select("_s._hash", "_s._first", "item_id", _around(F.col("_iws"), p).alias("_iws"),
                        F.least(p, F.lit(REACH)).alias("_ip"),
                        F.least("_in", F.lit(SPAN)).alias("_least"))


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * rows).bit_length()))


def bit_table(seeds: DataFrame, n_bits: int, column: str = "_hash") -> Column:
    """A two-probe Bloom filter of the hashes as a constant array of longs;
    at most ``MAX_BITS / 64`` rows come to the driver."""
    at = F.explode(F.array(*[_probe(F.col(column), i, n_bits) for i in range(2)]))
    rows = (seeds.select(at.alias("_bit"))
            .groupBy((F.col("_bit") / 64).cast("int").alias("i"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("v")).collect())
    table = [0] * (n_bits // 64)
    for r in rows:
        table[r["i"]] = r["v"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _probe(h: Column, i: int, n_bits: int) -> Column:
    return F.shiftrightunsigned(h, 32 * i).bitwiseAND(F.lit(n_bits - 1)).cast("int")


def maybe(h: Column, table: Column, n_bits: int) -> Column:
    """May the hash be among those of the table?"""
    hit = None
    for i in range(2):
        bit = _probe(h, i, n_bits)
        word = F.get(table, F.shiftright(bit, 6))
        one = F.getbit(word, bit.bitwiseAND(F.lit(63))) == 1
        hit = one if hit is None else hit & one
    return hit


def marked(places: Column, h, table: Column, n_bits: int) -> Column:
    """(p, h) of the places whose hash ``h(p)`` may be in the table; each hash
    is computed once."""
    hashed = F.transform(places, lambda p: F.struct(p.alias("p"), h(p).alias("h")))
    return F.filter(hashed, lambda x: maybe(x["h"], table, n_bits))


def _hits(docs: DataFrame, benchmark: DataFrame, *keys: str) -> DataFrame:
    """(keys, item_id, overlap, words matched, words compared) of the hits that
    agree well enough; ``docs`` has the keys and ``text``."""
    items = (benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("_iws"))
             .withColumn("_in", F.size("_iws")).filter(F.col("_in") >= MIN_WORDS).distinct())
    # at most one row a group
    group = F.when(F.col("_in") >= SPAN, "long").when(F.col("_in") >= 8, "middle").otherwise("short")
    groups = sorted(r[0] for r in items.select(group).distinct().collect()) or ["long"]
    seeds = cut_lineage(_item_seeds(items, groups))
    n_seeds = seeds.count()
    n_bits = filter_bits(n_seeds)
    whole, firsts = bit_table(seeds, n_bits), bit_table(seeds, n_bits, "_first")
    patterns = list(dict.fromkeys(x for g in groups for x in PATTERNS[g]))
    ws, p = F.col("_ws"), F.col("_p")
    # one row per word, made and tested in one generated loop; outer: for a
    # plain explode the optimizer filters its input and so hashes words twice
    d = docs.select(*keys, words(F.col("text")).alias("_ws")).withColumn("_h", word_hashes(ws))
    d = d.select(*keys, "_ws", "_h", F.posexplode_outer("_h").alias("_p", "_x"))
    may_start = None
    for name in dict.fromkeys(x[0] for x in patterns):
        test = maybe(_pair(name, p), firsts, n_bits)
        may_start = test if may_start is None else may_start | test
    found = F.array(*[F.when(maybe(h, whole, n_bits), h) for h in (_pattern(x, p) for x in patterns)])
    hits = (d.filter(may_start)
            .select(*keys, "_ws", "_p", F.explode_outer(found).alias("_hash"))
            .filter(F.col("_hash").isNotNull())
            .select(*keys, _around(ws, p).alias("_w"), F.least(p, F.lit(REACH)).alias("_p"), "_hash")
            .join(F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds, "_hash"))

    # words of item and document along the diagonal of the hit
    shift = F.col("_p") - F.col("_ip")
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size("_iws"), F.size("_w") - shift) - 1
    equal = F.transform(F.sequence(first, last),
                        lambda j: (F.get("_w", shift + j) == F.get("_iws", j)).cast("int"))
    add = (F.lit(0), lambda a, x: a + x)
    hits = (hits.filter(last - first + 1 >= F.col("_least"))
            .select(*keys, "item_id", equal.alias("_eq")))
    width = F.least(F.lit(STRETCH), F.size("_eq"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("_eq") - width),
                                   lambda j: F.aggregate(F.slice("_eq", j + 1, width), *add)))
    return (hits.select(*keys, "item_id", (best / width).alias("overlap"),
                        F.aggregate("_eq", *add).cast("long").alias("_m"),
                        F.size("_eq").cast("long").alias("_c"))
            .filter(F.col("overlap") >= MIN_SIMILARITY))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, n_compared, overlap) for every document
    that holds a benchmark item, or a stretch of one.

    ``n_matched`` of ``n_compared`` words agree around the best hit
    (``REACH`` words to either side); ``overlap`` is the best share of
    agreeing words in a stretch of ``STRETCH`` words (the compared words, if
    fewer).  A pair is kept at ``overlap`` >= ``MIN_SIMILARITY`` if at least
    ``SPAN`` words were compared.  Items of 5 to 11 words are compared whole;
    shorter items, null and empty texts match nothing.  Repeated rows and ids
    count once per (doc_id, item_id).  Empty tables give an empty result.

    Scale: hashing, probing and comparing run in one stage over the documents;
    two Bloom filters of the benchmark's hashes, at most ``MAX_BITS`` bits each,
    keep nearly all positions from reaching the join.  The hashes are broadcast up to
    ``BROADCAST_SEEDS`` rows (counted first), else joined by a shuffle.  Hits
    are compared where they arise and pre-aggregated per pair."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (_hits(docs, benchmark, "doc_id")
            # matched first, then the fewest compared, packed into one long each
            .groupBy("doc_id", "item_id")
            .agg(F.max(F.col("_m") * 1000 + 999 - F.col("_c")).alias("_b"),
                 F.max("overlap").alias("overlap"))
            .select("doc_id", "item_id", F.floor(F.col("_b") / 1000).alias("n_matched"),
                    (999 - F.col("_b") % 1000).alias("n_compared"), "overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item.  Whether one does follows
    from its text alone, so rows go by two hashes of the text and ids don't
    matter."""
    marks = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    taken = {c.lower() for c in docs.columns}
    keys = [next(n for n in (f"_mark{i}" + "_" * k for k in range(len(taken) + 1)) if n not in taken)
            for i in range(len(marks))]
    own = docs.select(*[m.alias(n) for m, n in zip(marks, keys)], "text")
    bad = _hits(own, benchmark, *keys).select(*keys).distinct()
    same = (marks[0] == bad[keys[0]]) & (marks[1] == bad[keys[1]])
    return docs.join(bad, same, "left_anti").select(docs.columns)
