"""License scans by MinHash bands over overlapping text windows.

Documents are read as windows of word 5-grams that overlap so that every place
a template may stand lies whole in one window.  A window and a template whose
smallest hashes agree under one of ``BANDS`` hash functions (one row a band)
are compared: the template is found if the window holds at least
``CONTAINMENT`` of its distinct 5-grams.  DataFrame functions only.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendra.llm.decontam import bit_table, filter_bits, marked, words
from dendra.session import cut_lineage

SHINGLE = 5
CONTAINMENT = 0.75
# A window is 1.5 units long and starts every half unit, with the unit the
# power of two from the template's length on: a whole template is at least a
# third of its window, so 16 bands of one row miss it with probability
# (2/3)^16 = 0.15 % at most, and one with 3/4 of its 5-grams with 1 %.
BANDS = 16
# Templates' band rows up to this many are broadcast.
BROADCAST_ROWS = 100_000

# License notices as they are published: (id, license, text).
TEMPLATES = (
    ("mit-line", "MIT", "Released under the MIT License."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-line", "GPL-3.0",
     "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit-grant", "MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions:"),
    ("bsd-redistribution", "BSD",
     "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met:"),
    ("apache-notice", "Apache-2.0",
     "you may not use this file except in compliance with the License. You may obtain a copy of "
     "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-notice", "GPL-3.0",
     "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("mpl-notice", "MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-line", "CC-BY-4.0",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def templates(spark: SparkSession) -> DataFrame:
    """The published notices as (template_id, license, text)."""
    return spark.createDataFrame(TEMPLATES, "template_id string, license string, text string")


def _shingle(ws: Column, p: Column) -> Column:
    return F.xxhash64(*[F.get(ws, p + k) for k in range(SHINGLE)])


def _shingles(ws: Column, first: Column, last: Column) -> Column:
    """Distinct hashes of the 5-grams at ``first`` .. ``last``."""
    return F.array_distinct(F.transform(F.sequence(first, last), lambda p: _shingle(ws, p)))


def _bands(hashes: Column) -> Column:
    """(band, smallest hash) under every hash function."""
    rng = random.Random(4)

    def low(seed: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*[F.struct(F.lit(b).alias("band"), low(rng.getrandbits(63)).alias("low"))
                     for b in range(BANDS)])


def find_licenses(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, template_id, license, n_windows, containment) for every document
    and template (``template_id``, ``license``, ``text``) found in it;
    ``containment`` is that of the best window.

    Templates of fewer than five words are ignored; null and empty texts hold
    none.  Repeated rows count once per (doc_id, template_id), their windows
    together.  Empty tables give an empty result.

    Scale: a Bloom filter of the templates' 5-grams marks the places that can
    matter, and only windows with enough of them for the shortest template of
    their length are hashed (others can't reach ``CONTAINMENT``).  Windows are
    probed and verified where they arise; matches leave as slim rows."""
    t = (wanted.select("template_id", "license", words(F.col("text")).alias("_ws"))
         .filter(F.size("_ws") >= SHINGLE)
         .withColumn("_ts", _shingles(F.col("_ws"), F.lit(0), F.size("_ws") - SHINGLE))
         .withColumn("_m", F.size("_ts"))
         .withColumn("_unit", F.greatest(F.lit(2), F.pow(F.lit(2), F.ceil(F.log2("_m")))).cast("int"))
         .withColumn("_need", F.ceil(F.col("_m") * CONTAINMENT).cast("int")).drop("_ws"))
    t = cut_lineage(t)
    # one row per power of two
    units = sorted((r[0], r[1]) for r in t.groupBy("_unit").agg(F.min("_need")).collect())
    grams = cut_lineage(t.select(F.explode("_ts").alias("_hash")))
    n_bits = filter_bits(grams.count())
    table = bit_table(grams, n_bits)
    banded = t.select("*", F.explode(_bands(F.col("_ts"))).alias("_b")).select("*", "_b.*").drop("_b")
    if banded.count() <= BROADCAST_ROWS:
        banded = F.broadcast(banded)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("_ws"))
    ws, n = F.col("_ws"), F.size("_ws")
    places = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(
        F.array().cast("array<int>"))
    hit = F.transform(marked(places, lambda p: _shingle(ws, p), table, n_bits), lambda x: x["p"])
    d = d.select("doc_id", "_ws", hit.alias("_at"))

    def windows(unit: int, need: int) -> Column:
        """Windows (start, unit, words) of one length with enough marked places."""
        half = unit // 2
        starts = F.array_distinct(F.flatten(F.transform("_at", lambda p: F.transform(
            F.array(*[F.lit(k) for k in range(3)]),
            lambda k: F.greatest(F.lit(0), F.floor(p / half).cast("int") - k) * half))))
        full = F.filter(starts, lambda s: F.size(F.filter(
            "_at", lambda p: (p >= s) & (p < s + 3 * half))) >= need)
        return F.transform(full, lambda s: F.struct(
            s.alias("start"), F.lit(unit).alias("_unit"),
            F.slice("_ws", s + 1, 3 * half + SHINGLE - 1).alias("_w")))


    if not units:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, template_id string, license string, n_windows long, "
                "containment double")
    # explode_outer: for explode, the optimizer would infer a filter on the
    # generator's input and so compute the hashes twice
    found = (d.select("doc_id", F.explode_outer(
                 F.concat(*[windows(u, k) for u, k in units])).alias("_c"))
             .filter(F.col("_c").isNotNull()).select("doc_id", "_c.*")
             .withColumn("_h", _shingles(F.col("_w"), F.lit(0), F.size("_w") - SHINGLE))
             .select("doc_id", "start", "_unit", "_h",
                     F.explode_outer(_bands(F.col("_h"))).alias("_b"))
             .select("doc_id", "start", "_unit", "_h", "_b.*")
             .join(banded, ["_unit", "band", "low"])
             .withColumn("containment", F.size(F.array_intersect("_h", "_ts")) / F.col("_m"))
             .filter(F.col("containment") >= CONTAINMENT))
    return (found.groupBy("doc_id", "template_id", "license", "start")
            .agg(F.max("containment").alias("containment"))
            .groupBy("doc_id", "template_id", "license")
            .agg(F.count(F.lit(1)).alias("n_windows"), F.max("containment").alias("containment")))
