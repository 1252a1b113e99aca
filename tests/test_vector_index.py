import os

import pytest
from pyspark.sql import functions as F

from dendra.sources import vector_index as VI

ARGS = {"key": "id", "vec": "vec", "meta": "topic"}
SCHEMA = "id long, vec array<double>, topic string"


def _rows(spark, ids, shift=0.0, topic=None):
    return spark.createDataFrame([(i, [float(i) + shift, 1.0], topic or f"t{i % 3}") for i in ids], SCHEMA)


def _all(spark, base, **kw):
    return {r["id"]: (r["vec"][0], r["topic"])
            for r in VI.read_index(spark, base, SCHEMA, meta="topic", **kw).collect()}


def _files(base):
    return {os.path.join(d, f) for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    base = str(tmp_path / "index")
    VI.create_index(_rows(spark, range(200)), base, buckets=16, **ARGS)
    old = _files(base + "/data")
    up = _rows(spark, [3, 500]).withColumn("batch", F.lit(2)).unionByName(
        _rows(spark, [3, 500], shift=9.0, topic="old").withColumn("batch", F.lit(1)))
    up = up.withColumn("vec", F.transform("vec", lambda x: x + 0.5))
    n = VI.upsert_index(up, base, order="batch", buckets=16, **ARGS)
    assert 1 <= n <= 2
    new = _files(base + "/data") - old
    assert len(new) == n and all("/v=1/" in f for f in new)      # nothing else was written
    want = {i: (float(i), f"t{i % 3}") for i in range(200)}
    want.update({3: (3.5, "t0"), 500: (500.5, "t2")})
    assert _all(spark, base) == want
    s = VI.index_stats(spark, base).first()
    assert (s["n_vectors"], s["min_dim"], s["max_dim"], s["n_values"], s["n_versions"]) == (201, 2, 2, 3, 2)


def test_a_failed_upsert_is_not_seen_and_can_be_repeated(spark, tmp_path):
    base = str(tmp_path / "index")
    VI.create_index(_rows(spark, range(20)), base, buckets=4, **ARGS)
    # data of version 1 without its manifest
    VI._write_version(_rows(spark, [77]).withColumn("bucket", F.lit(0)), base, 1, "id", "vec", "topic")
    assert set(_all(spark, base)) == set(range(20))
    VI.upsert_index(_rows(spark, [21]).withColumn("o", F.lit(1)), base, order="o", buckets=4, **ARGS)
    assert set(_all(spark, base)) == {*range(20), 21}


def test_metadata_filter_opens_only_buckets_that_hold_it(spark, tmp_path):
    base = str(tmp_path / "index")
    rows = _rows(spark, range(100)).withColumn("topic", F.when(F.col("id") == 42, "rare").otherwise("x"))
    VI.create_index(rows, base, buckets=16, **ARGS)
    r = VI.read_index(spark, base, SCHEMA, meta="topic", value="rare")
    assert len({os.path.dirname(f) for f in r.inputFiles()}) == 1
    assert [x["id"] for x in r.collect()] == [42]
    assert _all(spark, base, value="none") == {}
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    nn = VI.search_index(q, base, SCHEMA, 5, value="rare", **ARGS).collect()
    assert [x["nbr_id"] for x in nn] == [42]
    assert VI.search_index(q, base, SCHEMA, 5, value="none", **ARGS).collect() == []


def test_empty_null_and_repeated_rows(spark, tmp_path):
    base = str(tmp_path / "index")
    VI.create_index(_rows(spark, range(1)).limit(0), base, buckets=4, **ARGS)
    assert _all(spark, base) == {} and VI.index_stats(spark, base).first()["n_vectors"] == 0
    with pytest.raises(FileExistsError):
        VI.create_index(_rows(spark, range(1)), base, buckets=4, **ARGS)
    up = spark.createDataFrame([(None, [1.0], None, 1), (None, [2.0], None, 2), (5, None, "a", 1),
                                (5, None, "a", 1)], "id long, vec array<double>, topic string, o int")
    VI.upsert_index(up, base, order="o", buckets=4, **ARGS)
    VI.upsert_index(up.filter("id is null").withColumn("o", F.lit(3)).limit(1), base, order="o",
                    buckets=4, **ARGS)
    got = VI.read_index(spark, base, SCHEMA, meta="topic").collect()
    assert sorted((r["id"] is None, r["topic"]) for r in got) == [(False, "a"), (True, None)]
    assert VI.upsert_index(up.limit(0), base, order="o", buckets=4, **ARGS) == 0
    with pytest.raises(FileNotFoundError):
        VI.manifest(spark, str(tmp_path / "other"))
