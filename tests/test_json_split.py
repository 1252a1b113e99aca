"""The split reader against Python's own JSON parser, at split sizes that cut
elements, strings and escapes anywhere."""

import json
import random

import pytest
from pyspark.sql import types as T

from dendra import schemas
from dendra.sources import json_split, tables

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("inner", T.StructType([T.StructField("x", T.StringType()),
                                         T.StructField("ys", T.ArrayType(T.LongType()))])),
    T.StructField("list", T.ArrayType(T.StructType([T.StructField("a", T.StringType())])))])

PIECES = ['"', "\\", "}", "{", "[", "]", ",", ":", "}, {", '"}', "\\\"", "\n", "é", "😀", "word ", " " * 40]


def _rows(n, seed):
    rnd = random.Random(seed)

    def text():
        return "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(0, 30)))
    return [{"id": i, "text": text(), "inner": {"x": text(), "ys": [i, 2]},
             "list": [{"a": text()} for _ in range(rnd.randrange(0, 3))]} for i in range(n)]


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)

    def use(n):
        spark.conf.set(key, str(n))
    yield use
    spark.conf.set(key, old)


def _back(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("indent,ascii_only,split", [(None, True, 97), (2, False, 64), (None, False, 1000)])
def test_array_equals_a_whole_parse(spark, tmp_path, small_splits, indent, ascii_only, split):
    rows = _rows(60, split)
    for i in range(2):
        (tmp_path / f"f{i}.json").write_text(
            json.dumps(rows[i * 30:i * 30 + 30], indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    small_splits(split)
    got = json_split.read_elements(spark, str(tmp_path), SCHEMA)
    assert json_split._records(spark, str(tmp_path)).select("split_at").distinct().count() > 3
    assert _back(got) == rows


def test_lines_empty_arrays_and_repeated_elements(spark, tmp_path, small_splits):
    small_splits(50)
    rows = _rows(10, 5)
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    (tmp_path / "b.json").write_text(" [ ]\n")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text(json.dumps([rows[0], rows[0]]))
    got = _back(json_split.read_elements(spark, str(tmp_path), SCHEMA))
    assert got == sorted(rows + [rows[0], rows[0]], key=lambda r: r["id"])


def test_one_element_over_many_splits(spark, tmp_path, small_splits):
    small_splits(30)
    row = {"id": 1, "text": '{"}' * 400, "inner": None, "list": [{"a": str(i)} for i in range(50)]}
    (tmp_path / "a.json").write_text(json.dumps([row, dict(row, id=2)]))
    assert _back(json_split.read_elements(spark, str(tmp_path), SCHEMA)) == [row, dict(row, id=2)]


@pytest.mark.parametrize("n", [0, 1, 40])
def test_run_object_with_its_list(spark, tmp_path, small_splits, n):
    run = {"embedding_type": 'a "quoted" {[ name', "model": "m",
           "umap_params": {"n_components": 40, "n_neighbors": 5, "min_dist": 0.0, "metric": "cosine"},
           "assignments": [{"pmid": str(i), "cluster": i % 3 - 1, "confidence": i / 64,
                            "title": "}], " * (i % 4)} for i in range(n)],
           "metrics": {"n_clusters": 2, "silhouette": "N/A", "noise_pct": 20.0}}
    for i, indent in ((0, 2), (1, None)):
        (tmp_path / f"r{i}.json").write_text(json.dumps(run, indent=indent) + "\n" * i)
    small_splits(80)
    runs, asg = tables.read_run_result(spark, str(tmp_path))
    heads = runs.collect()
    assert len(heads) == 2
    for r in heads:
        assert r["embedding_type"] == run["embedding_type"] and r["umap_params"]["n_components"] == 40
        assert r["metrics"]["n_clusters"] == 2 and r["metrics"]["noise_pct"] == 20.0
        assert r["metrics"]["silhouette"] is None
    got = sorted((r["pmid"], r["cluster"], r["confidence"], r["title"]) for r in asg.collect())
    assert got == sorted((a["pmid"], a["cluster"], a["confidence"], a["title"])
                         for a in run["assignments"] * 2)
    assert {r["run_file"] for r in asg.collect()} <= {r["run_file"] for r in heads}


def test_articles_array_reads_like_the_whole_document(spark, tmp_path, small_splits):
    rows = [{"pmid": str(i), "title": "t" * i, "category": "c"} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    small_splits(100)
    a = tables.read_articles(spark, str(tmp_path / "a.json"))
    whole = spark.read.schema(schemas.ARTICLE).option("multiLine", True).json(str(tmp_path / "a.json"))
    assert a.schema == whole.schema and sorted(a.collect()) == sorted(whole.collect())
