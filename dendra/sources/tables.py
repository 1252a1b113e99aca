"""Readers for the reference's JSON shapes and adapters that present the
driver's test tables in those shapes.

Adapters only rename and lift fields into the schema the operators expect;
they do none of the operators' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendra import schemas
from dendra.sources import json_split

# URL shape of the driver's `pages` table: host/<lang>/<numeric id>...
PAGES_ID_PATTERN = r"/[a-z]{2}/(\d+)"


def table_glob(sf_dir: str, name: str) -> str:
    """Path pattern a file stream can watch for one driver table."""
    return f"{sf_dir.rstrip('/')}/{name}*.parquet"


# ----------------------------------------------------------------- JSON inputs
# Arrays are read in splits (``json_split``); ``multi_line=False`` reads JSON
# lines with Spark's own reader.

def _read_json(spark: SparkSession, path: str, schema, multi_line: bool) -> DataFrame:
    if multi_line:
        return json_split.read_elements(spark, path, schema)
    return spark.read.schema(schema).json(path)


def read_articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Articles from a JSON array, or from JSON lines with ``multi_line=False``."""
    return _read_json(spark, path, schemas.ARTICLE, multi_line)


def read_dense_embeddings(spark: SparkSession, path: str, multi_line: bool = True,
                          drop: tuple[str, ...] = ()) -> DataFrame:
    """Dense embeddings; ``drop`` names metadata keys that are left out."""
    meta = F.col("metadata").dropFields(*drop) if drop else F.col("metadata")
    return (_read_json(spark, path, schemas.DENSE_EMBEDDING, multi_line)
            .select("id", "values", "metadata.category", "metadata.title",
                    meta.alias("metadata")))


def read_sparse_embeddings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _read_json(spark, path, schemas.SPARSE_EMBEDDING, multi_line)


def read_run_result(spark: SparkSession, path: str):
    """Run-result objects, one a file -> (a params+metrics row per run, flat
    assignments); ``run_file`` tells the runs apart.  A run's list of
    assignments is read in splits, never as one row."""
    heads, items = json_split.read_object_with_list(spark, path, schemas.RUN_RESULT, "assignments")
    return heads.withColumnRenamed("file", "run_file"), items.withColumnRenamed("file", "run_file")


# ------------------------------------------------------------ test-table adapters

def pages_as_hits(pages: DataFrame) -> DataFrame:
    """Raw pages as search-API hits (schema ``SEARCH_HIT`` plus ``page_id``).

    topic = the page's declared language; a page's position is its id:
    query_no = page_id div 20, rank = page_id mod 20 + 1 (each query returns
    up to 20 hits); content = the raw html; description = the article text
    with tags removed; no relevance score is available."""
    html = F.col("html")
    return pages.select(
        F.regexp_extract(html, r'<html lang="([^"]+)"', 1).alias("topic"),
        F.floor(F.col("page_id") / 20).cast("int").alias("query_no"),
        (F.pmod(F.col("page_id"), F.lit(20)) + 1).cast("int").alias("rank"),
        F.col("url"),
        F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        html.alias("content"),
        F.regexp_replace(F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1),
                         r"<[^>]+>", " ").alias("description"),
        F.lit(None).cast("double").alias("relevance_score"),
        F.col("page_id"))


def topics_from_hits(hits: DataFrame, target: int) -> DataFrame:
    """Topic config (topic_id in name order, one target for all) for hits
    whose topics are not configured elsewhere."""
    names = hits.select(F.col("topic").alias("name")).distinct()
    return names.select(
        F.dense_rank().over(Window.orderBy("name"))
        .cast("int").alias("topic_id"),
        "name", F.lit(target).cast("int").alias("target"),
        F.array().cast("array<string>").alias("queries"))


def pages_as_pubmed_hits(pages: DataFrame) -> DataFrame:
    """Raw pages as PubMed search hits in the shapes such hits take: pages of
    other hosts and pages without an ID, IDs met twice, 25 hits a query, titles
    with and without the site suffix, abstracts under a heading, empty ones,
    descriptions only, short ones, and nulls.  Shapes follow the page id."""
    html, p = F.col("html"), F.col("page_id")
    host = F.lit("https://pubmed.ncbi.nlm.nih.gov/")
    title = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    article = F.regexp_replace(F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1),
                               r"<[^>]+>", " ")
    tail = F.when(p % 2 == 0, F.lit("\n## Keywords\n\nnone")).otherwise(F.lit(""))
    return pages.select(
        F.regexp_extract(html, r'<html lang="([^"]+)"', 1).alias("topic"),
        F.floor(p / 25).cast("int").alias("query_no"),
        (F.pmod(p, F.lit(25)) + 1).cast("int").alias("rank"),
        F.when(p % 7 == 0, F.concat(F.lit("https://example.org/"), p.cast("string")))
        .when(p % 7 == 1, F.concat(host, F.lit("about/")))
        .when(p % 7 == 2, F.concat(host, F.floor(p / 4).cast("string"), F.lit("/?term=x")))
        .otherwise(F.concat(host, p.cast("string"), F.lit("/"))).alias("url"),
        F.when(p % 11 != 0, F.concat(
            title, F.when(p % 2 == 0, F.lit(" - PubMed")).otherwise(F.lit("")))).alias("title"),
        F.when(p % 13 == 0, F.lit(None).cast("string"))
        .when(p % 3 == 0, F.concat(F.lit("# Page\n\n## Abstract\n\n"), article, tail))
        .when(p % 5 == 0, F.lit("## Abstract\n\n"))
        .otherwise(F.lit("no heading")).alias("content"),
        F.when(p % 17 == 0, F.lit(None).cast("string"))
        .when(p % 4 == 0, F.lit("short")).otherwise(article).alias("description"),
        F.lit(None).cast("double").alias("relevance_score"),
        p)


def embeddings_as_run(emb: DataFrame) -> DataFrame:
    """The embeddings table as a stored run (id, cluster, confidence, label):
    every sixth id is noise, every ninth is not part of the run."""
    i = F.col("vec_id")
    return emb.filter(i % 9 != 0).select(
        i.alias("id"), F.when(i % 6 == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("cluster"),
        ((i * 37) % 101 / F.lit(100.0)).alias("confidence"), "label")


def parts_as_sweep(part: DataFrame) -> DataFrame:
    """The part table as sweep results (schema ``SWEEP_ROW`` plus grid_pos)."""
    k, s = F.col("p_partkey").cast("long"), F.col("p_size")

    def pick(values, at):
        return F.get(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int"))
    return part.select(
        k.alias("grid_pos"), pick([2, 5, 10, 20, 40, 60], s).alias("umap_dims"),
        pick([3, 5, 10, 15], k).alias("umap_neighbors"),
        pick([0.0, 0.05, 0.1], k).alias("umap_min_dist"),
        pick([3, 5, 8, 10], s).alias("hdbscan_min_cs"), pick(["eom", "leaf"], k).alias("hdbscan_method"),
        s.alias("clusters"), (k % 40).cast("double").alias("noise_pct"),
        ((k * 31 % 50) / F.lit(50.0)).alias("silhouette"), F.lit(1.0).alias("davies_bouldin"),
        F.least(F.lit(1.0), (k * 7919 % 110) / F.lit(100.0)).alias("ari"), F.lit(0.9).alias("avg_conf"))
