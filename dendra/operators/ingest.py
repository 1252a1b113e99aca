"""Search hits -> clean, deduplicated articles under per-topic quotas.

Order matters and Spark has no row order, so every "first" rule carries its
key explicitly: (topic_id, query_no, rank).  First-per-key is a ``min`` of a
struct in a hash aggregate (partial aggregation: a key repeated across a
third of all rows costs one row per partition before the shuffle); quotas
are ``row_number`` with a literal bound, which Spark plans as a partial +
final ``WindowGroupLimit`` so a hot topic never sorts all its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.functions import text as TX
from dendra.session import cut_lineage

HIT_KEEP = ["topic", "query_no", "rank", "url", "title", "content", "description",
            "relevance_score"]


def clean_hits(hits: DataFrame, *, id_pattern: str = TX.PUBMED_ID_PATTERN,
               sources: tuple[str, ...] | None = (TX.PUBMED_SOURCE,),
               max_results: int = TX.MAX_RESULTS_PER_QUERY) -> DataFrame:
    """Validity filters, in the reference's order, before any dedup:

    source allow-list on the URL host, at most ``max_results`` hits per query,
    ID from the canonical URL (non-matching hits dropped), abstract by heading
    or description fallback (hits without one dropped - and *not* marked
    seen), title without the site suffix.

    Adds ``pmid``, ``url_clean``, ``abstract``, ``title_clean``."""
    h = hits
    if sources:
        host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
        ok = None
        for s in sources:
            c = (host == s) | host.endswith("." + s)
            ok = c if ok is None else (ok | c)
        h = h.filter(ok)
    if max_results:
        h = h.filter(F.col("rank") <= max_results)
    h = (h.withColumn("url_clean", TX.canonical_url("url"))
          .withColumn("pmid", TX.extract_id("url", id_pattern))
          .filter(F.col("pmid") != "")
          .withColumn("abstract", TX.extract_abstract("content", "description"))
          .filter(F.col("abstract").isNotNull() & (F.col("abstract") != ""))
          .withColumn("title_clean", TX.strip_title_suffix("title")))
    return h


def _with_topic_no(hits: DataFrame, topics: DataFrame) -> DataFrame:
    t = topics.select(F.col("name").alias("topic"), F.col("topic_id").alias("topic_no"),
                      "target")
    # topics is a small config table (one row per topic)
    return hits.join(F.broadcast(t), "topic")


def _first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the smallest ``order`` tuple per ``keys`` (hash aggregate of
    a struct min; ties cannot occur when ``order`` includes a unique key)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    s = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_m")
    return df.groupBy(*keys).agg(s).select(*keys, "_m.*")


def _max_target(topics: DataFrame) -> int:
    """Largest quota in the (small) topic config; a literal bound lets Spark
    plan the per-topic quota as a WindowGroupLimit."""
    v = topics.agg(F.max("target")).first()[0]
    return int(v or 0)


def first_seen(valid: DataFrame, topics: DataFrame) -> DataFrame:
    """Global first-seen-wins dedup by ID in (topic order, query, rank)."""
    h = _with_topic_no(valid, topics)
    return _first_per(h, ["pmid"], ["topic_no", "query_no", "rank"])


def quota_after_dedup(valid: DataFrame, topics: DataFrame) -> DataFrame:
    """Each topic takes its first ``target`` unique valid hits; then an ID
    already accepted by an earlier topic is removed (the topic may end short)."""
    h = _with_topic_no(valid, topics)
    per_topic = _first_per(h, ["topic", "pmid"], ["query_no", "rank"])
    bound = _max_target(topics)
    w = Window.partitionBy("topic").orderBy("query_no", "rank")
    quota = (per_topic.withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") <= bound)
             .filter(F.col("_rn") <= F.col("target")).drop("_rn"))
    return _first_per(quota, ["pmid"], ["topic_no", "query_no", "rank"])


def quota_before_dedup(valid: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics filled in order; an ID accepted by an earlier topic is skipped
    while filling, so a later hit takes its place.

    All topics propose together: each its first ``target`` hits still open to
    it.  An ID goes to the earliest topic that proposes it and closes for all
    later ones, which propose their next hits in the next round.  An ID only ever
    moves to an earlier topic, and all IDs rank topics alike, so the rounds end in
    the one stable outcome, which is that of filling topics one after the other.
    The number of jobs follows the longest chain of displaced hits, not the number
    of topics; a round is one window and one join over the hits still open."""
    h = _with_topic_no(valid, topics)
    bound = _max_target(topics)
    w = Window.partitionBy("topic").orderBy("query_no", "rank")
    still_open = cut_lineage(_first_per(h, ["topic", "pmid"], ["query_no", "rank"]))
    while True:
        proposed = (still_open.withColumn("_rn", F.row_number().over(w))
                    .filter(F.col("_rn") <= bound)
                    .filter(F.col("_rn") <= F.col("target")).drop("_rn"))
        proposed = cut_lineage(proposed)
        held = proposed.groupBy("pmid").agg(F.min("topic_no").alias("_held"),
                                            F.count(F.lit(1)).alias("_n"))
        if held.filter(F.col("_n") > 1).isEmpty():
            return proposed
        still_open = cut_lineage(
            still_open.join(held.drop("_n"), "pmid", "left")
            .filter(F.col("_held").isNull() | (F.col("topic_no") <= F.col("_held"))).drop("_held"))


def to_articles(accepted: DataFrame, category_col: str = "topic") -> DataFrame:
    """Accepted hits as article records."""
    return accepted.select(
        "pmid", F.col("title_clean").alias("title"), "abstract",
        F.col(category_col).alias("category"), F.col("url_clean").alias("url"),
        "relevance_score")


def quota_status(accepted: DataFrame, topics: DataFrame) -> DataFrame:
    """Per configured topic (empty ones included): accepted count, target and
    ``OK`` or ``SHORT by n``."""
    counts = accepted.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    t = topics.select("topic_id", F.col("name").alias("topic"), "target")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return (t.join(counts, "topic", "left")
            .select("topic_id", "topic", n.alias("n"), F.col("target").cast("long").alias("target"),
                    F.when(n >= F.col("target"), F.lit("OK"))
                    .otherwise(F.concat(F.lit("SHORT by "), (F.col("target") - n).cast("string")))
                    .alias("status")))


def sample_titles(accepted: DataFrame, per_topic: int = 2) -> DataFrame:
    """First ``per_topic`` titles of each topic, ASCII-safe."""
    w = Window.partitionBy("topic").orderBy("query_no", "rank")
    return (accepted.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= per_topic)
            .select("topic", F.col("_rn").cast("long").alias("n"), "pmid",
                    TX.ascii_safe("title_clean").alias("title")))


def upsert_latest(existing: DataFrame, updates: DataFrame, key: str = "id",
                  batch_col: str = "batch_no") -> DataFrame:
    """Keyed insert-or-replace: the latest update per key wins; keys not in
    the updates keep their existing row."""
    latest = _first_per(updates.withColumn("_neg", -F.col(batch_col)), [key],
                        ["_neg"]).drop("_neg", batch_col)
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*existing.columns))


def dim_check(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Vector count, min/max dimension and rows whose size differs from ``dim``."""
    size = F.size(F.col(vec))
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_vectors"),
                  F.min(size).cast("long").alias("min_dim"),
                  F.max(size).cast("long").alias("max_dim"),
                  F.count_if(size != dim).cast("long").alias("n_bad"),
                  (F.count_if(size != dim) == 0).alias("ok"))
