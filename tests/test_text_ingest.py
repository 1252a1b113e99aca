import random

import pytest
from pyspark.sql import functions as F

from dendra.functions import text as TX
from dendra.operators import ingest

HEAD = "## Abstract\n\n"


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)],
                               ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


def test_abstract_cases(spark):
    body = "Background text.\nMore."
    assert _one(spark, TX.extract_abstract("c", "d"), c=HEAD + body + "\n## Methods\n\nx", d="") == body
    assert _one(spark, TX.extract_abstract("c", "d"), c=HEAD + "  " + body + "  ", d="") == body
    # heading directly followed by the next heading: empty, no fallback
    assert _one(spark, TX.extract_abstract("c", "d"), c=HEAD + "\n## Methods\n\nx", d="y" * 100) == ""
    # no heading: description fallback needs more than 80 characters after strip
    assert _one(spark, TX.extract_abstract("c", "d"), c="text", d=" " + "a" * 80 + " ") is None
    assert _one(spark, TX.extract_abstract("c", "d"), c="text", d="a" * 81) == "a" * 81
    assert _one(spark, TX.extract_abstract("c", "d"), c=None, d="b" * 90) == "b" * 90


def test_title_suffix_and_strip(spark):
    assert _one(spark, TX.strip_title_suffix("t"), t="Heart study - PubMed") == "Heart study"
    # suffix followed by a blank is not a suffix: kept, then stripped
    assert _one(spark, TX.strip_title_suffix("t"), t="Heart study - PubMed ") == "Heart study - PubMed"
    assert _one(spark, TX.strip_title_suffix("t"), t="\t Title \n") == "Title"


def test_url_and_id(spark):
    u = "https://pubmed.ncbi.nlm.nih.gov/12345/?from=x#frag"
    assert _one(spark, TX.canonical_url("u"), u=u) == "https://pubmed.ncbi.nlm.nih.gov/12345/"
    assert _one(spark, TX.extract_id("u"), u=u) == "12345"
    assert _one(spark, TX.extract_id("u"), u="https://www.ncbi.nlm.nih.gov/pmc/articles/PMC1/") == ""
    assert _one(spark, TX.ascii_safe("t"), t="Sjögren’s") == "Sj?gren?s"


def _hits(spark, rows):
    return spark.createDataFrame(
        [(t, q, r, f"https://pubmed.ncbi.nlm.nih.gov/{pid}/", f"T{pid} - PubMed",
          (HEAD + "abs " + str(pid)) if has else "", "", 1.0) for t, q, r, pid, has in rows],
        "topic string, query_no int, rank int, url string, title string, content string, "
        "description string, relevance_score double")


def _topics(spark, targets):
    return spark.createDataFrame([(i + 1, n, t, []) for i, (n, t) in enumerate(targets)],
                                 "topic_id int, name string, target int, queries array<string>")


def test_quota_modes_differ(spark):
    # topic a (first) and b share id 1; b's quota is 1
    rows = [("a", 0, 1, 1, True), ("a", 0, 2, 2, True),
            ("b", 0, 1, 1, True), ("b", 0, 2, 3, True)]
    valid = ingest.clean_hits(_hits(spark, rows))
    topics = _topics(spark, [("a", 2), ("b", 1)])
    after = {(r["topic"], r["pmid"]) for r in ingest.quota_after_dedup(valid, topics).collect()}
    before = {(r["topic"], r["pmid"]) for r in ingest.quota_before_dedup(valid, topics).collect()}
    assert after == {("a", "1"), ("a", "2")}                   # b took 1, then lost it: short
    assert before == {("a", "1"), ("a", "2"), ("b", "3")}      # b skipped 1 and took 3
    st = {r["topic"]: r["status"] for r in ingest.quota_status(
        ingest.quota_after_dedup(valid, topics), topics).collect()}
    assert st == {"a": "OK", "b": "SHORT by 1"}


def test_hit_without_abstract_not_marked_seen(spark):
    rows = [("a", 0, 1, 7, False), ("a", 1, 1, 7, True)]
    valid = ingest.clean_hits(_hits(spark, rows))
    got = ingest.first_seen(valid, _topics(spark, [("a", 10)])).collect()
    assert [(r["pmid"], r["query_no"]) for r in got] == [("7", 1)]


def test_upsert_latest(spark):
    ex = spark.createDataFrame([(1, "old"), (2, "keep")], "id long, v string")
    up = spark.createDataFrame([(1, "new1", 1), (1, "new2", 2), (3, "ins", 1)],
                               "id long, v string, batch_no int")
    got = {r["id"]: r["v"] for r in ingest.upsert_latest(ex, up).collect()}
    assert got == {1: "new2", 2: "keep", 3: "ins"}


def _filled_in_order(hits, quotas):
    """Topics one after the other, as a plain loop."""
    seen, out = set(), set()
    for topic, target in quotas:
        n = 0
        for t, _, _, pmid in sorted(h for h in hits if h[0] == topic):
            if n < target and pmid not in seen:
                seen.add(pmid)
                out.add((t, pmid))
                n += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quota_before_dedup_equals_filling_in_order(spark, seed):
    rnd = random.Random(seed)
    quotas = [(f"t{i}", rnd.randrange(0, 6)) for i in range(9)]
    hits = [(t, q, r, str(rnd.randrange(30))) for t, _ in quotas for q in range(3) for r in range(6)]
    hits += [("t1", 9, r, h[3]) for r, h in enumerate(hits[:4])]          # met again later
    valid = spark.createDataFrame(hits, "topic string, query_no int, rank int, pmid string")
    got = ingest.quota_before_dedup(valid, _topics(spark, quotas)).collect()
    assert {(r["topic"], r["pmid"]) for r in got} == _filled_in_order(hits, quotas)
    assert len(got) == len({r["pmid"] for r in got})


def test_quota_before_dedup_follows_a_chain_of_displaced_hits(spark):
    # every topic's first hit is the second one of the topic before it
    n = 6
    hits = [(f"t{i}", 0, r, str(i + r)) for i in range(n) for r in range(3)]
    valid = spark.createDataFrame(hits, "topic string, query_no int, rank int, pmid string")
    quotas = [(f"t{i}", 2) for i in range(n)]
    got = {(r["topic"], r["pmid"])
           for r in ingest.quota_before_dedup(valid, _topics(spark, quotas)).collect()}
    assert got == _filled_in_order(hits, quotas)
    assert ingest.quota_before_dedup(valid.limit(0), _topics(spark, quotas)).count() == 0
