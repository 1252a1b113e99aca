"""URL filter: host and path rules first, then a weighted vocabulary.

Every distinct url is judged once.  A rule (host, path prefix, verdict) fits
its host and all subdomains when the url's path starts with the rule's path;
the longest rule wins.  A url without a rule is scanned by an Aho-Corasick
automaton for strict and soft terms.  A term counts only as a whole word (no
letter or digit beside it) and once per url; strict terms weigh ``LIMIT``, soft
ones 1, and a url that reaches ``LIMIT`` is blocked: one strict term, or
``LIMIT`` different soft ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, path prefix, verdict): fixed values of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block"))
# One of these blocks a url.
STRICT = ("porn", "xxx", "hentai", "sex", "nude", "escort", "casino", "casinos", "viagra",
          "cialis", "warez", "spam", "phishing", "malware", "adult")
# Of these, LIMIT different ones block a url.
SOFT = ("ads", "bet", "bets", "betting", "bonus", "cheap", "click", "coupon", "crack", "deal",
        "deals", "dating", "discount", "earn", "farm", "free", "gambling", "jackpot", "keygen",
        "loan", "loans", "money", "offer", "offers", "pharmacy", "pill", "pills", "poker",
        "prize", "promo", "replica", "slots", "torrent", "win", "winner")
LIMIT = 2


def host_and_path(url):
    """Two columns: the host (A-Z lower-cased) and the path; both empty for a
    null url and for one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return (F.coalesce(F.translate(rest, UPPER, LOWER), F.lit("")),
            F.coalesce(path, F.lit("")))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a table ``host, path, verdict``."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (distinct rows ``url, host, path``) with ``rule`` (host + path
    of the longest rule that fits, else null) and ``rule_verdict``.

    Two equality joins: the url's host suffixes (no longer than the rules'
    hosts) meet the lengths that rule paths of that host have, and the path
    cut to each length meets the rule itself.  Spark picks the join: a small
    rule table is broadcast by its size, a large one is shuffled, where a host
    that most urls share is a skewed key of the url side only."""
    r = (rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("_host"),
                      F.coalesce("path", F.lit("")).alias("_path"), "verdict")
         .filter((F.col("_host") != "") & F.col("verdict").isNotNull())
         .groupBy("_host", "_path").agg(F.min("verdict").alias("_verdict")))
    lengths = r.groupBy("_host").agg(F.collect_set(F.length("_path")).alias("_lengths"))
    deepest = F.coalesce(r.select(F.max(F.size(F.split("_host", r"\."))).alias("n")).scalar(), F.lit(1))
    labels = F.split("host", r"\.")
    cut = (urls.withColumn("_labels", F.slice(
        labels, F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.size(labels)))
           .withColumn("_host", F.explode(F.expr(
               "transform(sequence(1, size(_labels)), "
               "i -> array_join(slice(_labels, i, size(_labels)), '.'))"))))
    found = (cut.select("url", "path", "_host").join(lengths, "_host")
             .withColumn("_len", F.explode("_lengths"))
             .filter(F.col("_len") <= F.length("path"))
             .withColumn("_path", F.expr("substring(path, 1, _len)"))
             .join(r, ["_host", "_path"])
             .groupBy("url").agg(F.max(F.struct(
                 (F.length("_host") + F.length("_path")).alias("n"),
                 F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best")))
    return (urls.join(found, "url", "left")
            .select("url", "host", "path", F.col("_best.rule").alias("rule"),
                    F.col("_best.verdict").alias("rule_verdict")))


@functools.lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, t)
    found.make_automaton()
    return found


def whole_terms(text: str, terms: tuple[str, ...]) -> list[str]:
    """The different terms that stand in ``text`` as whole words, sorted."""
    if not terms:
        return []
    hits = set()
    for end, t in automaton(terms).iter(text):
        start = end - len(t) + 1
        if (start == 0 or not text[start - 1].isalnum()) and (
                end + 1 == len(text) or not text[end + 1].isalnum()):
            hits.add(t)
    return sorted(hits)


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """A pandas function url -> (strict terms, soft terms)."""
    strict, soft = tuple(sorted(set(strict))), tuple(sorted(set(soft) - set(strict)))

    @F.pandas_udf("strict_terms array<string>, soft_terms array<string>")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        wanted = frozenset(strict)
        for batch in urls:
            found = [whole_terms(u, strict + soft) for u in batch]
            yield pd.DataFrame({"strict_terms": [[t for t in f if t in wanted] for f in found],
                                "soft_terms": [[t for t in f if t not in wanted] for f in found]})
    return hits


def judge_urls(pages: DataFrame, rules: DataFrame, strict: Sequence[str] = STRICT,
               soft: Sequence[str] = SOFT, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``; other columns are
    ignored): ``page_id, url, host, path, rule, verdict, strict_terms,
    soft_terms, weight``.

    Null urls, and urls without ``://``, have an empty host and path and no
    rule; a null or empty url is allowed, any other text is scanned like a url.
    Terms are sought in the whole url, A-Z lower-cased, not percent-decoded.
    The three last columns are null where a rule decided.  Repeated rows stay
    repeated and null page ids stay null.  An empty table gives an empty
    result.  Of rules with the same host and path the smaller verdict counts.

    Scale: urls are shuffled without their pages; each distinct url is judged
    once, so a url that many rows share costs one judgement.  Rows without a
    url never enter the join."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"))
    urls = pages.filter(F.col("url").isNotNull()).select("url").distinct()
    host, path = host_and_path(F.col("url"))
    ruled = longest_rule(urls.select("url", host.alias("host"), path.alias("path")), rules)
    text = F.when(F.col("rule").isNull(), F.translate("url", UPPER, LOWER)).otherwise(F.lit(""))
    judged = (ruled.withColumn("_hits", vocabulary_hits(strict, soft)(text))
              .withColumn("_weight", F.size("_hits.strict_terms") * limit + F.size("_hits.soft_terms"))
              .select("url", "host", "path", "rule",
                      F.coalesce("rule_verdict", F.when(F.col("_weight") >= limit, "block")
                                 .otherwise("allow")).alias("verdict"),
                      *[F.when(F.col("rule").isNull(), c).alias(n) for c, n in (
                          (F.col("_hits.strict_terms"), "strict_terms"),
                          (F.col("_hits.soft_terms"), "soft_terms"), (F.col("_weight"), "weight"))]))
    missing = (pages.filter(F.col("url").isNull())
               .select("page_id", "url", F.lit("").alias("host"), F.lit("").alias("path"),
                       F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"),
                       F.array().cast("array<string>").alias("strict_terms"),
                       F.array().cast("array<string>").alias("soft_terms"),
                       F.lit(0).alias("weight")))
    return (pages.filter(F.col("url").isNotNull()).join(judged, "url")
            .select(*missing.columns).unionByName(missing))
