"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendra.llm import ann, common, decontam, jaccard, langid, licenses, mixing, periodic, prefix_trie, secrets, substrings, tokens, toxicity, urls


def op1_mix(spark, sf_dir):
    """Mix all documents to the targets of their sources."""
    return mixing.mix_sources(common.read(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    """Every (document, benchmark item) contamination pair."""
    return decontam.contaminated_pairs(common.read(spark, sf_dir, "documents"),
                                       common.read(spark, sf_dir, "benchmark"))


def op3_jaccard(spark, sf_dir):
    """Near-duplicate component of every document."""
    return jaccard.jaccard_components(common.read(spark, sf_dir, "documents"))


def op4_licenses(spark, sf_dir):
    """License notices found in every document."""
    return licenses.find_licenses(common.read(spark, sf_dir, "documents"), licenses.templates(spark))


def op5_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.toxicity(common.read(spark, sf_dir, "documents"),
                             common.read(spark, sf_dir, "labels"))


def op6_secrets(spark, sf_dir):
    """Secret spans of every document."""
    return secrets.secret_spans(common.read(spark, sf_dir, "documents"))


def op7_repeated_substrings(spark, sf_dir):
    """Bytes of every document left after removing repeated 400-byte strings."""
    return substrings.remove_repeats(common.read(spark, sf_dir, "documents")).drop("spans")


def op8_token_counts(spark, sf_dir, tokenizer_path=None):
    """Token counts of every document with a public byte-level vocabulary."""
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(common.read(spark, sf_dir, "documents"), tokenizer_path)


def op9_nearest(spark, sf_dir):
    """The 10 nearest neighbours of every hundredth vector among all."""
    return ann.nearest(common.read(spark, sf_dir, "embeddings"))


def op10_language(spark, sf_dir):
    """The language of every document, learned from the training rows."""
    return langid.identify(common.read(spark, sf_dir, "documents"))


def op11_urls(spark, sf_dir):
    """The verdict of every page's url."""
    return urls.judge_urls(common.read(spark, sf_dir, "pages"), urls.rules_table(spark)).select(
        "page_id", "host", "path", "rule", "verdict", F.concat_ws(" ", "strict_terms").alias("strict_terms"),
        F.concat_ws(" ", "soft_terms").alias("soft_terms"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


def op12_trie(spark, sf_dir):
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(common.read(spark, sf_dir, "conversations"))


def op13_runs(spark, sf_dir):
    """The periodic runs of every document."""
    return periodic.periodic_runs(common.read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_decontaminate, op3_jaccard, op4_licenses, op5_toxicity, op6_secrets, op7_repeated_substrings, op8_token_counts, op9_nearest, op10_language,
    op11_urls, op12_trie, op13_runs)}
