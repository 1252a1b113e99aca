"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination,
secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before it
kept and returns the columns of ``documents`` (the last one the mix).  Stages
are written as Parquet in the shared folder and read again in between.  No
stage is expressed in SQL (the first one is a fitted model), so ``ORACLE_SQL``
is None and the tests compare the stages with plain Python."""

from __future__ import annotations

import uuid

from dendra.llm import common, decontam, jaccard, mixing, secrets, toxicity
from dendra.session import ensure_checkpoint_dir


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity grammar rejects go."""
    return toxicity.drop_toxic(docs, common.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document (the smallest id) of each near-duplicate group stays."""
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item, or a stretch of one, go."""
    return decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Every document stays; secrets in its text become marks."""
    return secrets.redact(docs)


def mix(spark, docs, sf_dir):
    """The mix of the sources that are left: words taken of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over the whole ``documents`` table."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
