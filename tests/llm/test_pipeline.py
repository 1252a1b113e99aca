"""The pipeline's stages against plain Python, on the small table."""

import re

import corpus_pipeline as P
from dendra.llm import common, secrets, toxicity
from tests.llm.test_operators import jaccard_brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    labels = common.read(spark, SF, "labels")
    stages = dict(P.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i in rows if not scores[i]}

    one = stages["ngram_jaccard"](spark, kept, SF)
    want = {c if n else i for i, n, c in jaccard_brute([tuple(rows[i]) for i in sorted(ids)])}
    ids = {r["doc_id"] for r in one.collect()}
    assert ids == want

    clean = stages["decontamination"](spark, one, SF)
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower()))
             for r in common.read(spark, SF, "benchmark").collect()]
    text = {i: " ".join(re.findall(r"[^\W_]+", rows[i]["text"].lower())) for i in ids}
    whole = {i for i in ids if any(x in text[i] for x in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert whole and not whole & left and left <= ids

    safe = stages["secrets"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in safe} == left
    scanner = secrets.Scanner()
    assert not any(scanner.block([r["text"] for r in safe]))
    assert all(r["n_chars"] == len(r["text"]) for r in safe if r["text"] != rows[r["doc_id"]]["text"])

    mix = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in mix} == left
    assert abs(sum(r["taken"] for r in mix) / (1.5 * sum(r["size"] for r in mix)) - 1) < 0.05
