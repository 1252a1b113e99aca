"""Operators for training-data pipelines: mixing, decontamination, similarity
joins, license / toxicity / secret scans, substring dedup, token counts,
vector search and language identification.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it."""
