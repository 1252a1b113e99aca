"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the list of its most frequent n-grams (1 to 3 letters,
word ends included), most frequent first, counted over all training rows.  A
document's own list is compared with each profile: every n-gram adds the
difference of its two ranks, or the profile's length if the profile lacks it.
The language with the smallest sum (out-of-place distance) is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import is_held_out, is_training, small_batches, texts

# N-grams in a language's profile and in a document's.
PROFILE = 400
# Counts of a task are merged when this many have piled up.
MERGE_AT = 1 << 20

_LETTER = None


def _letters() -> np.ndarray:
    """Truth table over all code points: is it a letter?"""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER


def grams(text: str) -> np.ndarray:
    """All n-grams of the lower-cased text, packed 21 bits a letter; 0 stands
    for the gap between words.  A gap never stands inside or alone."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(c):
        return c
    c = np.where(_letters()[c], c, 0)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)          # runs of gaps become one
    c = np.concatenate([[0], c[keep], [0]]) if keep.any() else c[:0]
    a, b, d = c[:-2], c[1:-1], c[2:]
    mid = b != 0
    return np.concatenate([b[mid], ((a << 21) | b)[mid] | (1 << 63 >> 1),
                           ((b << 21) | d)[mid & (d == 0)] | (1 << 63 >> 1),
                           ((a << 42) | (b << 21) | d)[mid]])


def _ranked(g: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by value."""
    u, n = np.unique(g, return_counts=True)
    return u[np.lexsort((u, -n))[:top]]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) summed over all rows (``text``, ``lang``)."""
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list] = {}
        size: dict[str, int] = {}

        def merged(parts):
            g = np.concatenate([p[0] for p in parts])
            u, inv = np.unique(g, return_inverse=True)
            return u, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                part = np.unique(grams(t), return_counts=True)
                have.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[0])
                if size[lang] > MERGE_AT:
                    have[lang] = [merged(have[lang])]
                    size[lang] = 0
        for lang, parts in have.items():
            u, n = merged(parts)
            for i in range(0, len(u), 65536):
                m = len(u[i:i + 65536])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * m, pa.string()), pa.array(u[i:i + 65536]),
                     pa.array(n[i:i + 65536])], ["lang", "gram", "n"])

    return (rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def profiles(docs: DataFrame, top: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) of every language with a non-null ``lang`` in
    the training rows; ``top`` rows a language."""
    rows = texts(docs, "lang").filter(is_training(F.col("doc_id")) & F.col("lang").isNotNull())
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (gram_counts(rows).withColumn("rank", F.row_number().over(w) - 1)
            .filter(F.col("rank") < top).select("lang", "gram", "rank"))


def predict_language(docs: DataFrame, profile_rows: DataFrame, top: int = PROFILE) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred`` (``und``
    for null texts and texts without a letter, or when nothing was learned)
    and ``score`` (1 - distance / largest possible distance; 0 for ``und``).
    Ties go to the language that sorts first.  Repeated rows stay apart; an
    empty table gives an empty result.

    The profiles, ``top`` rows for each language, are the only data brought to
    the driver; whole texts are read, never prefixes."""
    small_batches(docs.sparkSession)
    learned = profile_rows.collect()          # top x number of languages
    langs = sorted({r["lang"] for r in learned})
    vocab = np.unique(np.array([r["gram"] for r in learned], np.int64))
    ranks = np.full((len(vocab) + 1, len(langs)), -1, np.int32)
    for r in learned:
        ranks[np.searchsorted(vocab, r["gram"]), langs.index(r["lang"])] = r["rank"]

    def distances(text: str) -> np.ndarray | None:
        g = grams(text)
        if not len(g):
            return None
        g = _ranked(g, top)
        at = np.searchsorted(vocab, g)
        at[at == len(vocab)] = 0
        at[vocab[at] != g] = len(vocab)              # the last row: in no profile
        r = ranks[at]
        return np.where(r < 0, top, np.abs(r - np.arange(len(g))[:, None])).sum(0) / (len(g) * top)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = [], []
            for t in b.column("text").to_pylist():
                d = distances(t) if langs else None
                k = -1 if d is None else int(d.argmin())
                pred.append("und" if k < 0 else langs[k])
                score.append(0.0 if k < 0 else float(1 - d[k]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()),
                 pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return (texts(docs).withColumn("held_out", is_held_out(F.col("doc_id")))
            .mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double"))


def identify(docs: DataFrame, top: int = PROFILE) -> DataFrame:
    """Learn the profiles from the training rows of ``docs`` and predict all."""
    return predict_language(docs, profiles(docs, top), top)
