"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

Neighbouring chunks overlap; both encodings of the overlap are compared by
offset, and the chunks are spliced behind a word (pre-token) that has the same
place and ids in both and is followed by a word that starts at the same place.
A pre-token boundary depends only on what stands before it being parsed alike
and, from there on, the encoding depends only on the text that follows; the
left chunk's boundaries are final except near its end.  So the spliced count
equals that of the whole text.  Without such a word the overlap is widened,
and finally the chunk itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from dendra.llm.common import small_batches, texts

# Characters per chunk and of the first overlap tried.
CHUNK, OVERLAP = 1 << 16, 1 << 10
# A special token cut by the end of a chunk is at most this long; boundaries
# closer to the end aren't final.
END_MARGIN = 64
# Characters handed to the tokenizer at once.
BATCH_CHARS = 1 << 19


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _words(enc, shift: int) -> list[tuple[int, int, tuple[int, ...], int]]:
    """(start, end, ids, number of the first token) of each pre-token."""
    out, last = [], object()
    for k, (i, w, (a, b)) in enumerate(zip(enc.ids, enc.word_ids, enc.offsets)):
        if w is not None and w == last:
            s, _, ids, first = out[-1]
            out[-1] = (s, b + shift, ids + (i,), first)
        else:
            out.append((a + shift, b + shift, (i,), k))
        last = w
    return out


def _splice(left, right, end: int) -> tuple[int, int] | None:
    """Token numbers (left, right) behind the first common word, or None."""
    nxt = {r[0]: (r, right[k + 1]) for k, r in enumerate(right[:-1])}
    for a, b in zip(left, left[1:]):
        if b[0] > end - END_MARGIN or a[1] > end - END_MARGIN:
            return None
        if a[0] in nxt:
            r, after = nxt[a[0]]
            if r[1:3] == a[1:3] and after[0] == b[0]:
                return b[3], after[3]
    return None


def chunked_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of ``text``, never encoding more than needed at once."""
    def encode(a: int, b: int):
        return tok.encode(text[a:b], add_special_tokens=False)

    a, size = 0, chunk
    enc, skip, total = encode(0, size), 0, 0     # skip: tokens counted by the chunk before
    while a + size < len(text):
        end, wide, spliced = a + size, overlap, None
        left = _words(enc, a)
        while spliced is None and wide < size:
            b = end - wide
            nxt = encode(b, b + chunk)
            spliced = _splice(left[next((k for k, w in enumerate(left) if w[0] >= b),
                                        len(left)):], _words(nxt, b), min(end, b + chunk))
            if spliced and spliced[0] <= skip:
                spliced = None
            if spliced is None:
                wide *= 2
        if spliced is None:
            size *= 2                             # no common word: a larger chunk
            enc = encode(a, a + size)
            continue
        total += spliced[0] - skip
        a, size, enc, skip = b, chunk, nxt, spliced[1]
    return total + len(enc.ids) - skip


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``
    (no begin, end or added special tokens; special strings inside texts as
    the library's default has them) and ``over_limit`` (``n_tokens > limit``).

    Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows stay apart; an
    empty table gives an empty result.  ``tokenizer_path`` must exist on every
    worker; the file is read once per task.  Narrow: no shuffle."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_path)
        for b in batches:
            ts = b.column("text").to_pylist()
            n = [0] * len(ts)
            group, chars = [], 0

            def flush():
                for i, e in zip(group, tok.encode_batch_fast([ts[i] for i in group],
                                                             add_special_tokens=False)):
                    n[i] = len(e)
            for i, t in enumerate(ts):
                if len(t) > chunk:
                    n[i] = chunked_count(tok, t, chunk, overlap)
                    continue
                group.append(i)
                chars += len(t)
                if chars >= BATCH_CHARS:
                    flush()
                    group, chars = [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in ts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
