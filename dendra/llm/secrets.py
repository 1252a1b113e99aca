"""Secret scans through a trigram index.

Each rule's regular expression yields a Boolean query over trigrams that every
match must contain.  A block of documents (one Arrow batch) is indexed:
trigram -> posting set of its rows; a rule's postings are intersected and
united as its query says, and only the documents left are scanned with the
rule itself.  Rules without a mandatory trigram scan every document of the
block.  Blocks are bounded, independent of each other and need no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from re import _parser as sre

import pyarrow as pa
from pyspark.sql import DataFrame

from dendra.llm.common import small_batches, texts

# Rules in the order kinds are listed: (kind, pattern, group measured, least
# length of that group).  The first three are the base kinds; a match that is
# too short is dropped after it has been consumed.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    ("assign",
     r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
     r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
     r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
)
# Character classes with more (case-folded) members end a literal run.
MAX_CLASS = 5

# A query is None (every document), a trigram, or ("and" | "or", [queries]).


def _class_chars(items) -> set[str] | None:
    chars: set[str] = set()
    for op, av in items:
        if op is sre.LITERAL:
            chars.add(chr(av).lower())
        elif op is sre.RANGE and av[1] - av[0] < 2 * MAX_CLASS:
            chars |= {chr(c).lower() for c in range(av[0], av[1] + 1)}
        else:
            return None
    return chars if len(chars) <= MAX_CLASS else None


def _join(op: str, parts: list):
    if op == "or" and any(p is None for p in parts):
        return None
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else (op, parts)


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of ``pattern`` satisfies
    (over case-folded text), or None if no trigram is mandatory."""
    def walk(seq) -> object:
        found, run = [], []

        def close():
            for i in range(len(run) - 2):
                found.append(_join("or", ["".join(t) for t in product(*map(sorted, run[i:i + 3]))]))
            run.clear()

        for op, av in seq:
            if op is sre.LITERAL:
                run.append({chr(av).lower()})
                continue
            if op is sre.IN and (chars := _class_chars(av)):
                run.append(chars)
                continue
            close()
            if op is sre.SUBPATTERN:
                found.append(walk(av[-1]))
            elif op is sre.BRANCH:
                found.append(_join("or", [walk(branch) for branch in av[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and av[0] >= 1:
                found.append(walk(av[2]))
        close()
        return _join("and", found)

    return walk(sre.parse(pattern))


def _trigrams(query) -> set[str]:
    if query is None:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*map(_trigrams, query[1]))


def _rows(query, index: dict[str, set[int]], every: set[int]) -> set[int]:
    if query is None:
        return every
    if isinstance(query, str):
        return index[query]
    sets = [_rows(q, index, every) for q in query[1]]
    return set.intersection(*sets) if query[0] == "and" else set.union(*sets)


class Scanner:
    """The compiled rules; ``block`` scans a list of texts."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(p), group, least, trigram_query(p))
                      for kind, p, group, least in rules]
        self.wanted = sorted(set().union(*(_trigrams(r[4]) for r in self.rules)))

    def block(self, block: list[str]) -> list[list[tuple[int, int, int, str]]]:
        """Per text its spans (start, rule number, end, kind) in order of start,
        then of rule."""
        folded = [t.lower() for t in block]
        index = {g: {i for i, t in enumerate(folded) if g in t} for g in self.wanted}
        every, spans = set(range(len(block))), [[] for _ in block]
        for k, (kind, rx, group, least, query) in enumerate(self.rules):
            for i in _rows(query, index, every):
                spans[i] += [(m.start(), k, m.end(), kind) for m in rx.finditer(block[i])
                             if m.end(group) - m.start(group) >= least]
        for s in spans:
            s.sort()
        return spans


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def secret_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256`` (digest of the base spans) and ``spans`` (all spans as
    kind:start:end in code points, end exclusive, by start, then by kind as
    listed, comma-joined).

    Null and empty texts have no spans; repeated rows stay apart; an empty
    table gives an empty result.  Texts are scanned whole."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            found = scanner.block(b.column("text").to_pylist())
            base = [[s for s in f if s[3] in BASE_KINDS] for f in found]
            counts = [pa.array([sum(s[3] == kind for s in f) for f in base], pa.int64())
                      for kind in BASE_KINDS]
            digest = [hashlib.sha256(_joined(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(digest, pa.string()),
                 pa.array([_joined(f) for f in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts(docs).mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, "
              "base_sha256 string, spans string")


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """All documents, in their own columns, with every secret span replaced by
    ``[kind]`` (overlapping spans become one mark of the first kind) and
    ``n_chars``, where present, counted anew.  Null texts stay null."""
    small_batches(docs.sparkSession)

    def mask(text: str, spans) -> str:
        out, at = [], 0
        for start, _, end, kind in spans:
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            raw = b.column("text").to_pylist()
            found = scanner.block([t or "" for t in raw])
            new = [mask(t, s) if t and s else t for t, s in zip(raw, found)]
            cols = []
            for f in b.schema:
                if f.name == "text":
                    cols.append(pa.array(new, f.type))
                elif f.name == "n_chars":
                    old = b.column("n_chars").to_pylist()
                    cols.append(pa.array([len(t) if s else n
                                          for n, t, s in zip(old, new, found)], f.type))
                else:
                    cols.append(b.column(f.name))
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(scan, docs.schema)
