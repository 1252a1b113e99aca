"""Suffix arrays by induced sorting, and permuted common prefixes.

The bytes of a shard are sorted by induced sorting: suffixes are classified,
the leftmost-smaller (LMS) substrings are sorted and named, the string of names is
sorted recursively, and one induction orders all suffixes from the order of
the LMS suffixes.  On the byte alphabet the induction moves whole buckets at a
time; on the larger alphabets of names it splits groups of equal beginnings,
whose length doubles from round to round, so that constant and periodic texts
take a logarithmic number of rounds.
"""

from __future__ import annotations

import numpy as np

# Rounds of one symbol each before the doubled order takes over, and symbols
# compared in one step of the common prefixes: both only affect speed.
ROUNDS, STRETCH = 16, 1 << 18


def _classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S-type per position, LMS positions); the last symbol is the unique
    smallest."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]         # next place that differs
    s = np.ones(n, bool)
    s[:-1] = np.append(step, 1)[at] > 0
    return s, np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _deal(buckets: list[list], t: np.ndarray, j: np.ndarray) -> None:
    """Append the positions ``j``, in order, to the buckets of their symbols."""
    if not len(j):
        return
    c = t[j]
    o = np.argsort(c, kind="stable")
    c, j = c[o], j[o]
    cut = np.flatnonzero(c[1:] != c[:-1]) + 1
    for part, sym in zip(np.split(j, cut), c[np.concatenate([[0], cut])].tolist()):
        buckets[sym].append(part)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in the order induced by the LMS suffixes as given."""
    none = np.empty(0, np.int64)
    # first place of the run of equal symbols that a position lies in
    at = np.arange(len(t))
    run = np.maximum.accumulate(np.where(np.append(True, t[1:] != t[:-1]), at, 0))

    def deal(now, c, of_type, buckets):
        """Deal what ``now`` induces; what falls into its own bucket again."""
        j = now[now > 0] - 1
        j = j[s[j] == of_type]
        same = t[j] == c
        _deal(buckets, t, j[~same])
        return j[same]

    def wave(c, first, of_type, buckets):
        """The bucket's own suffixes, round by round, dealing what they induce.
        Suffixes in a longer run of the symbol come back once per symbol left
        of them; after a few rounds all these are written out at once."""
        out, now = [], np.concatenate(first) if first else none
        while len(now) and len(out) < ROUNDS:
            out.append(now)
            now = deal(now, c, of_type, buckets)
        if len(now):
            times = now - run[now] + 1
            back = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rest = (np.repeat(now, times) - back)[np.argsort(back, kind="stable")]
            deal(rest, c, of_type, buckets)
            out.append(rest)
        return out

    # L-type suffixes, from the smallest bucket up
    heads: list[list] = [[] for _ in range(k)]
    seeds: list[list] = [[] for _ in range(k)]
    _deal(seeds, t, lms)
    large: list[np.ndarray] = [none] * k
    for c in range(k):
        got = wave(c, heads[c], False, heads)
        large[c] = np.concatenate(got) if got else none
        if seeds[c]:
            j = np.concatenate(seeds[c])
            j = j[j > 0] - 1
            _deal(heads, t, j[~s[j]])
    # S-type suffixes, from the largest bucket down (each list runs downwards)
    tails: list[list] = [[] for _ in range(k)]
    order: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        got = wave(c, tails[c], True, tails)
        if c == 0:
            got = [np.array([len(t) - 1])]
        j = large[c][::-1]
        up = j[j > 0] - 1
        _deal(tails, t, up[s[up] & (t[up] <= c)])
        order += [np.concatenate(got) if got else none, j]
    return np.concatenate(order)[::-1]


def _split(order: np.ndarray, group: np.ndarray, act: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the undecided places ``act`` within their groups by ``key``, number
    the new groups by the place of their first member and return the places
    that still share a group."""
    both = group[act] * (int(key.max()) + 1) + key
    o = np.argsort(both, kind="stable")
    order[act], both = order[act][o], both[o]
    new = np.append(True, both[1:] != both[:-1])
    group[act] = act[np.maximum.accumulate(np.where(new, np.arange(len(act)), 0))]
    return act[~(new & np.append(new[1:], True))]


def _doubled(pos: np.ndarray, pair: np.ndarray, dist: np.ndarray,
             rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sort the positions ``pos`` by their keys up to ``dist`` further on, there
    by ``rank`` if it is given (else equal sequences stay one group).  Returns
    (order, group of each ordered item).  ``pos`` holds the positions up to the
    distance of each of its members.

    Groups agree on 1, 2, 4, ... keys: a round splits them by the group of the
    position that many keys on.  Members of a group that has reached its
    distance all have the same one, since the keys tell where types change."""
    order, group = pos.copy(), np.zeros(len(pos), np.int64)
    act = _split(order, group, np.arange(len(pos)), pair[order])
    cls = np.empty(len(pair), np.int64)
    size = 1
    while True:
        cls[order] = group
        if rank is None:
            act = act[dist[order[act]] >= size]
        if not len(act):
            return order, group
        i = order[act]
        d = dist[i]
        if rank is None:
            key = cls[i + size]
        else:
            key = np.where(d < size, rank[i + np.minimum(d, size)], cls[i + np.minimum(d, size)])
        act = _split(order, group, act, key)
        size *= 2


def _refine(lms: np.ndarray, pair: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the LMS substrings (keys up to the next LMS position): groups that
    agree so far are split by the next key, long ones after a few rounds by the
    doubled order of what is left of them.  Returns (order, group of each
    ordered item); groups are numbered by the place of their first member."""
    order, group = lms.copy(), np.zeros(len(lms), np.int64)
    act, off = np.arange(len(lms)), 0
    while len(act) and off < ROUNDS:
        act = _split(order, group, act, pair[order[act] + off])
        off += 1
        act = act[dist[order[act]] >= off]
    if len(act):
        left = dist[order[act]] - off + 1
        pos = (np.repeat(order[act] + off, left)
               + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left))
        end = np.zeros(len(pair), bool)
        end[lms] = True                            # the last key of a substring
        by, cls = _doubled(pos, 2 * pair + end, np.where(end, 0, dist))
        tail = np.empty(len(pair), np.int64)
        tail[by] = cls
        _split(order, group, act, tail[order[act] + off])
    return order, group


def _segments(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol and type as one key, distance to the next LMS position) per
    position; the last position has distance 0."""
    n = len(t)
    nxt = np.searchsorted(lms, np.arange(n), side="right")
    return 2 * t + s, np.append(lms, n - 1)[nxt] - np.arange(n)


def _induce_large(t: np.ndarray, s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same induction for large alphabets: every suffix is placed by its
    symbols up to the next LMS position and then by that suffix's rank."""
    pair, dist = _segments(t, s, lms)
    rank = np.zeros(len(t), np.int64)
    rank[order] = np.arange(len(order))
    return _doubled(np.arange(len(t)), pair, dist, rank)[0]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``t`` (small non-negative integers); the last
    symbol must be the only 0."""
    return np.asarray(_sort(t.astype(np.int64), int(t.max()) + 1, bytes_like=True))


def _sort(t: np.ndarray, k: int, bytes_like: bool) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s, lms = _classify(t)
    pair, dist = _segments(t, s, lms)
    a, group = _refine(lms, pair, dist)
    name = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    if name[-1] + 1 < len(lms):
        number = np.empty(n, np.int64)
        number[a] = name
        a = lms[_sort(number[lms], int(name[-1]) + 1, bytes_like=False)]
    return _induce(t, s, a, k) if bytes_like else _induce_large(t, s, lms, a)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): for each position the suffix before it in the order and
    the length of their common prefix.  Only irreducible values are compared;
    the others are one less than their left neighbour's."""
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    i = np.arange(n)
    reducible = np.zeros(n, bool)
    ok = (phi[1:] > 0)
    reducible[1:] = ok & (t[:-1] == t[np.where(ok, phi[1:] - 1, 0)])
    reducible[sa[0]] = False
    heads = i[~reducible]
    val = np.zeros(len(heads), np.int64)
    act = np.flatnonzero(phi[heads] >= 0)
    while len(act):
        # a stretch of symbols at a time, longer where fewer are compared; the
        # unique last symbol ends every comparison
        step = np.arange(min(n, max(1, STRETCH // len(act))))
        x = np.minimum((heads[act] + val[act])[:, None] + step, n - 1)
        y = np.minimum((phi[heads[act]] + val[act])[:, None] + step, n - 1)
        differ = t[x] != t[y]
        more = ~differ.any(axis=1)
        val[act] += np.where(more, len(step), differ.argmax(axis=1))
        act = act[more]
    group = np.cumsum(~reducible) - 1
    return val[group] - (i - heads[group]), phi


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Per piece the starts of its ``length``-byte strings that also start
    elsewhere in the pieces (or in the same one)."""
    parts, begin, at = [], [], 0
    for p in pieces:
        begin.append(at)
        parts += [np.frombuffer(p, np.uint8).astype(np.int64) + 2, np.array([1])]
        at += len(p) + 1
    t = np.concatenate([*parts, [0]])
    sa = suffix_array(t)
    plcp, phi = permuted_lcp(t, sa)
    hit = plcp >= length
    hit[phi[hit]] = True                       # both ends of a long common prefix
    return [np.flatnonzero(hit[b:b + max(0, len(p) - length + 1)])
            for b, p in zip(begin, pieces)]
