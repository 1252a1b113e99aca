"""Small independent NumPy HDBSCAN* for tests (top-down, as the published
algorithm: MST -> single linkage -> condensed tree -> stability -> EOM/leaf
-> labels -> membership strength).  Ties in edge weight are broken by
(least id, greatest id), like the Spark implementation."""

from __future__ import annotations

import numpy as np


def pairwise(X: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        Xn = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-300)
        return np.maximum(1.0 - Xn @ Xn.T, 0.0)
    d = X[:, None, :] - X[None, :, :]
    return np.sqrt((d * d).sum(-1))


def core_dist(D: np.ndarray, k: int) -> np.ndarray:
    # k-th nearest *other* point
    s = np.sort(D, axis=1)
    return s[:, k]


def mst(D: np.ndarray, core: np.ndarray, ids: np.ndarray):
    n = len(D)
    M = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    edges = []
    for i in range(n):
        for j in range(i + 1, n):
            lo, hi = min(ids[i], ids[j]), max(ids[i], ids[j])
            edges.append((M[i, j], lo, hi, i, j))
    edges.sort()
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    out = []
    for w, lo, hi, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append((i, j, w))
    return out


def single_linkage(n, mst_edges):
    """scipy-style linkage rows (left, right, dist, size) in edge order."""
    parent = list(range(2 * n))
    size = [1] * (2 * n)
    nxt = n
    rows = []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j, w in mst_edges:
        a, b = find(i), find(j)
        rows.append((a, b, w, size[a] + size[b]))
        parent[a] = parent[b] = nxt
        size[nxt] = size[a] + size[b]
        nxt += 1
    return rows


def condense(n, L, m):
    root = 2 * (n - 1)
    lam = lambda d: np.inf if d <= 0 else 1.0 / d

    def children(node):
        return L[node - n][0], L[node - n][1]

    def size(node):
        return 1 if node < n else L[node - n][3]

    def leaves(node):
        st, out = [node], []
        while st:
            x = st.pop()
            if x < n:
                out.append(x)
            else:
                st.extend(children(x))
        return out
    relabel = {root: n}
    nxt = n + 1
    rows = []
    queue = [root]
    while queue:
        node = queue.pop(0)
        if node < n:
            continue
        left, right = children(node)
        lv = lam(L[node - n][2])
        ls, rs = size(left), size(right)
        if ls >= m and rs >= m:
            relabel[left] = nxt
            rows.append((relabel[node], nxt, lv, ls))
            nxt += 1
            relabel[right] = nxt
            rows.append((relabel[node], nxt, lv, rs))
            nxt += 1
            queue += [left, right]
        elif ls < m and rs < m:
            for p in leaves(left) + leaves(right):
                rows.append((relabel[node], p, lv, 1))
        elif ls < m:
            relabel[right] = relabel[node]
            for p in leaves(left):
                rows.append((relabel[node], p, lv, 1))
            queue.append(right)
        else:
            relabel[left] = relabel[node]
            for p in leaves(right):
                rows.append((relabel[node], p, lv, 1))
            queue.append(left)
    return rows


def run(X, min_cluster_size=3, min_samples=None, method="eom", metric="euclidean", ids=None):
    n = len(X)
    ids = np.arange(n) if ids is None else np.asarray(ids)
    ms = min_cluster_size if min_samples is None else min_samples
    ms = min(ms, n - 1)
    D = pairwise(np.asarray(X, dtype=float), metric)
    core = core_dist(D, ms)
    E = mst(D, core, ids)
    L = single_linkage(n, E)
    tree = condense(n, L, min_cluster_size)
    root = n
    birth = {root: 0.0}
    for p, c, lv, s in tree:
        if c >= n:
            birth[c] = lv
    stab = {}
    for p, c, lv, s in tree:
        stab[p] = stab.get(p, 0.0) + (lv - birth[p]) * s
    ctree = [(p, c) for p, c, lv, s in tree if c >= n]
    kids = {}
    for p, c in ctree:
        kids.setdefault(p, []).append(c)
    nodes = sorted([c for c in stab if c != root], reverse=True)
    sel = {c: True for c in nodes}
    if method == "eom":
        st = dict(stab)
        for node in nodes:
            sub = sum(st[c] for c in kids.get(node, []))
            if sub > st[node]:
                sel[node] = False
                st[node] = sub
            else:
                stack = list(kids.get(node, []))
                while stack:
                    x = stack.pop()
                    sel[x] = False
                    stack += kids.get(x, [])
    else:
        for c in nodes:
            sel[c] = c not in kids
    chosen = {c for c, v in sel.items() if v}
    up = {c: p for p, c in ctree}
    labels = np.full(n, -1)
    lam_pt = np.zeros(n)
    pt_parent = {}
    for p, c, lv, s in tree:
        if c < n:
            pt_parent[c] = p
            lam_pt[c] = lv
    lmax = {}
    for p, c, lv, s in tree:
        lmax[p] = max(lmax.get(p, 0.0), lv)
    order = {c: i for i, c in enumerate(sorted(chosen))}
    probs = np.zeros(n)
    for i in range(n):
        c = pt_parent[i]
        while c is not None and c not in chosen:
            c = up.get(c)
        if c is not None:
            labels[i] = order[c]
            mx = lmax[c]
            if mx == 0 or not np.isfinite(lam_pt[i]):
                probs[i] = 1.0
            else:
                probs[i] = min(lam_pt[i], mx) / mx
    return labels, probs, sum(w for _, _, w in E)
