"""Vector column expressions (JVM higher-order functions) and the NumPy
kernels the block operators run inside Arrow-batched pandas tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2_normalize(v) -> Column:
    """v / ||v||; a zero vector stays zero (no division by zero under ANSI)."""
    n = F.sqrt(sq_norm(v))
    return F.when(n > 0, F.transform(_c(v), lambda x: x / n)).otherwise(_c(v))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


# --------------------------------------------------------------------------
# NumPy kernels (run inside tasks on bounded blocks)
# --------------------------------------------------------------------------

def stack(series) -> np.ndarray:
    """pandas Series of equal-length arrays -> 2-D float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(x, dtype=np.float64) for x in series])


def dense_scores(L: np.ndarray, R: np.ndarray, metric: str) -> np.ndarray:
    """Similarity (dot/cosine on pre-normalised rows) or exact Euclidean
    distance, computed in row chunks so memory stays bounded."""
    if metric in ("dot", "cosine"):
        return L @ R.T
    if metric == "euclidean":
        out = np.empty((L.shape[0], R.shape[0]))
        step = max(1, 4_000_000 // max(1, R.shape[0] * max(1, R.shape[1])))
        for s in range(0, L.shape[0], step):
            d = L[s:s + step, None, :] - R[None, :, :]
            out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        return out
    raise ValueError(f"unknown metric {metric}")


def sparse_scores(l_terms, l_vals, r_terms, r_vals, dense_cap: int = 4096) -> np.ndarray:
    """Exact sparse dot products between two bounded blocks of documents.

    Terms frequent in the right block go through a dense matmul (at most
    ``dense_cap`` columns); the long tail is expanded term by term and summed
    with ``bincount``. Memory is bounded by the block sizes, never by the
    number of document pairs sharing a stop word."""
    nL, nR = len(l_terms), len(r_terms)
    S = np.zeros((nL, nR))
    if nL == 0 or nR == 0:
        return S
    l_len = np.fromiter((len(t) for t in l_terms), dtype=np.int64, count=nL)
    r_len = np.fromiter((len(t) for t in r_terms), dtype=np.int64, count=nR)
    if l_len.sum() == 0 or r_len.sum() == 0:
        return S
    l_doc = np.repeat(np.arange(nL), l_len)
    l_t = np.concatenate([np.asarray(t, dtype=np.int64) for t in l_terms])
    l_v = np.concatenate([np.asarray(v, dtype=np.float64) for v in l_vals])
    r_doc = np.repeat(np.arange(nR), r_len)
    r_t = np.concatenate([np.asarray(t, dtype=np.int64) for t in r_terms])
    r_v = np.concatenate([np.asarray(v, dtype=np.float64) for v in r_vals])

    o = np.argsort(r_t, kind="stable")
    r_t, r_doc, r_v = r_t[o], r_doc[o], r_v[o]
    uniq, start, counts = np.unique(r_t, return_index=True, return_counts=True)
    r_pos = np.repeat(np.arange(len(uniq)), counts)

    # dense columns for the most frequent terms of the right block
    n_dense = min(dense_cap, int((counts > 8).sum()))
    dense_mask = np.zeros(len(uniq), dtype=bool)
    if n_dense > 0:
        top = np.argpartition(-counts, n_dense - 1)[:n_dense]
        dense_mask[top] = True
        colmap = np.full(len(uniq), -1, dtype=np.int64)
        colmap[dense_mask] = np.arange(n_dense)
        Rd = np.zeros((nR, n_dense))
        rm = dense_mask[r_pos]
        np.add.at(Rd, (r_doc[rm], colmap[r_pos[rm]]), r_v[rm])

    pos = np.searchsorted(uniq, l_t)
    posc = np.minimum(pos, len(uniq) - 1)
    hit = (pos < len(uniq)) & (uniq[posc] == l_t)
    if n_dense > 0:
        lm = hit & dense_mask[posc]
        Ld = np.zeros((nL, n_dense))
        np.add.at(Ld, (l_doc[lm], colmap[posc[lm]]), l_v[lm])
        S += Ld @ Rd.T
        hit = hit & ~dense_mask[posc]
    if hit.any():
        e_doc, e_pos, e_v = l_doc[hit], posc[hit], l_v[hit]
        cnt = counts[e_pos]
        # expand in chunks so the pair list stays bounded
        chunk_budget = 8_000_000
        cum = np.cumsum(cnt)
        s = 0
        while s < len(e_doc):
            base = cum[s - 1] if s > 0 else 0
            e = int(np.searchsorted(cum, base + chunk_budget, side="right"))
            e = max(e, s + 1)
            c = cnt[s:e]
            rep = np.repeat(np.arange(s, e), c)
            first = np.cumsum(c) - c
            offs = np.arange(int(c.sum())) - np.repeat(first, c)
            ridx = start[e_pos[rep]] + offs
            flat = e_doc[rep] * nR + r_doc[ridx]
            S += np.bincount(flat, weights=e_v[rep] * r_v[ridx], minlength=nL * nR).reshape(nL, nR)
            s = e
    return S


# Sparse blocks compared by tiles: a term that more than 1 / HEAD_SHARE of a block's
# rows hold goes through a matrix product, of at most HEAD_CELLS values; tiles and
# the stretches in which the other terms are added have so many cells.
HEAD_SHARE, HEAD_CELLS, SPARSE_CELLS, TAIL_CELLS = 16, 8 << 20, 1 << 19, 1 << 17


class SparseBlock:
    """Sparse vectors as postings.  ``tiles`` multiplies others with them.

    Vectors are flat: (where each one starts, and the end of the last; terms; weights)."""

    def __init__(self, start: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.n = len(start) - 1
        o = np.argsort(terms, kind="stable")
        terms = terms[o]
        self.at = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        self.terms = terms[self.at]
        self.count = np.diff(np.r_[self.at, len(terms)])
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(start))[o]
        self.weight = weights[o]
        head = np.flatnonzero(self.count * HEAD_SHARE > self.n)
        head = head[np.argsort(-self.count[head], kind="stable")[:HEAD_CELLS // max(1, self.n)]]
        self.column = np.full(len(self.terms), -1)
        self.column[head] = np.arange(len(head))
        self.head = np.zeros((len(head), self.n))
        for c, t in enumerate(head):
            part = slice(self.at[t], self.at[t] + self.count[t])
            np.add.at(self.head[c], self.doc[part], self.weight[part])

    def _add_tail(self, S: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Add the products of the entries (row, term, weight), stretch by stretch."""
        flat = S.reshape(-1)
        upto = np.cumsum(self.count[term])
        s = 0
        while s < len(term):
            base = upto[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(upto, base + SPARSE_CELLS, side="right")))
            t, n = term[s:e], self.count[term[s:e]]
            at = np.arange(upto[e - 1] - base) + np.repeat(self.at[t] - (upto[s:e] - n - base), n)
            np.add.at(flat, self.doc[at] + np.repeat(row[s:e] * self.n, n),
                      self.weight[at] * np.repeat(weight[s:e], n))
            s = e

    def tiles(self, start: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        """(first row, dot products of these rows with all vectors of the block);
        memory is bounded by the blocks and the tile."""
        n_rows = len(start) - 1
        step = max(1, SPARSE_CELLS // max(1, self.n))
        part = max(1, TAIL_CELLS // max(1, self.n))
        for s in range(0, n_rows, step):
            e = min(s + step, n_rows)
            ends = start[s:e + 1]
            t = terms[ends[0]:ends[-1]]
            pos = np.minimum(np.searchsorted(self.terms, t), max(0, len(self.terms) - 1))
            hit = np.flatnonzero(self.terms[pos] == t) if len(self.terms) else np.zeros(0, np.int64)
            pos, row = pos[hit], np.repeat(np.arange(e - s), np.diff(ends))[hit]
            w = weights[ends[0]:ends[-1]][hit]
            col = self.column[pos]
            in_head = col >= 0
            left = np.zeros((e - s, len(self.head)))
            np.add.at(left, (row[in_head], col[in_head]), w[in_head])
            S = left @ self.head
            pos, row, w = pos[~in_head], row[~in_head], w[~in_head]
            cuts = np.searchsorted(row, np.arange(0, e - s + part, part))
            for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                self._add_tail(S[c * part:(c + 1) * part], row[a:b] - c * part, pos[a:b], w[a:b])
            yield s, S


def nearest_sparse(left: tuple, right: tuple, k: int, l_out: np.ndarray | None = None,
                   r_out: np.ndarray | None = None, round_digits: int | None = None):
    """Per row of ``left`` its k largest dot products with the rows of ``right``, by
    (score, position in ``right``): arrays (row, column, score).  Pairs with
    ``l_out[row] == r_out[column]`` and scores that are not finite are left out."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    n = len(right[0]) - 1
    if min(len(left[0]) - 1, n, k) < 1:
        return none
    finite = np.isfinite(left[2]).all() and np.isfinite(right[2]).all()
    if r_out is not None:
        by = np.argsort(r_out, kind="stable")
        from_, to = (np.searchsorted(r_out[by], l_out, side=side) for side in ("left", "right"))
    slack = 10.0 ** -round_digits if round_digits is not None else 0.0
    some = min(n, max(4 * k, n // 8))       # columns that give the first bound
    out = [none]
    for s, S in SparseBlock(*right).tiles(*left):
        if not finite:
            S[~np.isfinite(S)] = -np.inf
        if r_out is not None:
            a, b = from_[s:s + len(S)], to[s:s + len(S)]
            for r in np.flatnonzero(b > a):
                S[r, by[a[r]:b[r]]] = -np.inf
        least = np.full(len(S), -np.finfo(float).max)
        if some >= k:
            least = np.maximum(np.partition(S[:, :some], some - k, axis=1)[:, some - k] - slack, least)
        hit = S >= least[:, None]
        # of the many pairs without a common term only the first can be returned
        for r in np.flatnonzero(least <= 0):
            zero = np.flatnonzero(S[r] == 0)
            hit[r, zero[k:]] = False
        row, col = np.nonzero(hit)
        score = S[row, col]
        if round_digits is not None:
            score = np.round(score, round_digits)
        row, col, score, _ = _first_k(row, -score, col, k, col, score)
        out.append((row + s, col, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k_rows(S: np.ndarray, r_ids: np.ndarray, k: int, larger_is_better: bool,
               mask: np.ndarray | None = None):
    """Per row of S, the k best columns ordered by (score, id) with ties to
    the smaller id.  Masked entries are never returned.  Yields
    (row_index, col_index, score, rank) arrays.

    Only entries up to a row's k-th best score are sorted."""
    nL, nR = S.shape
    if nL == 0 or nR == 0 or k < 1:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0), e
    key = -S if larger_is_better else S.copy()
    if mask is not None:
        key[mask] = np.inf
    key[~np.isfinite(key)] = np.inf
    last = np.partition(key, k - 1, axis=1)[:, k - 1:k] if nR > k else np.inf
    rows, cols = np.nonzero((key <= last) & (key < np.inf))
    rows, cols, rank = _first_k(rows, key[rows, cols], r_ids[cols], k, cols)
    return rows, cols, S[rows, cols], rank


def _first_k(rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int, *carry: np.ndarray):
    """The k entries of every row that come first by (key, id): their rows,
    the arrays ``carry`` and their ranks from 1."""
    o = np.lexsort((ids, keys, rows))
    rows = rows[o]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = rows[1:] != rows[:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows)))) + 1
    ok = rank <= k
    return (rows[ok], *(c[o][ok] for c in carry), rank[ok])


# Rows and columns of the tiles in which two blocks are compared, columns of
# the first tile (it gives the first bounds) and pairs scored at once.
TILE_ROWS, TILE_COLS, FIRST_COLS, SCORED_PAIRS = 512, 4096, 1024, 1 << 16


def pair_scores(L: np.ndarray, R: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Dot products or distances of the pairs (rows[i], cols[i]); a pair's
    score does not depend on the other pairs."""
    out = np.empty(len(rows))
    for s in range(0, len(rows), SCORED_PAIRS):
        a, b = L[rows[s:s + SCORED_PAIRS]], R[cols[s:s + SCORED_PAIRS]]
        if metric == "euclidean":
            d = a - b
            out[s:s + SCORED_PAIRS] = np.sqrt(np.einsum("ij,ij->i", d, d))
        else:
            out[s:s + SCORED_PAIRS] = np.einsum("ij,ij->i", a, b)
    return out


def unit_rows(X: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; a zero row stays zero."""
    n = np.sqrt(np.einsum("ij,ij->i", X, X))[:, None]
    return X / np.where(n > 0, n, 1.0)


def distance_tiles(L: np.ndarray, R: np.ndarray, rows: int = 256, cols: int = 2048):
    """(first row, first column, distances) of tiles of L x R by matrix products;
    a tile is overwritten by the next one.  Distances below a hundredth of the
    points' spread, where a product loses digits, are computed from the
    differences."""
    mean = R.mean(axis=0)
    A, B = L - mean, R - mean
    an, bn = np.einsum("ij,ij->i", A, A), np.einsum("ij,ij->i", B, B)
    near = 1e-4 * max(an.max(), bn.max())
    # |l - r|^2 = -2 l.r + |r|^2 + |l|^2
    A = np.column_stack([A * -2, np.ones(len(A)), an])
    B = np.column_stack([B, bn, np.ones(len(B))])
    right = [np.ascontiguousarray(B[c:c + cols].T) for c in range(0, len(R), cols)]
    room = np.empty(min(rows, len(L)) * min(cols, len(R)))
    for s in range(0, len(L), rows):
        left = A[s:s + rows]
        for t, b in enumerate(right):
            D = room[:len(left) * b.shape[1]].reshape(len(left), -1)
            np.matmul(left, b, out=D)
            low = np.flatnonzero(~(D > near))
            np.maximum(D, 0.0, out=D)
            np.sqrt(D, out=D)
            if len(low):
                r, c = np.divmod(low, b.shape[1])
                D[r, c] = pair_scores(L, R, r + s, c + t * cols, "euclidean")
            yield s, t * cols, D


def _norms(X: np.ndarray) -> np.ndarray:
    m = np.abs(X).max(axis=1, initial=0.0)
    Y = X / np.where(m > 0, m, 1.0)[:, None]
    return m * np.sqrt(np.einsum("ij,ij->i", Y, Y))


def nearest_rows(L: np.ndarray, R: np.ndarray, k: int, metric: str, l_out: np.ndarray | None = None,
                 r_out: np.ndarray | None = None, round_digits: int | None = None):
    """Per row of L its k best rows of R by (score, position in R): arrays
    (row, column, score).  Pairs with ``l_out[row] == r_out[column]`` are left
    out, as are scores that are not finite.

    Blocks are compared tile by tile with a matrix product whose error is
    bounded; a pair is scored in double precision (``pair_scores``) if the
    bound lets it reach its row's k-th best score.  So the result is that of
    scoring all pairs, and no more than a tile is held.  Of equal rows of R
    only as many as can be returned are compared."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    if min(len(L), len(R), k) == 0:
        return none
    far = metric == "euclidean"
    if r_out is None:
        l_out, r_out, spare = np.full(len(L), -1), np.zeros(len(R), dtype=np.int64), 0
    else:
        spare = int(np.bincount(r_out).max())       # rows of R that one row of L may leave out
    same = np.ascontiguousarray(R).view(np.dtype((np.void, R.dtype.itemsize * R.shape[1]))).ravel()
    _, group = np.unique(same, return_inverse=True)
    at = np.arange(len(R))
    _, cand, _ = _first_k(group, np.zeros(len(R)), at, k + spare, at)
    cand = np.sort(cand[np.isfinite(R[cand]).all(axis=1)])
    lrow = np.flatnonzero(np.isfinite(L).all(axis=1))
    if min(len(cand), len(lrow)) == 0:
        return none
    L, R, l_out, r_out = L[lrow], R[cand], l_out[lrow], r_out[cand]
    dim = R.shape[1]
    slack = 10.0 ** -round_digits if round_digits is not None else 0.0
    if far:
        # |l - r|^2 = |l|^2 - 2 (l.r - |r|^2 / 2), both sides less the mean of R
        mean = R.mean(axis=0)
        A, B = L - mean, R - mean
        scale = max(_norms(A).max(), _norms(B).max()) or 1.0
        A, B = A / scale, B / scale
        an, bn = np.einsum("ij,ij->i", A, A), np.einsum("ij,ij->i", B, B)
        A, B = np.column_stack([A, np.ones(len(A))]), np.column_stack([B, -bn / 2])
        eps = 4 * (dim + 8) * 2.0 ** -53
    else:
        an, top = _norms(L), _norms(R).max() or 1.0
        an = np.where(an > 0, an, 1.0)
        A, B = (L / an[:, None]).astype(np.float32), (R / top).astype(np.float32)
        scale = an * top
        eps = 4 * (dim + 8) * 2.0 ** -24
    B = np.ascontiguousarray(B.T)

    def bound(score, rows):
        """Least product with which a pair can be as good as ``score``."""
        if far:
            return (an[rows] - ((score + slack) / scale) ** 2) / 2 - eps
        return (score - slack) / scale[rows] - eps

    out = []
    for r0 in range(0, len(L), TILE_ROWS):
        r1 = min(r0 + TILE_ROWS, len(L))
        need = np.full(r1 - r0, -np.inf, dtype=A.dtype)
        kr, kc, ks = none
        c0 = 0
        while c0 < len(R):
            c1 = min(c0 + (TILE_COLS if c0 else FIRST_COLS), len(R))
            G = A[r0:r1] @ B[:, c0:c1]
            if c0 == 0 and c1 >= k + spare:
                first = np.partition(G, c1 - k - spare, axis=1)[:, c1 - k - spare].astype(float)
                if far:
                    worst = scale * np.sqrt(np.maximum(an[r0:r1] - 2 * (first - eps), 0.0))
                else:
                    worst = (first - eps) * scale[r0:r1]
                need = bound(worst, np.arange(r0, r1)).astype(A.dtype)
            hr, hc = np.divmod(np.flatnonzero(G >= need[:, None]), c1 - c0)
            hr, hc = hr + r0, hc + c0
            ok = l_out[hr] != r_out[hc]
            hr, hc = hr[ok], hc[ok]
            if len(hr):
                sc = pair_scores(L, R, hr, hc, metric)
                if round_digits is not None:
                    sc = np.round(sc, round_digits)
                ok = np.isfinite(sc)
                kr, kc, ks = (np.concatenate([a, b[ok]]) for a, b in ((kr, hr), (kc, hc), (ks, sc)))
                kr, kc, ks, rank = _first_k(kr, ks if far else -ks, kc, k, kc, ks)
                full = rank == k
                rows = kr[full]
                need[rows - r0] = bound(ks[full], rows)
            c0 = c1
        out.append((kr, kc, ks))
    kr, kc, ks = (np.concatenate(x) for x in zip(*out))
    return lrow[kr], cand[kc], ks
