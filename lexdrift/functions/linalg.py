"""Dense and sparse linear algebra of one slice or pair of slices, in numpy, for grouped Arrow stages."""

from __future__ import annotations

import numpy as np

#: Rows up to which a matrix is decomposed directly; beyond, by seeded subspace iteration on its entries.
DENSE = 1200
#: Products of an entry and a value that are held at once: 32 MB.
PRODUCTS = 1 << 22


def row_sums(keys: np.ndarray, first: np.ndarray, other: np.ndarray, v: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Sums of v times rows ``other`` of x for each key, whose entries begin at ``first``; some rows of entries at a time, so that memory doesn't grow with them."""
    out = np.zeros((rows, x.shape[1]))
    most = max(1, PRODUCTS // max(1, x.shape[1]))
    ends, a = np.append(first[1:], len(v)), 0
    while a < len(keys):
        b = max(a + 1, int(np.searchsorted(ends, first[a] + most, side="right")))
        lo, hi = first[a], ends[b - 1]
        out[keys[a:b]] = np.add.reduceat(v[lo:hi, None] * x[other[lo:hi]], first[a:b] - lo, axis=0)
        a = b
    return out


def product(i: np.ndarray, j: np.ndarray, v: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """The product of a matrix of entries (i, j, v) with x."""
    order = np.argsort(i, kind="stable")
    keys, first = np.unique(i[order], return_index=True)
    return row_sums(keys, first, j[order], v[order], x, rows)


class Sparse:
    """Entries (i, j, value) with products from both sides; never dense."""

    def __init__(self, i: np.ndarray, j: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.by_row = self._sorted(i, j, value)
        self.by_column = self._sorted(j, i, value)

    @staticmethod
    def _sorted(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(a, kind="stable")
        keys, first = np.unique(a[order], return_index=True)
        return keys, first, b[order], v[order].astype(np.float64)

    def _times(self, parts: tuple[np.ndarray, ...], x: np.ndarray, rows: int) -> np.ndarray:
        return row_sums(*parts, x, rows)

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.by_row, x, self.shape[0])

    def transposed_dot(self, x: np.ndarray) -> np.ndarray:
        return self._times(self.by_column, x, self.shape[1])

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        keys, first, other, v = self.by_row
        out[np.repeat(keys, np.diff(np.append(first, len(v)))), other] = v
        return out


def signed(u: np.ndarray, vt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs such that the entry of largest size in each left vector is positive."""
    s = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    s[s == 0] = 1
    return u * s, vt * s[:, None]


def truncated_svd(m: Sparse, k: int, seed: int = 0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest singular values, in descending order, with their vectors. An error if the iteration doesn't settle.

    Only rows and columns with entries take part; beyond their rank values and vectors are zero.
    """
    rows, columns = m.by_row[0], m.by_column[0]
    if len(rows) < m.shape[0] or len(columns) < m.shape[1]:
        _, first, other, v = m.by_row
        r = min(k, len(rows), len(columns))
        u, s, vt = np.zeros((m.shape[0], k)), np.zeros(k), np.zeros((k, m.shape[1]))
        if r:
            i = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(v))))
            inner = Sparse(i, np.searchsorted(columns, other), v, (len(rows), len(columns)))
            u[rows, :r], s[:r], vt[:r, columns] = truncated_svd(inner, r, seed, rounds)
        return u, s, vt
    if max(m.shape) <= DENSE:
        u, s, vt = np.linalg.svd(m.dense(), full_matrices=False)
    else:
        size = min(min(m.shape), 2 * k + 16)
        q, _ = np.linalg.qr(m.dot(np.random.default_rng(seed).standard_normal((m.shape[1], size))))
        last = np.zeros(size)
        for _ in range(rounds):
            z, r = np.linalg.qr(m.transposed_dot(q))
            q, _ = np.linalg.qr(m.dot(z))
            values = np.linalg.svd(r, compute_uv=False)
            moved, last = np.abs(values[:k] - last[:k]).max() / max(values[0], 1e-300), values
            if moved <= 1e-10:
                break
        if moved > 1e-6:
            raise np.linalg.LinAlgError(f"singular values still move by {moved:.1e} after {rounds} rounds")
        u, s, vt = np.linalg.svd(m.transposed_dot(q).T, full_matrices=False)
        u = q @ u
    u, vt = signed(u[:, :k], vt[:k])
    return u, s[:k], vt


def rotation(cross: np.ndarray) -> tuple[np.ndarray, float]:
    """The orthogonal matrix nearest to ``cross`` = A'B, and the sum of singular values."""
    u, s, vt = np.linalg.svd(cross)
    return u @ vt, float(s.sum())


def start_factors(m: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors from the singular vectors: of each pair the sign's half with more weight."""
    u, s, vt = truncated_svd(m, k)
    w, h = np.zeros((m.shape[0], k)), np.zeros((k, m.shape[1]))
    for c in range(k):
        a, b = u[:, c], vt[c]
        halves = [(np.maximum(a, 0), np.maximum(b, 0)), (np.maximum(-a, 0), np.maximum(-b, 0))]
        norms = [np.linalg.norm(x) * np.linalg.norm(y) for x, y in halves]
        best = int(norms[1] > norms[0]) if c else int(np.abs(halves[1][0]).sum() > np.abs(halves[0][0]).sum())
        x, y = halves[best]
        if norms[best] > 0:
            w[:, c] = np.sqrt(s[c] * norms[best]) * x / np.linalg.norm(x)
            h[c] = np.sqrt(s[c] * norms[best]) * y / np.linalg.norm(y)
    return w, h


def sweep(x: np.ndarray, gram: np.ndarray, target: np.ndarray) -> float:
    """Moves each column of x in turn to where it is best, as far as it is not negative; how far they have moved."""
    moved = 0.0
    for c in range(x.shape[1]):
        if gram[c, c] > 0:
            new = np.maximum(0, x[:, c] + (target[:, c] - x @ gram[:, c]) / gram[c, c])
            moved += float(np.abs(new - x[:, c]).sum())
            x[:, c] = new
    return moved


def factorise(m: Sparse, k: int, most: int = 500, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative M = W H by cyclic updates of one component at a time."""
    w, h = start_factors(m, k)
    first = None
    for _ in range(most):
        moved = sweep(w, h @ h.T, m.dot(h.T))
        ht = h.T.copy()
        moved += sweep(ht, w.T @ w, m.transposed_dot(w))
        h = ht.T
        first = moved if first is None else first
        if moved <= tolerance * max(first, 1e-30):
            break
    return w, h


def non_negative_weights(gram: np.ndarray, target: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Weights w >= 0 with w H nearest to x, from ``gram`` = H H' and ``target`` = H x: a row of each for each x."""
    w = np.zeros(target.shape)
    for _ in range(rounds):
        before = w.copy()
        for c in range(w.shape[-1]):
            if gram[c, c] > 0:
                w[..., c] = np.maximum(0.0, w[..., c] + (target[..., c] - w @ gram[c]) / gram[c, c])
        if np.abs(w - before).max(initial=0) < 1e-12:
            break
    # Where topics are much alike that is slow at the end: with the found weights' zeros the others are the solution of equations.
    rows = np.atleast_2d(w)
    targets = np.atleast_2d(target)
    left = np.ones(len(rows), bool)
    patterns, which = np.unique(rows > 0, axis=0, return_inverse=True)
    for n, p in enumerate(patterns):
        at = np.flatnonzero(which.ravel() == n)
        part = gram[np.ix_(p, p)]
        if not p.any() or np.linalg.cond(part) > 1e12:
            continue
        exact = np.zeros((len(at), len(p)))
        exact[:, p] = np.linalg.solve(part, targets[at][:, p].T).T
        slope = exact @ gram - targets[at]
        good = (exact >= 0).all(1) & (slope >= -1e-9 * np.abs(targets[at]).max(1, keepdims=True)).all(1)
        rows[at[good]] = exact[good]
        left[at[good]] = False
    # Some have stopped short of their zeros: from there weights are freed and bound one at a time.
    for i in np.flatnonzero(left):
        rows[i] = settled_weights(gram, targets[i], rows[i])
    return rows.reshape(target.shape)


def settled_weights(gram: np.ndarray, target: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The weights >= 0 that are best for one ``target``, from any weights >= 0, by active sets: each round solves for the free ones, which lessens what is left."""
    w, free = start.copy(), start > 0
    least = 1e-11 * np.abs(target).max(initial=0)
    for _ in range(20 * len(w)):
        while free.any():
            new = np.zeros(len(w))
            new[free] = np.linalg.lstsq(gram[np.ix_(free, free)], target[free], rcond=None)[0]
            below = np.flatnonzero(free & (new <= 0))
            if not len(below):
                w = new
                break
            # As far as the first weight that comes to zero, which is bound.
            steps = w[below] / np.maximum(w[below] - new[below], 1e-300)
            w = np.maximum(0.0, w + steps.min() * (new - w))
            w[below[steps <= steps.min()]] = 0.0
            free &= w > 0
        gain = np.where(free, 0.0, target - gram @ w)
        if gain.max(initial=0) <= least:
            break
        free[int(gain.argmax())] = True
    return w


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the smaller side has; shortest augmenting paths."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach = np.full(m, np.inf)
        back = np.full(m, -1)
        done = np.zeros(m, bool)
        at, column, base = row, -1, 0.0
        while True:
            step = base + c[at] - row_price[at] - column_price
            better = ~done & (step < reach)
            reach[better], back[better] = step[better], column
            open_ = np.where(done, np.inf, reach)
            column = int(open_.argmin())
            base = float(open_[column])
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        closed = np.flatnonzero(done)
        for j in closed:
            column_price[j] += min(reach[j], base) - base
            if owner[j] >= 0:
                row_price[owner[j]] += base - min(reach[j], base)
        row_price[row] += base
        while column >= 0:
            previous = back[column]
            owner[column] = owner[previous] if previous >= 0 else row
            column = previous
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)
