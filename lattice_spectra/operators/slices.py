"""Eigenpairs of large sparse symmetric matrices by slices of the spectrum.

A connected graph's breadth-first levels make its matrix block tridiagonal. A
factorisation at a shift then counts the eigenvalues below it exactly, by the
signs of its pivots, and serves as the inverse of a block Lanczos iteration that
finds the eigenpairs around it. A slice is done only when as many pairs have
settled as the counts at its two ends say, so none is missed or found twice.
Memory is that of one factorisation and of one slice's vectors, never a dense
matrix; all pairs take time that grows with the square of the nodes, not the cube.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs wanted of a slice, columns of a Lanczos block, columns at which blocks of levels are closed.
SLICE, COLUMNS, LEAST = 192, 8, 64
#: Bytes of a factorisation up to which products of inverses and blocks above the diagonal are kept as well.
KEPT = 64 << 20
#: Residual over the matrix's size at which a pair is done.
RESIDUAL = 1e-10


def levels(rows: np.ndarray, cols: np.ndarray, n: int) -> list[np.ndarray]:
    """Breadth-first levels of a connected graph from a far node, small ones joined; only neighbouring blocks share entries."""
    order = np.argsort(rows, kind="stable")
    near, starts = cols[order], np.searchsorted(rows[order], np.arange(n + 1))

    def walk(root: int) -> list[np.ndarray]:
        seen = np.zeros(n, bool)
        seen[root] = True
        found = [np.array([root])]
        while True:
            last = found[-1]
            size = starts[last + 1] - starts[last]
            at = np.repeat(starts[last] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            new = np.unique(near[at])
            new = new[~seen[new]]
            if not len(new):
                return found
            seen[new] = True
            found.append(new)

    found = walk(int(walk(int(walk(0)[-1][0]))[-1][0]))
    out: list[list[np.ndarray]] = [[]]
    for level in found:
        if out[-1] and sum(map(len, out[-1])) + len(level) > LEAST:
            out.append([])
        out[-1].append(level)
    return [np.concatenate(x) for x in out]


class Blocks:
    """A connected symmetric matrix as diagonal blocks and those above the diagonal, in an order of its nodes."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int):
        own = levels(rows[values != 0], cols[values != 0], n)
        self.n, self.order = n, np.concatenate(own)
        self.ends = np.r_[0, np.cumsum([len(x) for x in own])]
        place = np.empty(n, int)
        place[self.order] = np.arange(n)
        i, j = place[rows], place[cols]
        a, b = (np.searchsorted(self.ends, x, side="right") - 1 for x in (i, j))
        self.inside, self.above = [], []
        sort = np.lexsort((b - a, a))
        i, j, v, a, b = i[sort], j[sort], values[sort], a[sort], b[sort]
        cut = np.searchsorted(a, np.arange(len(own) + 1))
        for t in range(len(own)):
            span, m = slice(cut[t], cut[t + 1]), self.ends[t + 1] - self.ends[t]
            here, up = b[span] == t, b[span] == t + 1
            self.inside.append((i[span][here] - self.ends[t], j[span][here] - self.ends[t], v[span][here]))
            if t + 1 < len(own):
                block = np.zeros((m, self.ends[t + 2] - self.ends[t + 1]))
                np.add.at(block, (i[span][up] - self.ends[t], j[span][up] - self.ends[t + 1]), v[span][up])
                self.above.append(block)
        radius = np.bincount(i, np.where(i == j, 0.0, np.abs(v)), n)
        middle = np.bincount(i, np.where(i == j, v, 0.0), n)
        self.low, self.high = float((middle - radius).min()), float((middle + radius).max())
        self.size = max(abs(self.low), abs(self.high), 1e-300)

    def diagonal(self, t: int, shift: float = 0.0) -> np.ndarray:
        """A block of the diagonal of the matrix less ``shift``, made dense."""
        i, j, v = self.inside[t]
        block = np.zeros((self.ends[t + 1] - self.ends[t],) * 2)
        np.add.at(block, (i, j), v)
        block = (block + block.T) / 2
        block[np.diag_indices(len(block))] -= shift
        return block

    def below(self, shift: float) -> int:
        """Number of eigenvalues below ``shift``: the pivots' negative ones."""
        count, pivot = 0, None
        for t in range(len(self.inside)):
            here = self.diagonal(t, shift)
            if t:
                here -= self.above[t - 1].T @ np.linalg.solve(pivot, self.above[t - 1])
                here = (here + here.T) / 2
            count += int((np.linalg.eigvalsh(here) < 0).sum())
            pivot = here
        return count

    def inverse(self, shift: float):
        """A function that takes columns to their product with the inverse of the matrix less ``shift``."""
        inverses, turned = [], []
        keep, last = 2 * self.weight() <= KEPT, None
        for t in range(len(self.inside)):
            here = self.diagonal(t, shift)
            if t:
                here -= self.above[t - 1].T @ last
            own = np.linalg.inv((here + here.T) / 2)
            inverses.append((own + own.T) / 2)
            if t + 1 < len(self.inside):
                last = inverses[-1] @ self.above[t]
                if keep:
                    turned.append(last)
        ends, above = self.ends, self.above

        def times(x: np.ndarray) -> np.ndarray:
            y = x.copy()
            for t in range(1, len(inverses)):
                y[ends[t] : ends[t + 1]] -= turned[t - 1].T @ y[ends[t - 1] : ends[t]] if keep else above[t - 1].T @ (inverses[t - 1] @ y[ends[t - 1] : ends[t]])
            for t in range(len(inverses) - 1, -1, -1):
                if t + 1 < len(inverses) and not keep:
                    y[ends[t] : ends[t + 1]] -= above[t] @ y[ends[t + 1] : ends[t + 2]]
                y[ends[t] : ends[t + 1]] = inverses[t] @ y[ends[t] : ends[t + 1]]
                if t + 1 < len(inverses) and keep:
                    y[ends[t] : ends[t + 1]] -= turned[t] @ y[ends[t + 1] : ends[t + 2]]
            return y

        return times

    def weight(self) -> int:
        """Bytes of a factorisation."""
        size = np.diff(self.ends)
        return int(8 * ((size * size).sum() + (size[1:] * size[:-1]).sum()))

    def around(self, shift: float, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The ``count`` eigenpairs of [low, high), ascending, by block Lanczos with the inverse at ``shift``; None if they don't settle."""
        times, p = self.inverse(shift), COLUMNS
        most = min(self.n - p, 4 * count + 40 * p) // p * p
        basis = np.empty((self.n, most + p), order="F")
        basis[:, :p] = np.linalg.qr(np.random.default_rng(1618).standard_normal((self.n, p)))[0]
        inner = np.zeros((most + p, most + p))
        m, ask = 0, min(most, int(1.7 * count) + 8 * p)
        while True:
            done = m + p
            x = times(basis[:, m:done])
            own = basis[:, :done]
            last = slice(max(0, m - p), done)  # but for rounding, x leans on the last two blocks only
            inner[last, m:done] = first = basis[:, last].T @ x
            x -= basis[:, last] @ first
            x -= own @ (own.T @ x)
            q, r = np.linalg.qr(x)
            m = done
            if m >= ask or m >= most:
                whole = inner[:m, :m]
                theta, turn = np.linalg.eigh((np.triu(whole) + np.triu(whole, 1).T))
                with np.errstate(divide="ignore"):
                    found = shift + 1 / theta
                # a residual of the inverse's pair, over theta, is one of the matrix's own
                left = np.sqrt(((r @ turn[m - p : m]) ** 2).sum(axis=0)) / np.abs(theta) * np.maximum(self.size, 1)
                keep = np.flatnonzero((found >= low) & (found < high) & (left <= RESIDUAL * self.size))
                if len(keep) == count:
                    keep = keep[np.argsort(found[keep])]
                    vectors = np.empty((self.n, count))
                    vectors[self.order] = own @ turn[:, keep]
                    return found[keep], vectors
                if m >= most:
                    return None
                ask = m + max(3 * p, count // 4)
            basis[:, m : m + p] = q


def slices(blocks: Blocks, target: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All eigenpairs of a connected symmetric matrix as ``(values, vectors)`` of rising slices."""
    n, target = blocks.n, target or SLICE
    if len(blocks.inside) == 1:
        values, vectors = np.linalg.eigh(blocks.diagonal(0))
        whole = np.empty((n, n))
        whole[blocks.order] = vectors
        yield values, whole
        return
    margin = 1e-6 * blocks.size
    low, before, end = blocks.low - margin, 0, blocks.high + margin
    width = (end - low) * target / n
    while before < n:
        high = min(low + width, end)
        while True:
            after = n if high >= end else blocks.below(high)
            count = after - before
            if count <= 1.5 * target or high - low <= 1e-9 * blocks.size:
                break
            high = low + (high - low) * max(0.1, 0.9 * target / count)
        if count:
            shift, found = (low + high) / 2, None
            for bend in (0.0, 0.0371, -0.0533):
                found = blocks.around(shift + bend * (high - low), low, high, count)
                if found is not None:
                    break
            if found is None:
                if target <= 4:
                    raise ValueError("the eigenpairs of a slice didn't settle")
                target = max(4, target // 2)
                width = (high - low) / 2
                continue
            yield found
        width = (high - low) * min(4.0, max(0.25, target / count if count else 4.0))
        low, before = high, after
