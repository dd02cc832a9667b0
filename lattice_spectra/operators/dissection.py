"""Lowest eigenpairs of large sparse symmetric matrices by nested dissection.

A graph is cut in halves again and again by separators that lie midway between
two far nodes; eliminating halves before separators keeps a factorisation near
n log n numbers for graphs of places, where breadth-first levels take n to the
power 1.5. It serves as the inverse of a block Lanczos iteration below the
spectrum's lower end. A second one counts the eigenvalues below the last pair
found, by the signs of its pivots, so that none is missed.
"""

from __future__ import annotations

import numpy as np

#: Nodes up to which a piece isn't cut, columns of a Lanczos block, residual over the matrix's size at which a pair is done.
LEAF, COLUMNS, RESIDUAL = 40, 8, 1e-10
#: Shifts below zero over the matrix's size that are tried before that below every eigenvalue's bound.
SHIFTS = (1e-5, 1e-3)


def parts_of(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's connected part."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        np.minimum.at(new, cols, label[rows])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _steps(near: np.ndarray, starts: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Steps of each node from the root in its part, -1 without one."""
    away, last, step = np.full(len(starts) - 1, -1), roots, 0
    away[roots] = 0
    while len(last):
        step += 1
        size = starts[last + 1] - starts[last]
        new = near[np.repeat(starts[last] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
        new = new[away[new] < 0]
        away[new] = step
        last = np.unique(new)
    return away


def pieces(rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[list[np.ndarray], list[int]]:
    """Separators and leaves, and the number of the separator above each (-1: none), which comes before it.

    Nodes of a piece have neighbours only in it, above it and below it.
    """
    order = np.argsort(rows, kind="stable")
    i, j = rows[order], cols[order]
    i, j = i[i != j], j[i != j]
    found: list[np.ndarray] = []
    above: list[int] = []
    home, side, active = np.full(n, -1), np.zeros(n, int), np.ones(n, bool)
    while active.any():
        nodes = np.flatnonzero(active)
        starts = np.searchsorted(i, np.arange(n + 1))
        _, first, half = np.unique(home[nodes] * 3 + side[nodes], return_index=True, return_inverse=True)
        part = np.full(n, -1)
        part[nodes] = nodes[first][half]  # most halves are connected
        rest = active & (_steps(j, starts, nodes[first]) < 0)
        both = rest[i] & rest[j]
        part[rest] = parts_of(i[both], j[both], n)[rest]
        nodes = nodes[np.lexsort((part[nodes], home[nodes]))]
        first = np.flatnonzero(np.r_[True, np.diff(part[nodes]) != 0])
        size = np.diff(np.r_[first, len(nodes)])
        big = size > LEAF
        small = np.flatnonzero(~big)
        if len(small):  # parts of one home are put together up to a leaf's size
            at = home[nodes[first[small]]]
            before = np.cumsum(size[small]) - size[small]
            before -= np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], before, 0))
            group = np.r_[0, np.cumsum((at[1:] != at[:-1]) | (before[1:] // LEAF != before[:-1] // LEAF))]
            for own in np.split(small, np.flatnonzero(np.diff(group)) + 1):
                found.append(np.concatenate([nodes[first[t] : first[t] + size[t]] for t in own]))
                above.append(int(home[found[-1][0]]))
                active[found[-1]] = False
        if big.any():
            units = [nodes[a : a + m] for a, m in zip(first[big], size[big], strict=True)]
            farthest = lambda away: np.array([own[away[own].argmax()] for own in units])  # noqa: B023, E731
            one = farthest(_steps(j, starts, np.array([own[0] for own in units])))
            from_one = _steps(j, starts, one)
            between = from_one - _steps(j, starts, farthest(from_one))
            side[:] = 0
            for own in units:
                for value in (between[own], from_one[own]):
                    middle = np.partition(value, len(value) // 2)[len(value) // 2]
                    low = value <= middle if (value > middle).any() else value < middle
                    if low.any():
                        break
                side[own] = np.where(low, 1, 2)
            edge = np.zeros(n, bool)
            edge[i[(side[i] == 1) & (side[j] == 2)]] = True
            for own in units:
                cut = own[edge[own]]
                cut = cut if len(cut) else own  # all nodes are alike
                found.append(cut)
                above.append(int(home[own[0]]))
                home[own] = len(found) - 1
                active[cut] = False
        keep = active[i] & active[j]
        i, j = i[keep], j[keep]
    return found, above


class Fronts:
    """A symmetric matrix, in an order of nested dissection, as the dense fronts of its factorisation."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int):
        found, above = pieces(rows[values != 0], cols[values != 0], n)
        below: list[list[int]] = [[] for _ in found]
        for t, up in enumerate(above):
            if up >= 0:
                below[up].append(t)
        walk, open_pieces = [], [t for t, up in enumerate(above) if up < 0]
        while open_pieces:
            walk.append(open_pieces.pop())
            open_pieces += below[walk[-1]]
        walk.reverse()  # all below a piece come before it
        rank = np.empty(len(walk), int)
        rank[walk] = np.arange(len(walk))
        self.n, self.order = n, np.concatenate([found[t] for t in walk])
        self.ends = np.r_[0, np.cumsum([len(found[t]) for t in walk])]
        self.below = [[int(rank[c]) for c in below[t]] for t in walk]
        place = np.empty(n, int)
        place[self.order] = np.arange(n)
        i, j = place[rows], place[cols]
        sort = np.argsort(i, kind="stable")
        self.i, self.j, self.v = i[sort], j[sort], values[sort]
        self.starts = np.searchsorted(self.i, self.ends)
        self.border: list[np.ndarray] = []
        for t in range(len(walk)):
            far = [self.j[self.starts[t] : self.starts[t + 1]], *[self.border[c] for c in self.below[t]]]
            far = np.unique(np.concatenate(far))
            self.border.append(far[far >= self.ends[t + 1]])
        radius = np.bincount(self.i, np.where(self.i == self.j, 0.0, np.abs(self.v)), n)
        middle = np.bincount(self.i, np.where(self.i == self.j, self.v, 0.0), n)
        self.low, self.high = float((middle - radius).min()), float((middle + radius).max())
        self.size = max(abs(self.low), abs(self.high), 1e-300)

    def weight(self) -> int:
        """Bytes of a factorisation, with its largest front."""
        own, far = np.diff(self.ends), np.array([len(x) for x in self.border])
        return int(8 * ((own * (own + far)).sum() + ((own + far) ** 2).max()))

    def _eliminated(self, shift: float):
        """Of each piece in turn its pivot block, that block beside it, and a function that takes the product of the pivot's inverse with the latter."""
        updates: dict[int, np.ndarray] = {}
        for t in range(len(self.border)):
            a, b, far = self.ends[t], self.ends[t + 1], self.border[t]
            m = b - a
            local = lambda at: np.where(at < b, at - a, m + np.searchsorted(far, at))  # noqa: B023, E731
            front = np.zeros((m + len(far),) * 2)
            span = slice(self.starts[t], self.starts[t + 1])
            i, j, v = self.i[span], self.j[span], self.v[span]
            np.add.at(front, (i[j >= a] - a, local(j[j >= a])), v[j >= a])
            front[np.arange(m), np.arange(m)] -= shift
            for c in self.below[t]:
                at = local(self.border[c])
                front[np.ix_(at, at)] += updates.pop(c)
            pivot, beside = (front[:m, :m] + front[:m, :m].T) / 2, front[:m, m:].copy()
            yield t, pivot, beside, lambda turned, front=front, m=m, beside=beside, t=t: updates.__setitem__(t, front[m:, m:] - beside.T @ turned)

    def count(self, shift: float) -> int:
        """Number of eigenvalues below ``shift``: the pivots' negative ones."""
        found = 0
        for _, pivot, beside, pass_on in self._eliminated(shift):
            found += int((np.linalg.eigvalsh(pivot) < 0).sum())
            pass_on(np.linalg.solve(pivot, beside))
        return found

    def inverse(self, shift: float):
        """A function that takes columns to their product with the inverse of the matrix less ``shift``, or None if an eigenvalue is below ``shift``."""
        kept = []
        for _, pivot, beside, pass_on in self._eliminated(shift):
            try:
                np.linalg.cholesky(pivot)
            except np.linalg.LinAlgError:
                return None
            own = np.linalg.inv(pivot)
            own = (own + own.T) / 2
            turned = own @ beside
            pass_on(turned)
            kept.append((own, turned))
        ends, border = self.ends, self.border

        def times(x: np.ndarray) -> np.ndarray:
            y = np.array(x, order="C")
            for t, (_, turned) in enumerate(kept):
                y[border[t]] -= turned.T @ y[ends[t] : ends[t + 1]]
            for t in range(len(kept) - 1, -1, -1):
                own, turned = kept[t]
                y[ends[t] : ends[t + 1]] = own @ y[ends[t] : ends[t + 1]] - turned @ y[border[t]]
            return y

        return times

    def plain(self, x: np.ndarray) -> np.ndarray:
        """The matrix's own product with columns."""
        out = np.empty(x.shape)
        for c in range(x.shape[1]):
            out[:, c] = np.bincount(self.i, self.v * x[self.j, c], self.n)
        return out

    def lowest(self, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The k lowest eigenpairs, ascending; None if they don't settle or a count finds more."""
        shift = 0.0
        for shift in (*[-s * self.size for s in SHIFTS], self.low - 1e-3 * self.size):
            times = self.inverse(shift)
            if times is not None:
                break
        else:
            return None
        p, spare = COLUMNS, 4
        most = min(self.n - p, 8 * (k + spare) + 40 * p) // p * p
        if most < k + spare:
            return None
        basis = np.empty((self.n, min(most, 2 * (k + spare) + 6 * p) + p), order="F")
        basis[:, :p] = np.linalg.qr(np.random.default_rng(1618).standard_normal((self.n, p)))[0]
        inner, m, ask = np.zeros((most + p, most + p)), 0, k + spare + 3 * p
        while True:
            done = m + p
            x = times(basis[:, m:done])
            own = basis[:, :done]
            inner[:done, m:done] = first = own.T @ x
            x -= own @ first
            x -= own @ (own.T @ x)
            q, r = np.linalg.qr(x)
            m = done
            if m >= ask or m >= most:
                whole = inner[:m, :m]
                theta, turn = np.linalg.eigh(np.triu(whole) + np.triu(whole, 1).T)
                top = np.arange(m - 1, m - 1 - k - spare, -1)  # the largest of the inverse are the lowest
                left = np.sqrt(((r @ turn[m - p : m][:, top]) ** 2).sum(axis=0)) / np.abs(theta[top]) * np.maximum(self.size, 1)
                if (theta[top] > 0).all() and (left <= RESIDUAL * self.size).all():
                    x = own @ turn[:, top]
                    break
                if m >= most:
                    return None
                ask = m + p
            if m + p > basis.shape[1]:
                wider = np.empty((self.n, min(most, m + 6 * p) + p), order="F")
                wider[:, :m] = basis[:, :m]
                basis = wider
            basis[:, m : m + p] = q
        del basis, own, q
        for _ in range(4):
            x = np.linalg.qr(x)[0]
            ax = self.plain(x)
            values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
            x, ax = x @ turn, ax @ turn
            if np.sqrt(((ax - x * values) ** 2).sum(axis=0)).max() <= RESIDUAL * self.size:
                break
            x = times(x)
        else:
            return None
        del times, ax
        c = k + int(np.diff(values[k - 1 :]).argmax())
        if self.count((values[c - 1] + values[c]) / 2) != c:
            return None
        vectors = np.empty((self.n, k))
        vectors[self.order] = x[:, :k]
        return values[:k], vectors
