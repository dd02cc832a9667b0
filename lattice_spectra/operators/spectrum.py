"""Eigenpairs of graph Laplacians and statistics of modes and eigenvalues.

Symmetric eigendecomposition isn't relational: each network is one group of an
Arrow function, so any number of networks runs in parallel. Where some modes of a
larger network are asked for, they come from its sparse rows without a dense
matrix. A network too large for one task goes through distributed singular values
instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dissection import Fronts, parts_of
from .slices import Blocks, slices

WHICH = ("smallest", "largest", "both")
#: Nodes up to which a network's matrix is decomposed whole; beyond, up to a ``SHARE``-th of its modes come from sparse rows.
DENSE = 1_500
SHARE = 16
#: Degree of the filter, passes at most, and residual over the matrix's size at which a pair is done.
DEGREE, PASSES, RESIDUAL = 40, 200, 1e-10
#: Bytes of a factorisation up to which a part's lowest or highest modes come by dissection or slices.
FACTORS = 300 << 20
#: Nodes beyond which a part's lowest or highest modes come by dissection.
DISSECTED = 4_000
#: Nodes up to which a part whose pairs don't settle is decomposed whole.
WHOLE = 10_000


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component (the first of equals, up to rounding) positive."""
    size = np.abs(vectors)
    top = (size >= size.max(axis=0, keepdims=True) * (1 - 1e-9)).argmax(axis=0)
    sign = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1.0, sign)


def eigen(matrix: np.ndarray, k: int | None = None, which: str = "smallest") -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and signed vectors; with ``k`` those of one end, or both (which may repeat)."""
    if which not in WHICH:
        raise ValueError(f"which must be one of {WHICH}")
    n = len(matrix)
    if k is not None and not 1 <= k <= n - 1:
        raise ValueError("k must be from 1 to one less than the number of nodes")
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    vectors = signed(vectors)
    if k is None:
        return values, vectors
    keep = {"smallest": np.arange(k), "largest": np.arange(n - k, n), "both": np.r_[np.arange(k), np.arange(n - k, n)]}[which]
    return values[keep], vectors[:, keep]


def dense(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Node ids in order, and the matrix of a table ``src, dst, v``."""
    ids = np.unique(np.concatenate([frame.src.to_numpy(), frame.dst.to_numpy()]))
    out = np.zeros((len(ids), len(ids)))
    out[np.searchsorted(ids, frame.src), np.searchsorted(ids, frame.dst)] = frame.v
    return ids, out


def sparse_eigen(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, k: int, which: str = "smallest") -> tuple[np.ndarray, np.ndarray]:
    """The k smallest or largest eigenpairs of a symmetric matrix from its entries.

    Connected parts are solved one by one, so that eigenvalues that parts have in
    common are found as often as they occur; small parts are made dense, those of
    over ``DISSECTED`` nodes go by nested dissection, others by slices from their
    end, or, where a factorisation is over ``FACTORS`` bytes, through
    Chebyshev-filtered subspaces. Memory is that of the entries and of
    some blocks of vectors.
    """
    if which not in ("smallest", "largest") or not 1 <= k < n:
        raise ValueError("which must be 'smallest' or 'largest', k from 1 to n - 1")
    part = parts_of(rows[values != 0], cols[values != 0], n)
    found = []
    for name in np.unique(part):
        own = np.flatnonzero(part == name)
        mine = np.flatnonzero((part[rows] == name) & (part[cols] == name))
        i, j, v, most = np.searchsorted(own, rows[mine]), np.searchsorted(own, cols[mine]), values[mine], min(k, len(own))
        pairs = _end(i, j, v, len(own), most, which) if len(own) > 8 * most else None
        if pairs is None:
            if len(own) > max(WHOLE, 8 * most):
                raise ValueError("the wanted eigenpairs didn't settle")
            whole = np.zeros((len(own), len(own)))
            np.add.at(whole, (i, j), v)
            pairs = np.linalg.eigh((whole + whole.T) / 2)
            pairs = (pairs[0][:most], pairs[1][:, :most]) if which == "smallest" else (pairs[0][-most:], pairs[1][:, -most:])
        found += [(float(x), own, pairs[1][:, c]) for c, x in enumerate(pairs[0])]
    found.sort(key=lambda x: x[0])
    found = found[:k] if which == "smallest" else found[-k:]
    vectors = np.zeros((n, k))
    for c, (_, own, vector) in enumerate(found):
        vectors[own, c] = vector
    return np.array([x for x, *_ in found]), vectors


def _end(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, k: int, which: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenpairs of one end of a connected part, ascending; None if they don't settle."""
    sign = 1.0 if which == "smallest" else -1.0
    if n > DISSECTED:
        fronts = Fronts(rows, cols, values * sign, n)
        lowest = fronts.lowest(k) if fronts.weight() <= FACTORS else None
        if lowest is not None:
            return lowest if which == "smallest" else (-lowest[0][::-1], lowest[1][:, ::-1])
        del fronts
    blocks = Blocks(rows, cols, values * sign, n)
    if blocks.weight() > FACTORS:
        return _filtered(rows, cols, values, n, k, which)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in slices(blocks, target=max(k, 16)):
        found.append(pair)
        if sum(len(v) for v, _ in found) >= k:
            break
    low, vectors = np.concatenate([v for v, _ in found])[:k], np.concatenate([x for _, x in found], axis=1)[:, :k]
    return (low, vectors) if which == "smallest" else (-low[::-1], vectors[:, ::-1])


def _filtered(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, k: int, which: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenpairs of one end, ascending; None if they don't settle.

    A block of k and some more vectors goes through a polynomial that is small
    on the unwanted part of the spectrum and grows fast beyond it, and is solved
    within, until the residuals of the wanted pairs are at rounding level.
    """
    sign = 1.0 if which == "smallest" else -1.0
    every = np.arange(n)
    rows, cols, values = np.r_[rows, every], np.r_[cols, every], np.r_[values * sign, np.zeros(n)]
    order = np.lexsort((cols, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    starts = np.searchsorted(rows, every)
    radius = np.add.reduceat(np.where(rows == cols, 0.0, np.abs(values)), starts)
    middle = np.add.reduceat(np.where(rows == cols, values, 0.0), starts)
    top, size = float((middle + radius).max()), float((np.abs(middle) + radius).max()) or 1.0
    step = max(1, (1 << 21) // max(1, len(values) // n))

    def times(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            a, b = starts[lo], starts[hi] if hi < n else len(values)
            for c in range(x.shape[1]):  # a column at a time is gathered from the cache
                out[lo:hi, c] = np.add.reduceat(values[a:b] * x[cols[a:b], c], starts[lo:hi] - a)
        return out

    width = min(n, k + max(8, k // 2))
    x = np.linalg.qr(np.random.default_rng(2718).standard_normal((n, width)))[0]
    x[:, 0] = np.sqrt(np.maximum(middle + radius, 0)) + 1e-3  # near a Laplacian's own first mode
    x = np.linalg.qr(x)[0]
    for _ in range(PASSES):
        ax = times(x)
        ritz, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax = x @ turn, ax @ turn
        left = np.sqrt(((ax[:, :k] - x[:, :k] * ritz[:k]) ** 2).sum(axis=0)).max()
        if left <= RESIDUAL * size or width == n:
            found = ritz[:k] * sign, x[:, :k]
            return found if which == "smallest" else (found[0][::-1], found[1][:, ::-1])
        low, cut = ritz[0], min(ritz[-1], top - 1e-9 * size)
        centre, half = (top + cut) / 2, max((top - cut) / 2, 1e-12 * size)
        scale = half / (low - centre)
        first = scale
        before, now = x, (ax - centre * x) * (first / half)
        for _ in range(DEGREE - 1):  # a scaled Chebyshev recursion, 1 at the lowest value
            new = 1 / (2 / first - scale)
            before, now = now, (times(now) - centre * now) * (2 * new / half) - before * (scale * new)
            scale = new
        x = np.linalg.qr(now)[0]
    return None


def every_pair(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, whole_up_to: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All eigenpairs of a symmetric matrix from its entries, as ``(values, own, vectors)`` of some of them at a time.

    ``own`` are the rows of a connected part, outside which the vectors are 0.
    Parts of up to ``whole_up_to`` (or ``DENSE``) rows are made dense, others go by slices of their
    spectrum, so that memory doesn't grow with the square of the nodes.
    """
    part = parts_of(rows[values != 0], cols[values != 0], n)
    order = np.argsort(part, kind="stable")
    entry = np.argsort(part[rows], kind="stable")
    inside = np.empty(n, int)
    for own, mine in zip(np.split(order, np.flatnonzero(np.diff(part[order])) + 1), np.split(entry, np.flatnonzero(np.diff(part[rows][entry])) + 1), strict=True):
        inside[own] = np.arange(len(own))
        i, j, v = inside[rows[mine]], inside[cols[mine]], values[mine]
        if len(own) > (whole_up_to or DENSE):
            for found, vectors in slices(Blocks(i, j, v, len(own))):
                yield found, own, vectors
        else:
            whole = np.zeros((len(own), len(own)))
            np.add.at(whole, (i, j), v / 2)
            np.add.at(whole, (j, i), v / 2)
            found, vectors = np.linalg.eigh(whole)
            del whole
            yield found, own, vectors


def participations(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, whole_up_to: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and their modes' inverse participations, from a matrix's entries."""

    def ipr(x: np.ndarray) -> np.ndarray:
        squares = (x[:, s : s + 64] ** 2 for s in range(0, x.shape[1], 64))  # some columns at a time
        return np.concatenate([(q * q).sum(axis=0) / q.sum(axis=0) ** 2 for q in squares])

    found = [(v, ipr(x)) for v, _, x in every_pair(rows, cols, values, n, whole_up_to)]
    every, ipr = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(every, kind="stable")
    return every[order], ipr[order]


def spectral_decomposition(laplacian: DataFrame, k: int | None = None, which: str = "smallest", by: list[str] | None = None, clip: bool = False) -> DataFrame:
    """``network, mode, lambda, node_ids, psi``: a row for each eigenpair, modes numbered by rising eigenvalue.

    ``psi`` and ``node_ids`` are arrays in one order. The lineage of a network
    is its rows of the Laplacian; it must fit one task. With ``k``, a network of
    over ``DENSE`` nodes and ``SHARE`` times k is never made dense; eigenvalues
    are the same to rounding. ``clip`` gives a network of k nodes or fewer all
    of its modes, where it would be an error.
    """
    by = by or ["network"]
    if which not in WHICH:
        raise ValueError(f"which must be one of {WHICH}")

    def pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, entries = _entries(frame)
        n, most = len(ids), k
        if k is not None and clip and k >= n:
            most = None
        if most is not None and n > DENSE and SHARE * most <= n:
            ends = [sparse_eigen(*entries, n, most, e) for e in (("smallest", "largest") if which == "both" else (which,))]
            values, vectors = np.concatenate([v for v, _ in ends]), signed(np.concatenate([x for _, x in ends], axis=1))
        else:
            values, vectors = eigen(dense(frame)[1], most, which)
        modes = np.arange(len(values)) if most is None or which == "smallest" else np.arange(n - most, n) if which == "largest" else np.r_[np.arange(most), np.arange(n - most, n)]
        return ids, modes, values, vectors

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ids, modes, values, vectors = pairs(frame)
        out = {c: [frame[c].iloc[0]] * len(values) for c in by}
        return pd.DataFrame(out | {"mode": modes, "lambda": values, "node_ids": [ids] * len(values), "psi": list(vectors.T)})

    kinds = {f.name: f.dataType.simpleString() for f in laplacian.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    return laplacian.select(*by, "src", "dst", "v").groupBy(*by).applyInPandas(solve, f"{keys}, mode int, lambda double, node_ids array<bigint>, psi array<double>")


def mode_statistics(laplacian: DataFrame, keep: int = 0, by: list[str] | None = None) -> DataFrame:
    """``network, mode, lambda, n, ipr, pr, node_ids, psi`` of all modes; arrays are null but for the ``keep`` most localised ones (ties to the lower).

    What ``spectrum`` gives of all eigenpairs, without their n vectors of n
    components leaving the task: a network of over ``DENSE`` nodes goes by slices
    of its spectrum, whose vectors are let go one after the other.
    """
    by = by or ["network"]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ids, entries = _entries(frame)
        n = len(ids)
        top: list[tuple] = []
        every: list[np.ndarray] = []
        iprs: list[np.ndarray] = []
        at = 0
        if n > DENSE:
            found = every_pair(*entries, n)
        else:
            values, vectors = eigen(dense(frame)[1])
            found = iter([(values, np.arange(n), vectors)])
        for values, own, vectors in found:
            ipr = (vectors**4).sum(axis=0) / (vectors**2).sum(axis=0) ** 2
            first = np.argsort(-ipr, kind="stable")[:keep]
            top += [(-ipr[c], values[c], at + c, own, vectors[:, c].copy()) for c in first]
            top = sorted(top, key=lambda t: t[:3])[:keep]
            every.append(values)
            iprs.append(ipr)
            at += len(values)
        values, ipr = np.concatenate(every), np.concatenate(iprs)
        order = np.argsort(values, kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        out = pd.DataFrame({c: [frame[c].iloc[0]] * n for c in by} | {"mode": np.arange(n), "lambda": values[order], "n": n, "ipr": ipr[order], "pr": 1 / (n * ipr[order] + 1e-30)})
        out["node_ids"] = out["psi"] = None
        for *_, c, own, vector in top:
            psi = np.zeros((n, 1))
            psi[own, 0] = vector
            out.at[place[c], "node_ids"], out.at[place[c], "psi"] = ids, signed(psi)[:, 0]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in laplacian.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    return laplacian.select(*by, "src", "dst", "v").groupBy(*by).applyInPandas(solve, f"{keys}, mode int, lambda double, n int, ipr double, pr double, node_ids array<bigint>, psi array<double>")


def moments(laplacian: DataFrame, most: int = 2, by: list[str] | None = None) -> DataFrame:
    """``network, m1, m2`` and, with ``most`` 3, ``m3``: sums of the eigenvalues' powers without eigenpairs.

    They are the traces of the matrix's powers: sums over the rows of a symmetric
    Laplacian, which has each entry once; for cubes over its triangles.
    """
    by = by or ["network"]
    if most not in (1, 2, 3):
        raise ValueError("most must be 1, 2 or 3")
    traces = [F.sum(F.when(F.col("src") == F.col("dst"), F.col("v")).otherwise(0.0)).alias("m1"), F.sum(F.col("v") * F.col("v")).alias("m2")]
    if most < 3:
        return laplacian.groupBy(*by).agg(*traces[:most])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ids, (rows, cols, values) = _entries(frame)
        n, order = len(ids), np.lexsort((cols, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        key, starts = rows * n + cols, np.searchsorted(rows, np.arange(n + 1))
        cube, step = 0.0, 1 << 16
        for s in range(0, len(rows), step):  # entry (i, j), each (j, k), and (k, i) where there is one
            i, j, v = rows[s : s + step], cols[s : s + step], values[s : s + step]
            size = starts[j + 1] - starts[j]
            at = np.repeat(starts[j] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            back = cols[at] * n + np.repeat(i, size)
            place = np.minimum(np.searchsorted(key, back), len(key) - 1)
            cube += float((np.repeat(v, size) * values[at] * np.where(key[place] == back, values[place], 0.0)).sum())
        return pd.DataFrame([(*[frame[c].iloc[0] for c in by], float(values[rows == cols].sum()), float((values * values).sum()), cube)], columns=[*by, "m1", "m2", "m3"])

    kinds = {f.name: f.dataType.simpleString() for f in laplacian.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    return laplacian.select(*by, "src", "dst", "v").groupBy(*by).applyInPandas(solve, f"{keys}, m1 double, m2 double, m3 double")


def coefficients(laplacian: DataFrame, values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, mode, lambda, c``: inner products of all modes with ``values(network, node_id, y)``.

    Vectors don't leave the task, and those of a network of over ``DENSE`` nodes
    are never held at once.
    """
    by = by or ["network"]

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "mode", "lambda", "c"]
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=columns)
        ids, entries = _entries(a)
        y = b.groupby("node_id").y.sum().reindex(ids).fillna(0.0).to_numpy()
        n = len(ids)
        if n > DENSE:
            found = [(v, x.T @ y[own]) for v, own, x in every_pair(*entries, n)]
        else:
            v, x = eigen(dense(a)[1])
            found = [(v, x.T @ y)]
        v, c = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(v, kind="stable")
        return pd.DataFrame({k: [a[k].iloc[0]] * n for k in by} | {"mode": np.arange(n), "lambda": v[order], "c": c[order]})

    kinds = {f.name: f.dataType.simpleString() for f in laplacian.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    own = values.select(*by, "node_id", F.col("y").cast("double").alias("y"))
    return laplacian.select(*by, "src", "dst", "v").groupBy(*by).cogroup(own.groupBy(*by)).applyInPandas(solve, f"{keys}, mode int, lambda double, c double")


def energies(laplacian: DataFrame, values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, e0, e1``: sums over all modes of squared ``coefficients``, and of those times eigenvalues, without eigenpairs.

    All modes of a symmetric matrix are an orthonormal basis of its nodes, so the
    sums are y'y and y'Ly over the matrix's nodes, each of which has a row.
    Nodes without a value count as 0, values without a node not at all.
    """
    by = by or ["network"]
    own = values.select(*by, "node_id", F.col("y").cast("double").alias("y")).groupBy(*by, "node_id").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"))
    turned = laplacian.join(own.withColumnRenamed("node_id", "dst"), [*by, "dst"], "left").groupBy(*by, "src").agg(F.sum(F.coalesce(F.col("v") * F.col("y"), F.lit(0.0))).alias("_t"))
    both = turned.join(own.withColumnRenamed("node_id", "src"), [*by, "src"], "left").groupBy(*by).agg(F.sum(F.coalesce(F.col("y") * F.col("y"), F.lit(0.0))).alias("e0"), F.sum(F.coalesce(F.col("y") * F.col("_t"), F.lit(0.0))).alias("e1"))
    return both.join(own.select(*by).distinct(), by, "left_semi")


def _entries(frame: pd.DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = np.unique(np.concatenate([frame.src.to_numpy(), frame.dst.to_numpy()]))
    return ids, (np.searchsorted(ids, frame.src), np.searchsorted(ids, frame.dst), frame.v.to_numpy(float))


def modes_long(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, mode, node_id, psi`` of a table of eigenpairs."""
    by = by or ["network"]
    return pairs.select(*by, "mode", F.explode(F.arrays_zip("node_ids", "psi")).alias("_z")).select(*by, "mode", F.col("_z.node_ids").alias("node_id"), F.col("_z.psi").alias("psi"))


def largest_first_singular(laplacian: DataFrame, n: int, k: int, which: str = "smallest") -> DataFrame:
    """``mode, lambda, node_id, psi`` of one large network by distributed singular values.

    The eigenvalues of a normalised Laplacian lie in [0, 2], so the smallest are
    the largest singular values of twice the identity less it, and the largest
    are its own. ``src`` and ``dst`` are row numbers from 0 to ``n - 1``. Only k
    columns, and k values, ever reach the driver. The network must be connected
    (``knn.connected`` tells): each part of a network that isn't adds an
    eigenvalue 0, and the iteration may find equal eigenvalues once only.
    """
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    if which not in ("smallest", "largest") or not 1 <= k < n:
        raise ValueError("which must be 'smallest' or 'largest', k from 1 to n - 1")
    spark = laplacian.sparkSession
    turned = laplacian.select("src", "dst", (-F.col("v") if which == "smallest" else F.col("v")).alias("v"))
    if which == "smallest":
        turned = turned.unionByName(spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(2.0).alias("v"))).groupBy("src", "dst").agg(F.sum("v").alias("v"))
    entries = turned.rdd.map(lambda r: MatrixEntry(r[0], r[1], r[2]))
    found = CoordinateMatrix(entries, n, n).toIndexedRowMatrix().computeSVD(k, computeU=True)
    sigma = found.s.toArray()
    order = np.arange(len(sigma)) if which == "smallest" else np.arange(len(sigma))[::-1]
    place = {int(c): i for i, c in enumerate(order)}
    values = [(place[c], float(2 - s if which == "smallest" else s), c) for c, s in enumerate(sigma)]
    names = spark.createDataFrame(values, "mode int, lambda double, _c int")
    rows = found.U.rows.map(lambda r: (r.index, r.vector.toArray().tolist())).toDF("node_id long, _u array<double>")
    long = rows.select("node_id", F.posexplode("_u").alias("_c", "psi"))
    return long.join(F.broadcast(names), "_c").select("mode", "lambda", "node_id", "psi")


def inverse_participation(psi: str = "psi") -> Column:
    """Of an array column: sum of fourth powers over the square of the sum of squares, 0 for a zero vector."""
    squares = F.aggregate(psi, F.lit(0.0), lambda s, x: s + x * x)
    fourths = F.aggregate(psi, F.lit(0.0), lambda s, x: s + x * x * x * x)
    return F.when(squares > 0, fourths / (squares * squares)).otherwise(0.0)


def ipr_long(modes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, mode, n, ipr, pr`` of a long table of modes; one aggregate with map-side sums."""
    by = by or ["network"]
    square = F.col("psi") * F.col("psi")
    sums = modes.groupBy(*by, "mode").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("_2"), F.sum(square * square).alias("_4"))
    ipr = F.when(F.col("_2") > 0, F.col("_4") / (F.col("_2") * F.col("_2"))).otherwise(0.0)
    return sums.select(*by, "mode", "n", ipr.alias("ipr"), participation(ipr, F.col("n")).alias("pr"))


def participation(ipr: Column, n: Column) -> Column:
    """Share of nodes that a mode takes part in."""
    return 1.0 / (n * ipr + 1e-30)


def spectrum(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, mode, lambda, n, ipr, pr`` of a table of eigenpairs, without a shuffle."""
    by = by or ["network"]
    ipr = inverse_participation("psi")
    return pairs.select(*by, "mode", "lambda", F.size("psi").alias("n"), ipr.alias("ipr"), participation(ipr, F.size("psi")).alias("pr"))


def level_spacing(values: DataFrame, by: list[str] | None = None, value: str = "lambda") -> DataFrame:
    """``network, position, r``: for neighbouring gaps of the sorted values the smaller over the larger."""
    by = by or ["network"]
    order = Window.partitionBy(*by).orderBy(value)
    gaps = values.select(*by, value, F.row_number().over(order).alias("position"), (F.lead(value).over(order) - F.col(value)).alias("_s"))
    after = Window.partitionBy(*by).orderBy("position")
    both = gaps.withColumn("_t", F.lead("_s").over(after)).where("_t is not null")
    return both.select(*by, "position", (F.least("_s", "_t") / (F.greatest("_s", "_t") + 1e-30)).alias("r"))
