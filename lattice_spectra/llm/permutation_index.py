"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, cut to a prefix.
Each block of rows posts its vectors in one inverted file for each pivot, with
the pivot's place in the vector's order. A query adds up, over the postings of
its own nearest pivots, what each shared pivot takes off the footrule distance
of two prefixes without a common pivot (a missing pivot counts as the place
after the prefix). The part of a block that is nearest by footrule, ties
included, is ranked again by the exact measure.

The measure is the inner product. Vectors get one more component that lifts
all to the largest norm, after which largest inner product and nearest are one
order; queries get a zero there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, search, usable


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the smaller number."""
    score = x @ pivots.T
    near = np.argpartition(-score, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    own = np.take_along_axis(score, near, 1)
    return np.take_along_axis(near, np.lexsort((near, -own), axis=1), 1)


def spread_out(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots from lifted vectors, each the farthest from those before; copies of one vector give one."""
    near, chosen = sample @ sample[0], [0]
    while len(chosen) < min(pivots, len(sample)):
        i = int(np.argmin(near))
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[chosen]


class PivotFiles:
    """One inverted file for each pivot over the rows of a block."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = by // self.prefix
        #: What a row's place takes off at most.
        self.worth = (self.prefix - by % self.prefix).astype(np.float64)
        self.starts = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.n = n
        self.room: tuple[np.ndarray, np.ndarray] | None = None

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """For each row, half of what it is nearer by footrule than a row without a shared pivot."""
        starts, ends = self.starts[order].tolist(), self.starts[order + 1].tolist()
        need = sum(ends) - sum(starts)
        if self.room is None or len(self.room[0]) < need:
            self.room = np.empty(2 * need, np.int64), np.empty(2 * need)
        rows, gain = self.room
        at = 0
        for place, (a, b) in enumerate(zip(starts, ends, strict=True)):
            to = at + b - a
            rows[at:to] = self.rows[a:b]
            np.minimum(self.worth[a:b], float(self.prefix - place), out=gain[at:to])
            at = to
        return np.bincount(rows[:at], gain[:at], self.n)


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added component by component, so that equal vectors get equal values anywhere."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[d]
    return total


class Index:
    """A block's distinct vectors, their ids, and the pivots' files."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, norm: float, prefix: int):
        by = np.argsort(ids, kind="stable")
        # equal vectors are one entry with its ids in order
        self.distinct, entry = np.unique(x[by], axis=0, return_inverse=True)
        entry = entry.ravel()
        members = np.argsort(entry, kind="stable")
        self.ids = ids[by][members]
        self.ends = np.searchsorted(entry[members], np.arange(len(self.distinct) + 1))
        self.files = PivotFiles(orders(_lifted(self.distinct, norm), pivots, prefix), len(pivots))

    def nearest(self, own: int, q: np.ndarray, order: np.ndarray, k: int, wanted: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the ``wanted`` entries that are nearest by footrule, with all that tie."""
        near = self.files.closeness(order)
        found = np.flatnonzero(near >= np.partition(near, len(near) - wanted)[len(near) - wanted])
        rough = self.distinct[found] @ q
        if len(found) > k + 1:  # the query itself may be one
            found = found[rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - margin]
        score = _products(self.distinct[found], q)
        n = np.minimum(self.ends[found + 1] - self.ends[found], k + 1)
        name = np.concatenate([self.ids[self.ends[f] : self.ends[f] + m] for f, m in zip(found, n, strict=True)])
        score = np.repeat(score, n)
        other = name != own
        name, score = name[other], score[other]
        keep = np.lexsort((name, -score))[:k]
        return name[keep], score[keep]


def _build(pivots: np.ndarray, norm: float, prefix: int):
    return lambda rows: Index(rows.id.to_numpy(), matrix(rows.vec, pivots.shape[1] - 1), pivots, norm, prefix)


def _probe(pivots: np.ndarray, norm: float, k: int, prefix: int, part: float, least: int):
    def probe(queries: pd.DataFrame, index: Index) -> tuple[list, np.ndarray, np.ndarray]:
        asked = matrix(queries.vec, pivots.shape[1] - 1)
        size = np.sqrt((asked * asked).sum(axis=1, keepdims=True))
        asked_orders = orders(np.column_stack([asked * (norm / size), np.zeros(len(asked))]), pivots, prefix)
        wanted = min(len(index.distinct), max(least, int(np.ceil(part * len(index.distinct)))))
        out_q, out_i, out_s = [], [], []
        for own, q, order in zip(queries.id, asked, asked_orders, strict=True):
            name, score = index.nearest(own, q, order, k, wanted, 1e-9 * norm * norm)
            out_q += [own] * len(name)
            out_i.append(name)
            out_s.append(score)
        return out_q, np.concatenate(out_i), np.concatenate(out_s)

    return probe


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 1024, prefix: int = 96, part: float = 0.12, least: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id long, rank int, vec_id long, score double``: each query's nearest found by inner product.

    ``is_query`` is a condition on ``id``. The index is fitted on a bounded sample,
    the 8 * ``pivots`` rows with the least hash of their id, of which it takes
    the most spread-out as pivots; every row is posted. ``part`` of each block's
    distinct vectors, ``least`` of them at least, is ranked again. Rows with a null id, a null or zero vector, or null
    or non-finite components take no part. Shorter vectors are filled with
    zeros. Equal vectors are one entry of the index; their ids rank by size.
    """
    rows = usable(vectors, id_column, vector).where(F.exists("vec", lambda x: x != 0))
    picked = [np.array(r["vec"]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(8 * pivots).select("vec").collect()]
    norm, width = rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))), F.max(F.size("vec"))).first()
    width = width or 1
    distinct = list({v.tobytes(): np.pad(v, (0, width - len(v))) for v in picked}.values()) or [np.ones(width)]
    centre = spread_out(_lifted(np.array(distinct), norm or 1.0), pivots)
    norm, prefix = norm or 1.0, min(prefix, len(centre))
    return search(rows, is_query, _build(centre, norm, prefix), _probe(centre, norm, k, prefix, part, least), k, "double")
