"""Exact top-k search by integer inner product, pruned a block at a time.

Components are quantised to integer term weights. Rows are put in an order that
keeps alike ones together and cut into ranges, the blocks; each keeps the
maximum and the minimum of every term (a negative query weight meets the
minimum) and a forward index, its rows' weights. For a query the blocks' bounds
are the sums over its terms; blocks are scored in order of falling bounds
through their forward indexes until the next bound is below the kth score. A
bound equal to it is still scored, as a smaller id may win the tie.

Tasks hold parts of the table, of alike rows and with an index made once. A
query meets the part that it belongs to first; the kth score found there is the
bar for all other parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import by_centre, matrix, search, usable

#: Rows of a document-range block, and blocks that are scored before the kth score is looked at again.
BLOCK = 32
STEP = 8


def _ordered(codes: np.ndarray) -> np.ndarray:
    """An order that puts rows near the same of some spread-out rows together."""
    rough = codes.astype(np.float64)
    picks = rough[np.linspace(0, len(codes) - 1, min(64, len(codes))).astype(int)]
    score = rough @ picks.T
    near = score.argmax(axis=1)
    return np.lexsort((-score[np.arange(len(codes)), near], near))


class Blocks:
    """Document-range blocks: extremes of every term, and forward indexes padded to whole blocks."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = _ordered(codes)
        codes, ids = codes[order], ids[order]
        starts = np.arange(0, len(codes), BLOCK)
        self.top, self.low = np.maximum.reduceat(codes, starts), np.minimum.reduceat(codes, starts)
        pad = -len(codes) % BLOCK
        self.forward = np.concatenate([codes, np.zeros((pad, codes.shape[1]), codes.dtype)]).reshape(len(starts), BLOCK, -1)
        self.names = np.concatenate([ids, np.zeros(pad, ids.dtype)]).reshape(len(starts), BLOCK)
        self.real = np.concatenate([np.ones(len(codes), bool), np.zeros(pad, bool)]).reshape(len(starts), BLOCK)
        self.most = max((abs(int(codes.max())), abs(int(codes.min())), 1) if codes.size else (1,))

    def typed(self, kind: type) -> None:
        self.top, self.low, self.forward = (x.astype(kind) for x in (self.top, self.low, self.forward))

    def widened(self, width: int) -> None:
        """Terms that only a query has weigh 0 here."""
        more = width - self.top.shape[1]
        if more > 0:
            self.top, self.low, self.forward = (np.concatenate([x, np.zeros((*x.shape[:-1], more), x.dtype)], axis=-1) for x in (self.top, self.low, self.forward))

    def top_k(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: list | None = None) -> tuple[list, list, list]:
        """Query ids, ids and scores of each query's k best rows, ties to smaller ids; none below a query's ``least``."""
        bounds = np.maximum(queries, 0) @ self.top.T + np.minimum(queries, 0) @ self.low.T
        whole_q, whole_i, whole_s = [], [], []
        for n, (q, own, bound) in enumerate(zip(queries, query_ids, bounds, strict=True)):
            by = np.argsort(-bound, kind="stable")
            falling = bound[by]
            bar = kth = None if least is None else least[n]
            best_s, best_i, at, step = np.zeros(0, np.int64), np.zeros(0, self.names.dtype), 0, STEP
            while at < len(by) and (kth is None or falling[at] >= kth):
                to = at + step
                if kth is not None:
                    to = min(to, at + int(np.count_nonzero(falling[at:] >= kth)))
                blocks = by[at:to]
                score, name = self.forward[blocks] @ q, self.names[blocks]
                good = self.real[blocks] & (name != own)
                if kth is not None:
                    good &= (score >= kth).astype(bool)
                best_s, best_i = np.concatenate([best_s, score[good].astype(np.int64)]), np.concatenate([best_i, name[good]])
                if len(best_s) >= k:
                    keep = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[keep], best_i[keep]
                    kth = int(best_s[-1]) if bar is None else max(bar, int(best_s[-1]))
                at, step = to, 2 * step
            keep = np.lexsort((best_i, -best_s))[:k]
            whole_q += [own] * len(keep)
            whole_i += best_i[keep].tolist()
            whole_s += best_s[keep].tolist()
        return whole_q, whole_i, whole_s


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers as they are if sums of them may be exact, else as Python's integers."""
    return x if np.abs(x).max(initial=0) < 2**53 else np.array([[int(v) for v in row] for row in x], object)


def _build(scale: float):
    def build(rows: pd.DataFrame) -> Blocks:
        return Blocks(_whole(np.floor(matrix(rows.vec, max(1, rows.vec.map(len).max())) * scale)), rows.id.to_numpy())

    return build


def _probe(k: int, scale: float):
    def probe(queries: pd.DataFrame, blocks: Blocks) -> tuple[list, list, list]:
        width = max(blocks.top.shape[1], queries.vec.map(len).max())
        asked = _whole(np.floor(matrix(queries.vec, width) * scale))
        blocks.widened(width)
        most = max(1, abs(int(asked.max())), abs(int(asked.min()))) * blocks.most * width
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object  # each holds these sums exactly
        if kind is object:
            asked = np.array([[int(v) for v in row] for row in asked], object)
            blocks.forward, blocks.top, blocks.low = (np.vectorize(int, otypes=[object])(x) for x in (blocks.forward, blocks.top, blocks.low))
        else:
            blocks.typed(kind)
            asked = asked.astype(kind)
        least = [None if pd.isna(v) else int(v) for v in queries.least]
        return blocks.top_k(asked, queries.id.to_numpy(), k, least)

    return probe


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id long, rank int, vec_id long, score long``: each query's k largest integer inner products.

    ``is_query`` is a condition on ``id``. Components become floor(scale * x).
    Rows with a null id, a null vector, or null or non-finite components take no
    part. Sums are exact whatever their size; one that doesn't fit a long raises
    OverflowError. Terms that a shorter vector lacks have weight 0. Rows that
    share the query's id aren't its candidates; repeated rows are candidates each.
    """
    rows = usable(vectors, id_column, vector)
    return search(rows, is_query, _build(scale), _probe(k, scale), k, "long", by_centre, home_first=True)
