"""Exact k-nearest-neighbour graphs.

Four physical ways give the same edges: a tree of boxes in one task for each
network, where it fits one, a join over grid cells for larger ones, which widens
the search only for nodes whose k-th neighbour may lie outside it, products of a
network's blocks, and a plain join of each network with itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_M, euclidean, haversine, haversine_radians, rbf
from ..functions.scratch import cut

#: Nodes of the largest network up to which a network's neighbours are found in one task.
WITHIN = 1_000_000
#: Parts of a network's nodes, on either side, where all pairs are asked for.
PARTS = 16
#: Nodes of a box of the tree.
LEAF = 64
#: Known nodes of the largest network up to which all new ones meet all known ones.
BETWEEN = 500
#: Nodes that one task holds of each side.
BLOCK = 1_000
#: Nodes for each neighbour wanted up to which a cell isn't crowded.
CROWD = 32
#: Neighbours that a block's product passes on beyond k, as the last digits of distances are taken from the join's own formula.
SPARE = 8


def _neighbours(pairs: DataFrame, k: int, by: list[str]) -> DataFrame:
    """First k of each node by distance, ties to the smaller id; Spark cuts before the shuffle as well."""
    order = Window.partitionBy(*by, "src").orderBy("d", "dst")
    return pairs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select(*by, "src", "dst", "d", "rk")


def _sides(nodes: DataFrame, by: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    left = nodes.select(*by, F.col("node_id").alias("src"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = nodes.select(*by, F.col("node_id").alias("dst"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return left, right


def pairs_geographic(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distances in metres between all nodes of each network, from each to each other."""
    by = by or ["network"]
    turned = nodes.select(*by, "node_id", F.radians("lat").alias("lat"), F.radians("lng").alias("lng"))
    left, right = _sides(turned.withColumn("cos", F.cos("lat")), by, ["lat", "lng", "cos"])
    # both sides are dealt into parts, and each part meets all of the other side's: tasks are even, and a stretch of rows has few nodes, which takes fewer bytes in columnar files
    part, every = (lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    keys, n = [*by, "_part", "_other"], 4 * nodes.sparkSession.sparkContext.defaultParallelism
    left = left.withColumn("_part", part("src")).withColumn("_other", every).repartition(n, *keys)
    right = right.withColumn("_part", every).withColumn("_other", part("dst")).repartition(n, *keys)
    d = haversine_radians(F.col("lat_a"), F.col("lng_a"), F.col("cos_a"), F.col("lat_b"), F.col("lng_b"), F.col("cos_b"))
    return left.join(right.hint("merge"), keys).where("src <> dst").select(*by, "src", "dst", d.alias("d"))


def _grid(nodes: DataFrame, k: int, by: list[str], seekers: DataFrame | None = None) -> DataFrame:
    """The nearest of ``nodes`` to each of them, or to each of ``seekers``, of which none is left out as itself.

    Cells are cubes around points of the unit sphere, where chords grow with distances, so neither poles nor the 180th meridian are edges.

    The first side is that of some 2k nodes a cell if they were spread evenly
    over an area, or along a line, and smaller where a cell would be crowded:
    nodes of dense places are settled by small cells, others by later, wider ones.
    """
    axes = ["_x", "_y", "_z"]
    lat, lng = F.radians("lat"), F.radians("lng")
    place = lambda df: df.select(*by, "node_id", "lat", "lng", (F.cos(lat) * F.cos(lng)).alias("_x"), (F.cos(lat) * F.sin(lng)).alias("_y"), F.sin(lat).alias("_z"))
    placed = place(nodes)
    box = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[(F.max(c) - F.min(c)).alias(f"{c}w") for c in axes])
    faces = [F.pow(F.col(f"{a}w") * F.col(f"{b}w"), 2) for a, b in (("_x", "_y"), ("_y", "_z"), ("_x", "_z"))]
    area = F.sqrt(faces[0] + faces[1] + faces[2])
    longest = F.greatest(*[F.col(f"{c}w") for c in axes])
    box = box.withColumn("_side", F.greatest(F.sqrt(area * (2 * k) / F.col("_n")), longest * (2 * k) / F.col("_n"), F.lit(1.0 / EARTH_RADIUS_M))).select(*by, "_n", "_side")
    open_nodes, done, factor = nodes if seekers is None else seekers, [], 1.0
    small = F.broadcast(box) if nodes.select(*by).distinct().count() < 10_000 else box
    full = placed.join(small, by)
    asking = full if seekers is None else place(seekers).join(small, by)
    others = (lambda df: df.where("src <> dst")) if seekers is None else (lambda df: df)
    cells = [f"{c}c" for c in axes]
    while factor > 2.0**-20:
        crowd = full.groupBy(*by, *[F.floor(F.col(a) / (F.col("_side") * factor)).alias(c) for a, c in zip(axes, cells, strict=True)]).count().agg(F.max("count")).first()[0]
        if (crowd or 0) <= CROWD * k:
            break
        factor /= 4
    while True:
        side = F.col("_side") * factor
        celled = lambda df: df.select("*", *[F.floor(F.col(a) / side).alias(c) for a, c in zip(axes, cells, strict=True)])  # noqa: B023, E731
        right = celled(full).select(*by, *cells, F.col("node_id").alias("dst"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
        asked = celled(asking)
        asked = asked.join(open_nodes.select(*by, "node_id"), [*by, "node_id"], "left_semi") if done else asked
        for c in cells:
            asked = asked.withColumn(f"{c}d", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])))
        left = asked.select(*by, *[(F.col(c) + F.col(f"{c}d")).alias(c) for c in cells], F.col("node_id").alias("src"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), side.alias("_reach"), F.least(F.lit(k), F.col("_n") - (1 if seekers is None else 0)).alias("_k"))
        # all whose chord is under a cell's side was seen
        pairs = others(left.join(right, [*by, *cells])).withColumn("d", haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")))
        order = Window.partitionBy(*by, "src").orderBy("d", "dst")
        found = cut(pairs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= F.col("_k")).select(*by, "src", "dst", "d", "rk", "_reach", "_k"))
        sure = found.where((F.col("rk") == F.col("_k")) & (2 * F.sin(F.col("d") / (2 * EARTH_RADIUS_M)) <= F.col("_reach") * 0.999)).select(*by, "src")
        done.append(found.join(sure, [*by, "src"], "left_semi").select(*by, "src", "dst", "d", "rk"))
        open_nodes = cut(open_nodes.join(sure.withColumnRenamed("src", "node_id"), [*by, "node_id"], "left_anti"))
        left_over = open_nodes.count()
        if left_over == 0:
            break
        if left_over <= 64 or factor > 512:
            a, b = open_nodes.select(*by, F.col("node_id").alias("src"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a")), _sides(nodes, by, ["lat", "lng"])[1]
            rest = others(a.join(b, by)).select(*by, "src", "dst", haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")).alias("d"))
            done.append(_neighbours(rest, k, by))
            break
        factor *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in an order of boxes of ``LEAF`` at most, halved along their longest side, and where each box starts."""
    order, starts = np.arange(len(x)), []
    open_boxes = [(0, len(x))]
    while open_boxes:
        a, b = open_boxes.pop()
        if b - a <= LEAF:
            starts.append(a)
            continue
        own = x[order[a:b]]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)]
        open_boxes += [(a, a + half), (a + half, b)]
    return order, np.sort(np.array(starts, int))


def nearest_places(x: np.ndarray, own: np.ndarray, y: np.ndarray, other: np.ndarray, m: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers ``(i, j)`` of each of ``x`` and its m nearest of ``y``, ties to the smaller of the ids ``other``; with ``same`` those of its own id aren't counted.

    The points of a box of ``x`` meet those boxes of ``y`` only that may hold one
    as near as the farthest of what their nearest boxes gave.
    """
    m = min(m, len(y) - same)
    if m < 1 or not len(x):
        return np.zeros(0, int), np.zeros(0, int)
    (a_order, a), (b_order, b) = _boxes(x), _boxes(y)
    y, other = y[b_order], other[b_order]
    low, high, size = np.minimum.reduceat(y, b), np.maximum.reduceat(y, b), np.diff(np.r_[b, len(y)])
    rows, cols = [], []
    for mine in np.split(a_order, a[1:]):
        q = x[mine]
        away = (np.maximum(0, np.maximum(low - q.max(axis=0), q.min(axis=0) - high)) ** 2).sum(axis=1)

        def squares(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.repeat(b[boxes] - np.r_[0, np.cumsum(size[boxes])[:-1]], size[boxes]) + np.arange(size[boxes].sum())
            d = sum((q[:, c, None] - y[at, c]) ** 2 for c in range(y.shape[1]))  # noqa: B023
            if same:
                d[own[mine, None] == other[at]] = np.inf  # noqa: B023
            return at, d

        first = np.argsort(away, kind="stable")
        first = first[: np.searchsorted(np.cumsum(size[first]), m + same) + 1]
        reach = np.partition(squares(first)[1], m - 1, axis=1)[:, m - 1].max()
        at, d = squares(np.flatnonzero(away <= reach * (1 + 1e-9) + 1e-30))
        cut = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
        i, j = np.nonzero((d <= cut * (1 + 1e-9) + 1e-30) & np.isfinite(d))
        order = np.lexsort((other[at[j]], d[i, j], i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < m
        rows.append(mine[i[keep]])
        cols.append(b_order[at[j[keep]]])
    return np.concatenate(rows), np.concatenate(cols)


def _within(test: DataFrame, train: DataFrame, k: int, by: list[str], same: bool) -> DataFrame:
    """The k nearest of ``train`` to each of ``test``, with a network's nodes in one task."""
    own = ["node_id", "lat", "lng"]
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in [*by, "node_id"]], *[F.col(c).cast("double").alias(f"{s}_{c}") for c in own[1:]])
    kinds = {f.name: f.dataType.simpleString() for f in train.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"src {kinds['node_id']}, dst {kinds['node_id']}, lat_a double, lng_a double, lat_b double, lng_b double"])

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=[*by, "src", "dst", "lat_a", "lng_a", "lat_b", "lng_b"])
        (u, lat_a, lng_a), (v, lat_b, lng_b) = ([f[f"{s}_{c}"].to_numpy() for c in own] for f, s in ((a, "a"), (b, "b")))
        i, j = nearest_places(_sphere(lat_a, lng_a), u, _sphere(lat_b, lng_b), v, k + SPARE, same)
        return pd.DataFrame({c: a[f"a_{c}"].iloc[:1].repeat(len(i)).to_numpy() for c in by} | {"src": u[i], "dst": v[j], "lat_a": lat_a[i], "lng_a": lng_a[i], "lat_b": lat_b[j], "lng_b": lng_b[j]})

    if same:
        found = side(train, "a").groupBy(*[f"a_{c}" for c in by]).applyInPandas(lambda f: solve(f, f.rename(columns=lambda c: f"b{c[1:]}")), schema)
    else:
        found = side(test, "a").groupBy(*[f"a_{c}" for c in by]).cogroup(side(train, "b").groupBy(*[f"b_{c}" for c in by])).applyInPandas(solve, schema)
    d = haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    return _neighbours(found.select(*by, "src", "dst", d.alias("d")), k, by)


def _sphere(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lng)
    return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def knn_geographic(nodes: DataFrame, k: int = 10, by: list[str] | None = None, method: str = "auto") -> DataFrame:
    """``network, src, dst, d, rk``: the k nearest by great-circle distance (all others, if fewer).

    ``method`` is ``pairwise``, ``blocks``, ``grid``, ``within`` or ``auto``: the
    grid if the largest network has over ``WITHIN`` nodes, else within one task
    for each network. All give the same edges.
    """
    by = by or ["network"]
    if method not in ("auto", "pairwise", "blocks", "grid", "within"):
        raise ValueError(f"method must be 'auto', 'pairwise', 'blocks', 'grid' or 'within', not {method!r}")
    if method == "pairwise":
        return _neighbours(pairs_geographic(nodes, by), k, by)
    largest = _largest(nodes, by) if method in ("auto", "blocks") else 0
    if method == "within" or method == "auto" and largest <= WITHIN:
        return _within(nodes, nodes, k, by, True)
    if method in ("auto", "grid"):
        return _grid(nodes, k, by)
    lat, lng = F.radians("lat"), F.radians("lng")
    vec = F.array(F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))
    near = _block_products(nodes.select(*by, "node_id", vec.alias("vec"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")), k, by, largest, ["lat", "lng"], SPARE)
    d = haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    return _neighbours(near.select(*by, "src", "dst", d.alias("d")), k, by)


def _largest(nodes: DataFrame, by: list[str]) -> int:
    return nodes.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def knn_feature(nodes: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """``network, src, dst, d, rk``: the k nearest by Euclidean distance of ``vec``."""
    by = by or ["network"]
    return _neighbours(_block_products(nodes.select(*by, "node_id", "vec"), k, by, _largest(nodes, by)), k, by)


def _block_products(nodes: DataFrame, k: int, by: list[str], largest: int, carried: list[str] | None = None, spare: int = 0) -> DataFrame:
    """``src, dst, d`` and both sides' ``carried`` columns (``_a``, ``_b``) of what may be the k nearest by ``vec``.

    Nodes are dealt into blocks of some ``BLOCK``; each pair of a network's
    blocks is one task's matrix product, which bounds its memory, and passes on
    ``k + spare`` rows for each node at most. The product, of vectors less their
    block's mean, only selects: distances of what it may select are taken from
    differences.
    """
    carried = carried or []
    n = max(1, -(-largest // BLOCK))
    block = lambda: F.pmod(F.xxhash64("node_id"), F.lit(n)).cast("int")
    every = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = ["node_id", "vec", *carried]
    left = nodes.select(*[F.col(c).alias(f"a_{c}") for c in [*by, *own]], block().alias("a_i"), every().alias("a_j"))
    right = nodes.select(*[F.col(c).alias(f"b_{c}") for c in [*by, *own]], every().alias("b_i"), block().alias("b_j"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"src {kinds['node_id']}, dst {kinds['node_id']}, d double", *[f"{c}_{side} {kinds[c]}" for side in "ab" for c in carried]])

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows: list[np.ndarray] = []
        cols: list[np.ndarray] = []
        dist: list[np.ndarray] = []
        if len(a) and len(b):
            x, y = np.stack(a.a_vec.to_numpy()).astype(float), np.stack(b.b_vec.to_numpy()).astype(float)
            mean = y.mean(axis=0)
            plain, against = x, y
            x, y = x - mean, y - mean
            own, other = a.a_node_id.to_numpy(), b.b_node_id.to_numpy()
            square = (y * y).sum(axis=1)
            scale = max(float((x * x).sum(axis=1).max()), float(square.max()), 1e-300)
            for s in range(0, len(x), 256):
                part = x[s : s + 256]
                rough = (part * part).sum(axis=1)[:, None] - 2 * (part @ y.T) + square
                rough[own[s : s + 256, None] == other] = np.inf
                m = min(k + spare, len(y)) - 1
                cut = np.partition(rough, m, axis=1)[:, m : m + 1]
                i, j = np.nonzero((rough <= cut + 1e-12 * scale) & np.isfinite(rough))
                d = np.sqrt(((plain[s + i] - against[j]) ** 2).sum(axis=1))
                order = np.lexsort((other[j], d, i))
                i, j, d = i[order], j[order], d[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k + spare
                rows.append(s + i[keep])
                cols.append(j[keep])
                dist.append(d[keep])
        i, j = (np.concatenate(v).astype(int) if v else np.zeros(0, int) for v in (rows, cols))
        found = {c: a[f"a_{c}"].iloc[:1].repeat(len(i)).to_numpy() for c in by}
        found |= {"src": a.a_node_id.to_numpy()[i], "dst": b.b_node_id.to_numpy()[j], "d": np.concatenate(dist) if dist else np.zeros(0)}
        found |= {f"{c}_a": a[f"a_{c}"].to_numpy()[i] for c in carried} | {f"{c}_b": b[f"b_{c}"].to_numpy()[j] for c in carried}
        return pd.DataFrame(found)

    return left.groupBy(*[f"a_{c}" for c in by], "a_i", "a_j").cogroup(right.groupBy(*[f"b_{c}" for c in by], "b_i", "b_j")).applyInPandas(nearest, schema)


def knn_between(test: DataFrame, train: DataFrame, k: int, kind: str = "geographic", by: list[str] | None = None) -> DataFrame:
    """``network, src, dst, d, rk``: the k nearest training nodes of each test node; none is left out as itself.

    Geographic networks of over ``BETWEEN`` training nodes don't meet whole: a
    network's nodes are in one task, or, if over ``WITHIN``, go through the grid.
    """
    by = by or ["network"]
    largest = _largest(train, by) if check_kind(kind) == "geographic" else 0
    if largest > BETWEEN:
        return _grid(train, k, by, test) if max(largest, _largest(test, by)) > WITHIN else _within(test, train, k, by, False)
    columns = ["lat", "lng"] if check_kind(kind) == "geographic" else ["vec"]
    left, right = _sides(test, by, columns)[0], _sides(train, by, columns)[1]
    d = haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")) if kind == "geographic" else euclidean(F.col("vec_a"), F.col("vec_b"))
    return _neighbours(left.join(right, by).select(*by, "src", "dst", d.alias("d")), k, by)


def check_kind(kind: str) -> str:
    """``geographic`` or ``feature``; else ValueError."""
    if kind not in ("geographic", "feature"):
        raise ValueError(f"graph type must be 'geographic' or 'feature', not {kind!r}")
    return kind


def sigma_auto(knn: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, sigma``: exact median distance of the last neighbour of each node."""
    by = by or ["network"]
    last = Window.partitionBy(*by, "src")
    return knn.withColumn("_last", F.max("rk").over(last)).where("rk = _last").groupBy(*by).agg(F.median("d").alias("sigma"))


def adjacency(knn: DataFrame, sigma: float | str | None = "auto", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(W, sigmas)``: symmetric weights ``network, src, dst, w`` and the width used.

    A pair's weight is the mean of its two directions, so an edge that only one
    end has counts half. A width of 0 or less is an error, also one found.
    """
    by = by or ["network"]
    knn = cut(knn)  # widths and both directions read it
    if sigma is None or sigma == "auto":
        widths = sigma_auto(knn, by)
    else:
        if sigma <= 0:
            raise ValueError("sigma must be positive")
        widths = knn.select(*by).distinct().withColumn("sigma", F.lit(float(sigma)))
    checked = widths.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.raise_error(F.lit("sigma must be positive")).cast("double")))
    edges = knn.join(checked, by).select(*by, "src", "dst", rbf(F.col("d"), F.col("sigma")).alias("w"))
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return cut(edges.unionByName(back).groupBy(*by, "src", "dst").agg((0.5 * F.sum("w")).alias("w"))), cut(checked)


def build_graph(nodes: DataFrame, kind: str = "geographic", k: int = 10, sigma: float | str | None = "auto", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights and widths of the graph of either kind. Networks need two nodes at least."""
    check_kind(kind)
    knn = knn_geographic(nodes, k, by) if kind == "geographic" else knn_feature(nodes, k, by)
    return adjacency(knn, sigma, by)


def node_count(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, n``."""
    return nodes.groupBy(*(by or ["network"])).agg(F.count(F.lit(1)).alias("n"))


def connected(w: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, node_id, part``: connected parts of each network, named by their least node.

    Least labels of neighbours and then of labels, until none changes; a
    network has as many eigenvalues 0 as parts.
    """
    by = by or ["network"]
    labels = cut(w.groupBy(*by, F.col("src").alias("node_id")).agg(F.least(F.min("dst"), F.first("src")).alias("part")))
    while True:
        near = w.join(labels.withColumnRenamed("node_id", "dst"), [*by, "dst"]).groupBy(*by, F.col("src").alias("node_id")).agg(F.min("part").alias("_near"))
        step = labels.join(near, [*by, "node_id"]).select(*by, "node_id", F.col("part").alias("_was"), F.least("part", "_near").alias("_to"))
        jump = labels.select(*by, F.col("node_id").alias("_to"), F.col("part").alias("_beyond"))
        moved = cut(step.join(jump, [*by, "_to"]).select(*by, "node_id", "_was", F.least("_to", "_beyond").alias("part")))
        labels = moved.drop("_was")
        if moved.where("part <> _was").isEmpty():
            return labels
