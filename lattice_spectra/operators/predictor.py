"""Regression on features with appended spectral modes: an ML estimator, and cross-validation of it against the plain features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rbf, scaled
from ..functions.scratch import cut
from . import bound, knn, laplacian, spectrum

PROTOCOLS = ("transductive", "inductive")


def default_estimator(seed: int = 42) -> GBTRegressor:
    """Boosted trees."""
    return GBTRegressor(maxIter=200, stepSize=0.05, maxDepth=3, seed=seed, featuresCol="features", labelCol="y", predictionCol="yhat")


def ridge(alpha: float, n: int, deviation: float) -> LinearRegression:
    """Ridge regression with penalty ``alpha`` on n rows whose target has this population deviation."""
    return LinearRegression(featuresCol="features", labelCol="y", predictionCol="yhat", elasticNetParam=0.0, regParam=alpha * deviation / n, standardization=False, solver="normal")


def ridge_fit(rows: DataFrame, features: Sequence[str], alpha: float = 1.0, by: Sequence[str] = ("network",)) -> DataFrame:
    """``network, intercept, coefficients`` of ridge regression in closed form from one aggregate of sums.

    For every group at once: sums of products are taken JVM-side with map-side
    partial sums; only a small system for each group is solved in Python.
    """
    f = list(features)
    sums = [F.count(F.lit(1)).cast("double").alias("_n"), F.sum("y").alias("_y"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(f)], *[F.sum(F.col(c) * F.col("y")).alias(f"_t{i}") for i, c in enumerate(f)], *[F.sum(F.col(a) * F.col(b)).alias(f"_p{i}_{j}") for i, a in enumerate(f) for j, b in enumerate(f) if j >= i]]
    own = rows.na.drop(subset=[*f, "y"]).groupBy(*by).agg(*sums)
    keys = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in own.select(*by).schema)

    def solve(batches):
        for frame in batches:
            out = []
            for r in frame.to_dict("records"):
                n, p = r["_n"], len(f)
                s = np.array([r[f"_s{i}"] for i in range(p)])
                m = np.array([[r[f"_p{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - np.outer(s, s) / n
                t = np.array([r[f"_t{i}"] for i in range(p)]) - s * r["_y"] / n
                w = np.linalg.solve(m + alpha * np.eye(p), t)
                out.append((*[r[c] for c in by], float((r["_y"] - s @ w) / n), w.tolist()))
            yield pd.DataFrame(out, columns=[*by, "intercept", "coefficients"])

    return own.mapInPandas(solve, f"{keys}, intercept double, coefficients array<double>")


def ridge_predict(rows: DataFrame, fitted: DataFrame, features: Sequence[str], by: Sequence[str] = ("network",)) -> DataFrame:
    """``rows`` with ``yhat``."""
    dot = F.aggregate(F.zip_with(F.array(*[F.col(c) for c in features]), F.col("coefficients"), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return rows.join(fitted, list(by)).withColumn("yhat", F.col("intercept") + dot).drop("intercept", "coefficients")


def ridge_solver(alpha: float = 1.0) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """An estimator function for ``cross_validate``: ridge regression in a task of its own for each network and fold."""

    def solve(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=0)
        w = np.linalg.solve((x - mean).T @ (x - mean) + alpha * np.eye(x.shape[1]), (x - mean).T @ (y - y.mean()))
        return y.mean() + (new - mean) @ w

    return solve


def predicted_by(rows: DataFrame, columns: Sequence[str], estimate: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], by: Sequence[str]) -> DataFrame:
    """Test rows with ``yhat`` from ``estimate(x_train, y_train, x_test)``, called in a task for each group.

    ``rows`` has ``is_test``; training rows with a null don't count. A group
    without training rows gives null predictions.
    """
    own = rows.select(*by, "node_id", "is_test", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    wide = [f"_x{i}" for i in range(len(columns))]

    def call(frame: pd.DataFrame) -> pd.DataFrame:
        test, train = frame[frame.is_test], frame[~frame.is_test].dropna(subset=[*wide, "y"])
        yhat = estimate(train[wide].to_numpy(float), train.y.to_numpy(float), test[wide].to_numpy(float)) if len(train) and len(test) else np.full(len(test), np.nan)
        return test[[*by, "node_id", "y"]].assign(yhat=np.asarray(yhat, float))

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*by, "node_id").schema)
    return own.groupBy(*by).applyInPandas(call, f"{keys}, y double, yhat double")


def kfold(nodes: DataFrame, n_folds: int = 5, seed: int = 42, by: Sequence[str] = ("network",)) -> DataFrame:
    """``nodes`` with ``fold``: shuffled by a hash of id and seed, cut into runs of which the first are one longer."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id")
    return nodes.withColumn("fold", F.ntile(n_folds).over(order) - 1)


def kfold_parity(n: int, n_folds: int = 5, seed: int = 42) -> np.ndarray:
    """Fold of each row number, as a shuffled split with numpy's legacy generator gives it."""
    index = np.arange(n)
    np.random.RandomState(seed).shuffle(index)
    sizes = np.full(n_folds, n // n_folds)
    sizes[: n % n_folds] += 1
    out = np.empty(n, int)
    out[index] = np.repeat(np.arange(n_folds), sizes)
    return out


def r2_score(scored: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """``by, r2``: one less the residual over the total sum of squares around the rows' own mean."""
    total = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(F.lit(1))
    return scored.groupBy(*by).agg((1 - F.sum((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat))) / total).alias("r2"))


def scored_by(scored: DataFrame, scoring: Callable[[np.ndarray, np.ndarray], float], by: Sequence[str]) -> DataFrame:
    """``by, r2`` with any ``scoring(y, yhat)``, one call for each group."""
    own = scored.select(*by, "y", "yhat")
    keys = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in own.select(*by).schema)

    def call(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*[frame[c].iloc[0] for c in by], float(scoring(frame.y.to_numpy(), frame.yhat.to_numpy())))], columns=[*by, "r2"])

    return own.groupBy(*by).applyInPandas(call, f"{keys}, r2 double")


def nystrom_extend(modes: DataFrame, near: DataFrame, sigma: DataFrame, by: Sequence[str] = ("network",)) -> DataFrame:
    """``network, mode, node_id, psi`` of new nodes: weighted means over their nearest known ones.

    ``near`` has ``src`` (new), ``dst`` (known) and ``d``. Weights that sum to
    1e-12 or less count as a sum of 1, so that a node far from all gets nearly 0.
    """
    weighed = near.join(sigma, list(by)).select(*by, "src", "dst", rbf(F.col("d"), F.col("sigma")).alias("_w"))
    joined = weighed.join(modes.withColumnRenamed("node_id", "dst"), [*by, "dst"])
    total = F.sum("_w")
    return joined.groupBy(*by, "mode", "src").agg((F.sum(F.col("_w") * F.col("psi")) / F.when(total <= 1e-12, 1.0).otherwise(total)).alias("psi")).withColumnRenamed("src", "node_id")


def _first_modes(nodes: DataFrame, k: int, k_nn: int, sigma, graph_type: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    weights, widths = knn.build_graph(nodes, graph_type, k_nn, sigma, by)
    pairs = spectrum.spectral_decomposition(laplacian.symmetric_normalised(weights, nodes.select(*by, "node_id"), by), k, by=by, clip=True)
    return spectrum.modes_long(pairs.where(F.col("mode") < k), by), widths


def _with_modes(nodes: DataFrame, modes: DataFrame, k: int, by: list[str]) -> DataFrame:
    wide = modes.groupBy(*by, "node_id").pivot("mode", list(range(k))).agg(F.first("psi"))
    for i in range(k):
        wide = wide.withColumnRenamed(str(i), f"mode_{i}")
    return nodes.join(wide, [*by, "node_id"]).na.fill(0.0, [f"mode_{i}" for i in range(k)])


def augmented_folds(nodes: DataFrame, k: int = 16, k_nn: int = 6, sigma: float | str | None = "auto", graph_type: str = "geographic", standardise: bool = True, protocol: str = "transductive") -> DataFrame:
    """Nodes once for each fold that they are trained or tested in, with ``is_test`` and columns ``mode_i``.

    ``nodes`` has ``fold``. Transductive modes come from all nodes and don't
    depend on the fold, so they are found once. Inductive ones come from each
    fold's training nodes, a key of the plan, and are carried over to its test
    nodes; their scale is the training nodes'.
    """
    if protocol not in PROTOCOLS:
        raise ValueError(f"protocol must be one of {PROTOCOLS}")
    folds = nodes.select("network", F.col("fold").alias("_f")).distinct()
    repeated = lambda df: df.join(folds, "network").withColumn("is_test", F.col("fold") == F.col("_f")).drop("fold").withColumnRenamed("_f", "fold")
    if protocol == "transductive":
        modes, _ = _first_modes(nodes.drop("fold"), k, k_nn, sigma, graph_type, ["network"])
        if standardise:
            modes = modes.withColumn("psi", scaled("psi", ["network", "mode"]))
        return repeated(cut(_with_modes(nodes, modes, k, ["network"])))  # a node's row is kept once, not for each fold
    by = ["network", "fold"]
    each = cut(repeated(nodes))  # graphs, modes, neighbours and rows read it
    train, test = each.where("not is_test"), each.where("is_test")
    modes, widths = _first_modes(train, k, k_nn, sigma, graph_type, by)
    if standardise:
        modes = modes.withColumn("psi", scaled("psi", [*by, "mode"]))
    modes = cut(modes)
    near = cut(knn.knn_between(test, train, k_nn, graph_type, by))
    return cut(_with_modes(each, modes.unionByName(nystrom_extend(modes, near, widths, by)), k, by))


def cross_validate(nodes: DataFrame, features: Sequence[str], k: int = 16, n_folds: int = 5, seed: int = 42, alpha: float | None = 1.0, estimator=None, scoring: Callable | None = None, protocol: str = "transductive", k_nn: int = 6, sigma: float | str | None = "auto", graph_type: str = "geographic", standardise: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(scores, predictions)``: ``network, fold, baseline, augmented`` and ``network, fold, node_id, y, yhat_base, yhat_aug``.

    Without an ``estimator`` ridge regression of penalty ``alpha`` is solved for
    all networks and folds in one plan. A function ``estimator(x_train, y_train,
    x_test)`` runs in a task for each network and fold, so any number of them
    runs at once. An ML estimator is itself distributed and fitted once for each
    network and fold, one after the other: use it for few large networks.
    ``scoring(y, yhat)`` replaces r2.
    """
    by = ["network", "fold"]
    folded = cut(nodes if "fold" in nodes.columns else kfold(nodes, n_folds, seed))
    rows = augmented_folds(folded, k, k_nn, sigma, graph_type, standardise, protocol)
    modes = [f"mode_{i}" for i in range(k)]
    wide = [*features, *modes]

    def predicted(columns: Sequence[str], name: str) -> DataFrame:
        train, test = rows.where("not is_test"), rows.where("is_test")
        if estimator is None:
            return ridge_predict(test, ridge_fit(train, columns, alpha, by), columns, by).select(*by, "node_id", "y", F.col("yhat").alias(name))
        if not hasattr(estimator, "fit"):
            return predicted_by(rows, columns, estimator, by).select(*by, "node_id", "y", F.col("yhat").alias(name))
        whole = None
        assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
        for r in rows.select(*by).distinct().collect():  # one model each; as many as networks times folds
            mine = lambda df, r=r: assembler.transform(df.where((F.col("network") == r[0]) & (F.col("fold") == r[1])))
            part = estimator.copy().fit(mine(train)).transform(mine(test)).select(*by, "node_id", "y", F.col(estimator.getPredictionCol()).alias(name))
            whole = part if whole is None else whole.unionByName(part)
        return whole

    both = predicted(features, "yhat_base").join(predicted(wide, "yhat_aug").drop("y"), [*by, "node_id"]).persist()
    score = (lambda c: r2_score(both, by, "y", c)) if scoring is None else (lambda c: scored_by(both.withColumn("yhat", F.col(c)), scoring, by))
    scores = score("yhat_base").withColumnRenamed("r2", "baseline").join(score("yhat_aug").withColumnRenamed("r2", "augmented"), by)
    return scores, both


def cv_summary(scores: DataFrame) -> DataFrame:
    """``network, baseline_mean, augmented_mean, gain_mean, n_folds``."""
    return scores.groupBy("network").agg(F.avg("baseline").alias("baseline_mean"), F.avg("augmented").alias("augmented_mean"), F.avg(F.col("augmented") - F.col("baseline")).alias("gain_mean"), F.count(F.lit(1)).cast("int").alias("n_folds"))


class SpectralRegressor:
    """Estimator on one network: modes from all rows, the model from training rows, predictions for fitted rows."""

    def __init__(self, estimator=None, k: int = 16, k_nn: int = 6, sigma: float | str | None = "auto", graph_type: str = "geographic", standardise: bool = True):
        knn.check_kind(graph_type)
        self.estimator, self.k, self.k_nn, self.sigma, self.graph_type, self.standardise = estimator, k, k_nn, sigma, graph_type, standardise
        self.model = None

    def copy(self) -> SpectralRegressor:
        """An unfitted one with the same settings."""
        own = self.estimator.copy() if self.estimator is not None else None
        return SpectralRegressor(own, self.k, self.k_nn, self.sigma, self.graph_type, self.standardise)

    def fit(self, nodes: DataFrame, features: Sequence[str], train_column: str | None = None) -> SpectralRegressor:
        """Fits on rows whose ``train_column`` is true, or all."""
        weights, _ = knn.build_graph(nodes, self.graph_type, self.k_nn, self.sigma)
        self.pairs = spectrum.spectral_decomposition(laplacian.symmetric_normalised(weights, nodes), self.k, clip=True).persist()
        modes = spectrum.modes_long(self.pairs.where(F.col("mode") < self.k))
        if self.standardise:
            modes = modes.withColumn("psi", scaled("psi", ["network", "mode"]))
        self.nodes, self.features = nodes, list(features)
        wide = [*features, *[f"mode_{i}" for i in range(self.k)]]
        self.rows = VectorAssembler(inputCols=wide, outputCol="features").transform(_with_modes(nodes, modes, self.k, ["network"])).persist()
        train = self.rows if train_column is None else self.rows.where(F.col(train_column))
        self.model = (self.estimator if self.estimator is not None else default_estimator()).copy().fit(train)
        return self

    def predict(self, test_column: str | None = None) -> DataFrame:
        """``network, node_id, yhat`` of rows that were there when it was fitted."""
        if self.model is None:
            raise RuntimeError("fit first")
        rows = self.rows if test_column is None else self.rows.where(F.col(test_column))
        return self.model.transform(rows).select("network", "node_id", F.col(self.model.getPredictionCol()).alias("yhat"))

    def ceiling(self) -> DataFrame:
        """Predictability bound over all rows."""
        if self.model is None:
            raise RuntimeError("fit first")
        return bound.spectral_bound(self.nodes, self.pairs, self.features, self.k)
