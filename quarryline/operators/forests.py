"""Regression forests over rows that stand for many equal ones.

A forest draws each row with a Poisson number of mean 1 for each tree. Among ``times`` equal rows that makes a Poisson number of mean
``times`` in all, and a tree needs no more of them than that number, so a forest over counted rows is that over the rows themselves.
Trees split as those of ``pyspark.ml`` do: at thresholds between quantiles of a feature, a third of the features tried at each node,
by the loss of variance. They are grown in tasks, a level at a time for all nodes, and stored in the form that ``pyspark.ml`` loads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Different rows that a task takes at most.
MOST = 500_000
NODE = "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"


def thresholds(x: np.ndarray, times: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to the quantiles that cut the rows into bins."""
    values, at = np.unique(x, return_inverse=True)
    bins = min(bins, int(times.sum()))
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    sums = np.cumsum(np.bincount(at, times))
    step, goal, out = sums[-1] / bins, sums[-1] / bins, []
    for i in range(1, len(values)):
        if abs(sums[i - 1] - goal) < abs(sums[i] - goal):
            out.append((values[i - 1] + values[i]) / 2)
            goal += step
    return np.array(out)


def grown(codes: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, depth: int, least: int, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A tree over cells (codes of features by cell) with n rows each, their sum s and sum of squares q.

    Its nodes as rows (n, sum, squares, gain, feature, code, left, right), by level, and the node that each cell ends in.
    """
    m, wide = codes.shape[1], int(codes.max(initial=0)) + 2
    node, nodes, first = np.zeros(len(codes), np.int64), [], 0  # node: of the level's
    done, ends = np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    width = 1
    for level in range(depth + 1):
        live = np.nonzero(~done)[0]
        at = node[live]
        total, sums, squares = (np.bincount(at, x[live], width) for x in (n, s, q))
        rows = np.full((width, 8), -1.0)
        rows[:, 0], rows[:, 1], rows[:, 2] = total, sums, squares
        best, feature, code = np.zeros(width), np.full(width, -1), np.zeros(width, np.int64)
        if level < depth:
            picked = np.argsort(rng.random((width, m)), axis=1) < tried
            for j in range(m):
                key = at * wide + codes[live, j]
                ln, ls = (np.cumsum(np.bincount(key, x[live], width * wide).reshape(width, wide), axis=1)[:, :-1] for x in (n, s))
                rn, rs = total[:, None] - ln, sums[:, None] - ls
                valid = (ln >= max(1, least)) & (rn >= max(1, least)) & picked[:, j, None]
                gain = np.where(valid, ls * ls / np.maximum(ln, 1) + rs * rs / np.maximum(rn, 1) - (sums * sums / np.maximum(total, 1))[:, None], 0.0)
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                more = (top > best) & (top > 1e-12 * squares)
                best, feature, code = np.where(more, top, best), np.where(more, j, feature), np.where(more, b, code)
        split = feature >= 0
        child = np.cumsum(split) - 1
        rows[split, 3], rows[split, 4], rows[split, 5] = best[split] / total[split], feature[split], code[split]
        rows[split, 6] = first + width + 2 * child[split]
        rows[split, 7] = rows[split, 6] + 1
        nodes.append(rows)
        stops = live[~split[at]]
        ends[stops], done[stops] = first + node[stops], True
        go = live[split[at]]
        right = codes[go, feature[node[go]]] > code[node[go]]
        node[go] = 2 * child[node[go]] + right
        first, width = first + width, 2 * int(split.sum())
        if not width:
            break
    return np.concatenate(nodes), ends


class Counted:
    """Different rows of features x and y, each with its fold and how often it occurs."""

    def __init__(self, rows: pd.DataFrame, inputs: list[str], y: str):
        rows = rows.sort_values([*inputs, y, "_fold"], ignore_index=True)  # draws go by the order
        self.x, self.y = rows[inputs].to_numpy(float), rows[y].to_numpy(float)
        self.fold, self.times = rows["_fold"].to_numpy(), rows["_times"].to_numpy(float)

    def trees(self, how: dict, without: int, numbers: range) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """Of each tree of those numbers, over the rows outside a fold: nodes, thresholds, and the prediction for every row."""
        mine = self.fold != without
        cuts = [thresholds(self.x[mine, j], self.times[mine], how["bins"]) for j in range(self.x.shape[1])]
        codes = np.stack([np.searchsorted(c, self.x[:, j]) for j, c in enumerate(cuts)], axis=1)
        cells, cell = np.unique(codes, axis=0, return_inverse=True)
        cell = cell.ravel()
        middle = float(self.y[mine] @ self.times[mine] / self.times[mine].sum())
        y = self.y - middle
        for t in numbers:
            rng = np.random.default_rng([how["seed"] & (1 << 63) - 1, t])
            drawn = np.where(mine, rng.poisson(self.times), 0).astype(float)
            sums = [np.bincount(cell, w, len(cells)) for w in (drawn, drawn * y, drawn * y * y)]
            nodes, ends = grown(cells, *sums, how["depth"], how["least"], -(-self.x.shape[1] // 3), rng)
            said = middle + nodes[:, 1] / np.maximum(nodes[:, 0], 1)
            nodes[:, 2] += 2 * middle * nodes[:, 1] + middle * middle * nodes[:, 0]
            nodes[:, 1] += middle * nodes[:, 0]
            yield nodes, cuts, said[ends][cell]

    def rmse(self, how: dict, fold: int) -> float:
        """Of the forest over the other folds, in a fold."""
        mine = self.fold == fold
        said = sum(p[mine] for _, _, p in self.trees(how, fold, range(how["trees"]))) / how["trees"]
        return float(np.sqrt(self.times[mine] @ (self.y[mine] - said) ** 2 / self.times[mine].sum()))


def _settings(estimator: RandomForestRegressor) -> dict:
    return {"trees": estimator.getNumTrees(), "depth": estimator.getMaxDepth(), "least": estimator.getMinInstancesPerNode(), "bins": estimator.getMaxBins(), "seed": estimator.getSeed()}


def searched(counts: DataFrame, inputs: list[str], y: str, estimator: RandomForestRegressor, grid: list[dict], folds: int) -> tuple[RandomForestRegressionModel, list[float]]:
    """The best forest of a grid over all rows of counts(inputs, y, _fold, _times), and each grid point's mean RMSE over the folds."""
    spark = counts.sparkSession
    hows = [_settings(estimator.copy(g)) for g in grid]
    shared = spark.sparkContext.broadcast(Counted(counts.select(*inputs, y, "_fold", "_times").toPandas(), inputs, y))  # MOST rows

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(g, k, shared.value.rmse(hows[g], k)) for g, k in zip(batch["g"], batch["k"], strict=True)], columns=["g", "k", "rmse"])

    todo = spark.createDataFrame(spark.sparkContext.parallelize([(g, k) for g in range(len(hows)) for k in range(folds)], len(hows) * folds), "g int, k int")
    found = todo.mapInPandas(measured, "g int, k int, rmse double").groupBy("g").agg(F.avg("rmse").alias("rmse")).orderBy("g").collect()  # a row for each grid point
    means = [r["rmse"] for r in found]
    best = means.index(min(means))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["t"]:
                nodes, cuts, _ = next(shared.value.trees(hows[best], -1, range(t, t + 1)))
                out = []
                for i, (n, s, q, gain, j, code, left, right) in enumerate(nodes.tolist()):
                    split = (int(j), [float(cuts[int(j)][int(code)])], -1) if left >= 0 else (-1, [], -1)
                    mean = s / max(n, 1.0)
                    out.append((int(t), (i, mean, max(0.0, q / max(n, 1.0) - mean * mean), [n, s, q], int(n), gain, int(left), int(right), split)))
                yield pd.DataFrame({"treeID": [r[0] for r in out], "nodeData": [dict(zip(("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"), (*r[1][:8], dict(zip(("featureIndex", "leftCategoriesOrThreshold", "numCategories"), r[1][8], strict=True))), strict=True)) for r in out]})

    trees = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in range(hows[best]["trees"])], hows[best]["trees"]), "t int")
    return _stored(trees.mapInPandas(told, f"treeID int, nodeData {NODE}"), estimator.copy(grid[best]), len(inputs)), means


def _stored(nodes: DataFrame, estimator: RandomForestRegressor, inputs: int) -> RandomForestRegressionModel:
    """A model of those nodes: they take the place of the nodes of a model of one row in the files that it is saved in."""
    spark, nodes = nodes.sparkSession, checkpointed(nodes)
    folder = f"{spark.sparkContext.getCheckpointDir()}/forest-{uuid.uuid4().hex}"
    row = spark.range(1).select(F.array(*(F.lit(0.0) for _ in range(inputs))).alias("x"), F.lit(0.0).alias(estimator.getLabelCol()))
    estimator.fit(row.withColumn("features", array_to_vector("x"))).write().save(folder)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/data")
    return RandomForestRegressionModel.load(folder)
