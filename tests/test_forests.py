"""Searches over counted rows: splits, folds and metrics are those of the rows written out, stored forests those that were grown."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import forests as T
from quarryline.operators import lifecycle as L
from quarryline.operators import modelling as M


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 131).alias("g"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    return r.withColumn("y", 3 * F.col("a") - F.col("b") * F.col("b") + F.col("k") % 2).cache()


def test_few_different_rows_stand_for_all(spark, rows):
    train, test = L.split_foldings(rows, ["a", "b"], "y", "g", 0.25, 3)
    split = L.group_shuffle_split(rows, "g", 0.25, 3)
    want = M.balanced_folds(split.filter("not is_test"), "g", 3, "f").groupBy("a", "b", "y", "f").count()
    assert sorted(map(tuple, train.select("a", "b", "y", "_fold", "_times").collect())) == sorted(map(tuple, want.collect()))
    held = split.filter("is_test").groupBy("a", "b", "y").count()
    assert sorted(map(tuple, test.select("a", "b", "y", "_times").collect())) == sorted(map(tuple, held.collect()))
    assert train.count() < rows.count() / 4
    digest = lambda g: hashlib.md5(f"3/{g}".encode()).hexdigest()
    assert {r.g for r in split.filter("is_test").select("g").distinct().collect()} == set(sorted(range(131), key=digest)[: math.ceil(131 / 4)])


def test_metrics_of_counted_rows_are_those_of_the_rows(spark, rows):
    said = rows.withColumn("p", F.col("a") * 3 - 5)
    counts = said.groupBy("y", "p").count()
    assert M.regression_metrics(counts, "y", "p", "count").first().asDict() == pytest.approx(M.regression_metrics(said, "y", "p").first().asDict())
    one = counts.limit(1).withColumn("count", F.lit(1))
    assert tuple(M.regression_metrics(one, "y", "p", "count").select("r2", "residual_sd").first()) == (0.0, None)


@pytest.mark.parametrize("code", ["ridge", "gradient_boosting"])
def test_fits_by_weight_are_those_of_the_rows(spark, rows, code):
    from pyspark.ml.feature import VectorAssembler

    model, _ = L.searched(rows, ["a", "b"], "y", code, "g")
    found = model.stages[-1]
    plain = M.ESTIMATORS[code]("y", 42)
    plain = plain.copy({plain.getParam(n): found.getOrDefault(n) for n in L.GRIDS[code]}).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows))
    different = model.transform(rows.select("a", "b").distinct()).withColumnRenamed("prediction", "p")
    both = plain.transform(different)
    assert both.filter(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0


def test_a_stored_forest_is_the_one_that_was_grown(spark, rows, tmp_path):
    counts = L.foldings(rows, ["a", "b"], "y", "g")
    estimator = M.ESTIMATORS["random_forest"]("y", 42)
    model, cv = L.searched(None, ["a", "b"], "y", "random_forest", counts=counts)
    forest = model.stages[-1]
    how = T._settings(estimator.copy({estimator.getParam(n): forest.getOrDefault(n) for n in L.GRIDS["random_forest"]}))
    mine = T.Counted(counts.toPandas(), ["a", "b"], "y")
    said = sum(p for _, _, p in mine.trees(how, -1, range(20))) / 20
    want = {(a, b): p for (a, b), p in zip(mine.x.tolist(), said.tolist(), strict=True)}
    got = {(r.a, r.b): r.prediction for r in model.transform(rows.select("a", "b").distinct()).collect()}
    assert got == pytest.approx(want) and len(forest.trees) == 20
    assert cv == pytest.approx(np.mean([mine.rmse(how, k) for k in range(3)])) and cv < 4
    tree = forest.trees[0]
    assert tree.depth <= how["depth"] and model.transform(rows).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0] < 4
    digest = L.save(model, str(tmp_path / "f"), {})
    assert L.load(str(tmp_path / "f"), digest)[0].stages[-1].getNumTrees == 20
    assert set(L.predicted(model, rows, ["a", "b"]).columns) >= {"sd", "low", "high"}


def test_a_tree_cuts_where_the_variance_falls_most():
    codes = np.array([[0, 0], [1, 0], [2, 1], [3, 1]])
    n, y = np.array([2.0, 1.0, 3.0, 1.0]), np.array([1.0, 1.0, 5.0, 9.0])
    nodes, ends = T.grown(codes, n, n * y, n * y * y, 2, 1, 2, np.random.default_rng(1))
    assert nodes[0, 4:6].tolist() in ([0.0, 1.0], [1.0, 0.0]) and (nodes[ends, 1] / nodes[ends, 0]).tolist() == y.tolist()
    nodes, ends = T.grown(codes, n, n * y, n * y * y, 2, 2, 2, np.random.default_rng(1))
    assert (nodes[ends, 1] / nodes[ends, 0]).tolist() == [1.0, 1.0, 6.0, 6.0]  # one row alone is too few for a node
    x = np.repeat(np.arange(100.0), 1)
    cuts = T.thresholds(x, np.ones(100), 32)
    assert len(cuts) == 31 and np.diff(cuts).max() <= 4 and T.thresholds(x[:5], np.ones(5), 32).tolist() == [0.5, 1.5, 2.5, 3.5]
