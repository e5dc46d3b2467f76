"""Exports, evaluation and models: files written, digests, bounds on what is fitted."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import evaluation as E
from quarryline.operators import exports as P
from quarryline.operators import lifecycle as L
from quarryline.operators import modelling as M
from quarryline.plans import lifecycle as Q


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(2000).select((F.col("id") % 40).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    return r.withColumn("y", 5 * F.col("a") - 2 * F.col("b")).cache()


def test_group_split_takes_a_share_of_groups(spark, rows):
    split = L.group_shuffle_split(rows, "g", 0.25, 3)
    by = split.groupBy("g").agg(F.countDistinct("is_test").alias("n"), F.max("is_test").alias("t")).collect()
    assert all(r.n == 1 for r in by) and sum(r.t for r in by) == 10
    with pytest.raises(ValueError, match="insufficient_groups"):
        L.group_shuffle_split(rows.filter("g = 1"), "g", 0.2, 3)


def test_selection_prediction_saving(spark, rows, tmp_path):
    split = L.group_shuffle_split(rows, "g", 0.25, 3)
    train, test = split.filter("not is_test"), split.filter("is_test")
    ridge, cv = L.searched(train, ["a", "b"], "y", "ridge", "g")
    forest = M.trained(train, ["a", "b"], "y", "random_forest")
    best, metrics = L.selected({"forest": forest, "ridge": ridge}, test, "y", False)
    by = {r.code: r for r in metrics.collect()}
    assert best == "ridge" and by["ridge"].r2 > 0.98 and by["forest"].r2 > 0.8 and cv < 0.3 and by["ridge"].rmse < by["forest"].rmse
    said = L.predicted(forest, test, ["a", "b"]).first()
    trees = [t.predict(forest.stages[0].transform(test.filter((F.col("a") == said.a) & (F.col("b") == said.b))).first()["features"]) for t in forest.stages[-1].trees]
    mean = sum(trees) / len(trees)
    assert said.sd == pytest.approx((sum((t - mean) ** 2 for t in trees) / (len(trees) - 1)) ** 0.5) and said.high == pytest.approx(said.prediction + 1.96 * said.sd)
    with pytest.raises(ValueError, match="missing_prediction_inputs"):
        L.predicted(ridge, test.drop("b"), ["a", "b"])
    digest = L.save(ridge, str(tmp_path / "m"), {"inputs": ["a", "b"]})
    again, info = L.load(str(tmp_path / "m"), digest)
    assert info == {"inputs": ["a", "b"]} and again.stages[-1].coefficients == ridge.stages[-1].coefficients
    with pytest.raises(ValueError, match="digest"):
        L.load(str(tmp_path / "m"), "0" * 64)
    extra = next((tmp_path / "m" / "model").rglob("metadata")) / "part-x"
    extra.write_text("{}")
    with pytest.raises(ValueError, match="digest"):
        L.load(str(tmp_path / "m"), digest)


def test_importance_and_optimum(spark, rows):
    model = M.trained(rows, ["a", "b"], "y", "ridge")
    rank = [r.feature for r in L.top_features(L.permutation_importance(model, rows, ["a", "b"], "y", repeats=2)).collect()]
    assert rank == ["a", "b"]
    settings = M.candidates(spark, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, 500, 1)
    best = L.optimised(model, settings, ["a", "b"], "maximise", most=5, residual_sd=0.5).orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2, 3, 4, 5] and best[0].a > 0.8 and best[0].b < 0.25 and best[0].prediction >= best[4].prediction and best[0].high - best[0].low == pytest.approx(1.96)
    near = L.optimised(model, settings, ["a", "b"], "target", 1.0, 1).first()
    assert abs(near.prediction - 1.0) < 0.1


def test_classes_and_their_doubt(spark, data):
    got = Q.predict_classes(spark, data)
    row = got.agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("right"), F.min("confidence").alias("least"), F.max("entropy").alias("most")).first()
    assert row.right > 0.9 and row.least >= 0.5 - 1e-9 and 0 <= row.most <= 0.6932


def test_registered_models_keep_their_bounds(spark, data):
    chosen = {r.code: r for r in Q.model_selection(spark, data).collect()}
    assert sum(r.selected for r in chosen.values()) == 1 and all(r.r2 > 0.9 for r in chosen.values())
    assert min(chosen.values(), key=lambda r: r.rmse).selected
    best = Q.optimise_model(spark, data).collect()
    assert len(best) == 20 and all(abs(r.prediction - 60) < 1 for r in best)
    weights = {r.feature: r.importance for r in Q.permutation_importance(spark, data).collect()}
    assert weights["l_quantity"] > 10 * abs(weights["l_tax"]) and weights["l_discount"] > 0


def test_augmentation_moves_numbers_a_little(spark, rows):
    got = M.augmented(rows.select("g", "a"), ["a"], 0.5, 0.02, 1)
    own, more = got.filter("not is_augmented"), got.filter("is_augmented")
    assert own.count() == 2000 and 900 < more.count() < 1100
    assert more.agg(F.min("a").alias("x")).first().x > -0.02 and more.select("g").distinct().count() == 40


@pytest.mark.parametrize("seed", range(4))
def test_folds_are_dealt_to_the_lightest(spark, seed):
    import random

    r = random.Random(seed)
    sizes = [r.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(60)]
    rows = spark.createDataFrame([(None if g == 7 else g, k) for g, n in enumerate(sizes) for k in range(n)], "g int, k int")
    got = M.balanced_folds(rows, "g", 4, "f").groupBy("g", "f").count().collect()
    assert sorted((r.g if r.g is not None else 7, r["count"]) for r in got) == sorted(enumerate(sizes))  # whole groups, no row lost
    loads, each = [0] * 4, {}
    for n in sorted(sizes, reverse=True):
        k = loads.index(min(loads))
        loads[k] += n
        each[n, k] = each.get((n, k), 0) + 1
    mine = {}
    for r in got:
        mine[r["count"], r.f] = mine.get((r["count"], r.f), 0) + 1
    assert mine == each and max(loads) - min(loads) < max(sizes)
    assert M.balanced_folds(rows.limit(0), "g", 4, "f").count() == 0


def test_augmentation_draws_with_replacement_and_normal_noise(spark):
    import hashlib
    import math

    rows = spark.createDataFrame([(i, float(i % 7), None if i == 3 else float(i), "k") for i in range(50)], "id_ long, a double, b double, c string")
    got = M.augmented(rows.repartition(5), ["a", "b"], 1.5, 0.02, 9)
    u = lambda *p: (int(hashlib.md5("/".join(map(str, p)).encode()).hexdigest()[:8], 16) + 1) / (1 << 32)
    plain = sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    sd = {c: rows.agg(F.stddev_samp(c)).first()[0] for c in "ab"}
    normal = lambda c, k: math.sqrt(-2 * math.log(u(f"9/{c}/r", k))) * math.cos(2 * math.pi * u(f"9/{c}/a", k))
    want = []
    for k in range(75):
        i, a, b, c = plain[min(49, math.floor(u(9, k) * 50))]
        want.append((i, round(a + 0.02 * sd["a"] * normal("a", k), 9), None if b is None else round(b + 0.02 * sd["b"] * normal("b", k), 9), c))
    more = [(r.id_, round(r.a, 9), None if r.b is None else round(r.b, 9), r.c) for r in got.filter("is_augmented").collect()]
    assert sorted(more, key=str) == sorted(want, key=str) and len({r[0] for r in more}) < 50
    assert M.augmented(rows.limit(1), ["a"], 0.1, 0.02, 1).count() == 2 and M.augmented(rows.limit(0), ["a"], 0.1, 0.02, 1).count() == 0


def test_reports_and_sheets_are_written(spark, tmp_path):
    e = {"numbers": spark.createDataFrame([("n1", 100.0, "g", None, 0.02), ("n2", 5.0, "g", None, None)], "id string, value double, unit string, tolerance double, relative_tolerance double"), "translations": spark.createDataFrame([("t1", "abcd", 0.5)], "id string, reference string, min_score double").limit(0)}
    a = {"numbers": spark.createDataFrame([("n1", 101.9, " G "), ("x", 1.0, "g")], "id string, value double, unit string"), "translations": spark.createDataFrame([], "id string, translation string")}
    metrics, issues = E.evaluated(e, a)
    assert {r.metric: (r.matched, r.total, r.score) for r in metrics.collect()} == {"numeric_tolerance_accuracy": (1, 2, 0.5), "translation_reference_score": (0, 0, None)}
    assert sorted((r.category, r.id, r.status) for r in issues.collect()) == [("numeric", "n2", "missing"), ("unexpected", "x", "unexpected")]
    E.write_report(metrics, issues, str(tmp_path / "r"))
    text = [r.value for r in spark.read.text(str(tmp_path / "r/report")).collect()]
    assert "# Gold standard evaluation" in text and "| numeric_tolerance_accuracy | 1 | 2 | 0.5000 |" in text and sum(t.startswith("* ") for t in text) == 2
    sheet = spark.createDataFrame([(1, 'a "b", c\nd')], "i long, t string")
    P.write_sheets({"one": sheet, "two": sheet.limit(0)}, str(tmp_path / "s"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "s/one"), header=True, multiLine=True, escape='"', schema="i long, t string").collect()] == [(1, 'a "b", c\nd')]


def test_cells_show_what_they_hold(spark):
    cell = spark.createDataFrame([("", 1.0, None, None, "t", None, None), (None, 0.0, None, None, None, None, None), (None, None, False, None, "t", None, None), (None, None, None, None, "", '{"value": 3}', None), (None, None, None, None, None, "{}", '{"min": 1}'), (None,) * 7], "raw string, number double, flag boolean, day date, text string, norm string, ml string")
    got = cell.select(P.raw_cell(F.lit(True), F.col("raw"), F.col("number"), F.col("text")).alias("r"), P.ml_cell(*(F.col(c) for c in ("number", "flag", "day", "text", "norm", "ml"))).alias("m")).collect()
    assert [tuple(r) for r in got] == [("", "1.0"), ("0.0", "0.0"), ("t", "false"), ("——", "3"), ("——", '{"min": 1}'), ("——", "")]
