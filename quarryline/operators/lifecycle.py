"""A model's life: matrix, split, selection over estimators, explanation, saving with a digest, prediction, optimisation."""

from __future__ import annotations

import functools
import hmac
import json
import operator

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import ClassificationModel, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import forests
from .modelling import ESTIMATORS, balanced_folds, entropy, fold, folded, interval, objective, regression_metrics, weighted_metrics
from .ordering import numbered

#: The grids that a search goes through.
GRIDS = {
    "ridge": {"regParam": [0.1, 1.0, 10.0]},
    "logistic": {"regParam": [0.1, 1.0, 10.0]},
    "random_forest": {"maxDepth": [5, 8], "minInstancesPerNode": [1, 2]},
    "random_forest_classifier": {"maxDepth": [5, 8], "minInstancesPerNode": [1, 2]},
    "gradient_boosting": {"stepSize": [0.05, 0.1]},
}

#: Different rows that a task of a fit has at least: fits are many short jobs.
ROWS = 20_000


def feature_matrix(cells: DataFrame, inputs: dict[str, str], target: str) -> DataFrame:
    """row_id, group_id, a column for each input of a stated list (number or text) and the target, of cells that are not missing.

    cells(row_id, group_id, field, value_number, value_text, is_missing): the number, else the text. Rows without a target go.
    """
    live = cells.filter(~F.col("is_missing")).select("row_id", "group_id", "field", F.coalesce(F.col("value_number").cast("string"), "value_text").alias("v"))
    wide = live.groupBy("row_id", "group_id").pivot("field", [*inputs, target]).agg(F.first("v", ignorenulls=True))
    typed = [(F.col(f"`{c}`").try_cast("double") if t == "number" else F.col(f"`{c}`")).alias(c) for c, t in inputs.items()]
    return wide.filter(F.col(f"`{target}`").isNotNull()).select("row_id", "group_id", *typed, F.col(f"`{target}`").try_cast("double").alias(target))


def drawn_groups(groups: DataFrame, group: str, share: float, seed: int) -> Column:
    """Whether a row's group is one of a share of the different groups (rounded up, one at least), drawn by seeded digest.

    A histogram of the digests' first letters tells where the last one drawn lies; only the digests there are ordered, and
    whether a row is drawn is then told by its own digest, without a join. Two groups are needed.
    """
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(group).cast("string")))
    start = F.substring(digest, 1, 4)
    counts = {r["p"]: r["n"] for r in groups.groupBy(start.alias("p")).agg(F.count("*").alias("n")).collect()}  # 65,536 rows at most
    total = sum(counts.values())
    if total < 2:
        raise ValueError("insufficient_groups")
    left = min(total - 1, max(1, -(-int(round(total * share * 1_000_000)) // 1_000_000)))
    for edge in sorted(counts):
        if left <= counts[edge]:
            break
        left -= counts[edge]
    near = groups.filter(start == edge).select(digest.alias("d"), F.col(group).alias("g")).orderBy("d", "g").collect()  # a 65,536th of the groups
    last = near[left - 1]["d"]
    tied = [(k < left, r["g"]) for k, r in enumerate(near) if r["d"] == last]
    also = F.lit(True) if all(drawn for drawn, _ in tied) else functools.reduce(operator.or_, (F.col(group).eqNullSafe(F.lit(g)) for drawn, g in tied if drawn))
    return (digest < last) | ((digest == last) & also)


def group_shuffle_split(rows: DataFrame, group: str, test_share: float, seed: int) -> DataFrame:
    """rows with is_test: a share of the groups (rounded up, one at least), drawn by seeded digest, whole; two groups are needed."""
    drawn = drawn_groups(checkpointed(rows.select(group).distinct()), group, test_share, seed)
    return rows.filter(F.col(group).isNotNull()).withColumn("is_test", drawn)


def counted(rows: DataFrame, inputs: list[str], y: str) -> DataFrame:
    """The different rows of the inputs, y and _fold, and in _times how many there are of each, materialised."""
    return checkpointed(rows.groupBy(*inputs, y, "_fold").agg(F.count("*").cast("double").alias("_times")))


def foldings(rows: DataFrame, inputs: list[str], y: str, group: str | None = None, folds: int = 3, seed: int = 42) -> DataFrame:
    """What a search fits: the different rows of each fold with how many there are of them.

    Folds are of whole groups and balanced by their rows; with fewer than two groups, or none named, rows are dealt by digest.
    """
    groups = rows.select(group).distinct().limit(folds).count() if group else 0
    if groups >= 2:
        placed = balanced_folds(rows, group, min(folds, groups), "_fold")
    else:
        placed = rows.withColumn("_key", F.to_json(F.struct(*inputs, y))).withColumn("_fold", fold("_key", folds, seed))
    return counted(placed, inputs, y)


def split_foldings(rows: DataFrame, inputs: list[str], y: str, group: str, test_share: float, test_seed: int, folds: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The foldings of group_shuffle_split's training rows, and the different test rows with how many there are of them.

    Split and folds are those of the groups, which are counted once; the rows are joined with them and counted in one pass.
    """
    sizes = checkpointed(rows.groupBy(group).agg(F.count("*").alias("_size")))
    test = drawn_groups(sizes, group, test_share, test_seed)
    train = sizes.filter(F.col(group).isNotNull() & ~test)
    n = train.limit(folds).count()
    if n < 2:
        both = rows.filter(F.col(group).isNotNull())
        return foldings(both.filter(~test), inputs, y, group, folds, seed), counted(both.filter(test).withColumn("_fold", F.lit(-1)), inputs, y)
    placed = folded(train, group, n, "_fold").unionByName(sizes.filter(test).select(group, F.lit(-1).alias("_fold")))
    counts = counted(rows.select(group, *inputs, y).join(placed, group), inputs, y)
    return counts.filter("_fold >= 0"), counts.filter("_fold < 0")


def searched(rows: DataFrame | None, inputs: list[str], y: str, code: str, group: str | None = None, folds: int = 3, seed: int = 42, counts: DataFrame | None = None) -> tuple[PipelineModel, float]:
    """The best pipeline of an estimator's grid by folds of whole groups, and its mean metric (RMSE, or weighted F1 of a classifier).

    counts are the foldings of the rows, if they are made already, then rows may be None. Fits see each different row once, with its
    weight; forests, whose draws are of single rows, see the rows written out, unless they are of numbers and the different
    rows are few enough for a task.
    """
    estimator = ESTIMATORS[code](y, seed)
    grid = ParamGridBuilder()
    for name, values in GRIDS.get(code, {}).items():
        grid = grid.addGrid(estimator.getParam(name), values)
    grid = grid.build()
    measure = MulticlassClassificationEvaluator(labelCol=y, metricName="f1", weightCol="_times") if "class" in code or code == "logistic" else RegressionEvaluator(labelCol=y, metricName="rmse", weightCol="_times")
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    counts = foldings(rows, inputs, y, group, folds, seed) if counts is None else counts
    size = counts.agg(F.count("*").alias("n"), F.max("_fold").alias("most")).first()
    folds = (size["most"] or 0) + 1
    if code == "random_forest" and size["n"] <= forests.MOST:
        forest, means = forests.searched(counts, inputs, y, estimator, grid, folds)
        return PipelineModel(stages=[assembler, forest]), min(means)
    if code.startswith("random_forest"):
        counts = counts.withColumn("_times", F.explode(F.array_repeat(F.lit(1.0), F.col("_times").cast("int"))))
    else:
        estimator = weighted(estimator, "_times")
    placed = checkpointed(assembler.transform(counts.coalesce(1 + size["n"] // ROWS)).select("features", y, "_fold", "_times"))
    found = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=measure, numFolds=folds, foldCol="_fold", parallelism=2).fit(placed)
    return PipelineModel(stages=[assembler, found.bestModel]), float(min(found.avgMetrics) if measure.getMetricName() == "rmse" else max(found.avgMetrics))


def weighted(estimator: Estimator, column: str) -> Estimator:
    """The estimator with the weights of a column; one against the rest hands them to what it fits."""
    if isinstance(estimator, OneVsRest):
        estimator.setClassifier(weighted(estimator.getClassifier(), column))
    return estimator.setWeightCol(column)


def selected(models: dict[str, PipelineModel], test: DataFrame, y: str, classify: bool, times: str | None = None) -> tuple[str, DataFrame]:
    """The code of the model with the least test RMSE, or the greatest weighted F1, the first of equal ones, and every model's metrics.

    times names the column that says how many equal test rows a row stands for (of numbers, not of classes).
    """
    if classify and times:
        raise ValueError("rows of classes stand for themselves")
    best, every, score = "", None, None
    for code, model in models.items():
        metrics = weighted_metrics(model.transform(test), y, "prediction") if classify else regression_metrics(model.transform(test), y, "prediction", times)
        said = metrics.withColumn("code", F.lit(code))
        row = said.first()  # one row of metrics
        value = -row["f1"] if classify else row["rmse"]
        if score is None or value < score:
            best, score = code, value
        every = said if every is None else every.unionByName(said)
    return best, every


def permutation_importance(model: PipelineModel, test: DataFrame, inputs: list[str], y: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature and importance, the mean rise of the RMSE over some shuffles of its values among the test rows.

    A shuffle is a seeded random order of all rows against their own order: two numberings meet by number.
    """
    base = numbered(test, [F.xxhash64(*test.columns)], "_n").select(*test.columns, "_n")
    plain = regression_metrics(model.transform(base), y, "prediction").first()["rmse"]
    out = []
    for c in inputs:
        rises = []
        for r in range(repeats):
            moved = numbered(base.select(F.col(c).alias("_c"), F.col("_n").alias("_o")), [F.xxhash64("_o", F.lit(seed + r))], "_n").select("_n", "_c")
            shuffled = base.join(moved, "_n").withColumn(c, F.col("_c"))
            rises.append(regression_metrics(model.transform(shuffled), y, "prediction").first()["rmse"] - plain)
        out.append((c, sum(rises) / repeats))
    return test.sparkSession.createDataFrame(out, "feature string, importance double")


def top_features(importance: DataFrame, most: int = 20) -> DataFrame:
    """The features of greatest size of importance."""
    return importance.orderBy(F.desc(F.abs("importance")), "feature").limit(most)


def missing_inputs(rows: DataFrame, inputs: list[str]) -> list[str]:
    return [c for c in inputs if c not in rows.columns]


def predicted(model: PipelineModel, rows: DataFrame, inputs: list[str], residual_sd: float = 0.0) -> DataFrame:
    """rows with prediction and what is uncertain about it.

    A classifier: probabilities, confidence (the greatest) and entropy. A forest: the sample deviation of its trees'
    predictions; other models: that of the test residuals; with the interval of 1.96 deviations.
    """
    lacking = missing_inputs(rows, inputs)
    if lacking:
        raise ValueError(f"missing_prediction_inputs: {lacking}")
    said, last = model.transform(rows), model.stages[-1]
    if isinstance(last, ClassificationModel):
        p = vector_to_array("probability") if "probability" in said.columns else F.array(F.lit(1.0))
        out = said.withColumn("probabilities", p)
        return out.withColumns({"confidence": F.array_max("probabilities"), "entropy": entropy(F.col("probabilities"))}).drop("features", "rawPrediction", "probability")
    sd: Column = F.lit(float(residual_sd))
    if hasattr(last, "trees") and type(last).__name__.startswith("RandomForest"):
        for i, tree in enumerate(last.trees):
            said = tree.setPredictionCol(f"_t{i}").transform(said)
        each = F.array(*(F.col(f"_t{i}") for i in range(len(last.trees))))
        mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / len(last.trees)
        sd = F.sqrt(F.aggregate(F.transform(each, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / (len(last.trees) - 1))
    low, high = interval(F.col("prediction"), F.col("sd"))
    return said.withColumn("sd", sd).withColumns({"low": low, "high": high}).drop("features", *(c for c in said.columns if c.startswith("_t")))


def optimised(model: PipelineModel, candidates: DataFrame, inputs: list[str], goal: str, target: float | None = None, most: int = 20, residual_sd: float = 0.0) -> DataFrame:
    """The candidates whose prediction serves a goal best (maximise, minimise or target), ranked, with their uncertainty."""
    scored = predicted(model, candidates, inputs, residual_sd).withColumn("score", objective(F.col("prediction"), goal, target))
    few = scored.orderBy("score", "candidate").limit(most)
    return numbered(few, ["score", "candidate"], "rank", 1)


def _digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of all files under a path, by name; contents are read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = files.select(F.regexp_extract("path", r"/(?:metadata|stages|data|treesMetadata)/.*$", 0).alias("name"), F.sha2("content", 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "d"))), "\n"), 256).alias("d")).first()["d"]


def save(model: PipelineModel, path: str, info: dict) -> str:
    """The model in a folder, its inputs and figures beside it, and the digest, which the caller keeps too."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    digest = _digest(spark, f"{path}/model")
    spark.createDataFrame([(json.dumps(info, sort_keys=True), digest)], "info string, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return digest


def load(path: str, digest: str) -> tuple[PipelineModel, dict]:
    """The model and what was saved with it; refused if its files do not have the digest kept by the caller and in the folder."""
    spark = SparkSession.active()
    row = spark.read.schema("info string, digest string").json(f"{path}/manifest").first()
    found = _digest(spark, f"{path}/model")
    if not (hmac.compare_digest(found, digest) and hmac.compare_digest(found, row["digest"])):
        raise ValueError("model_digest_mismatch")
    return PipelineModel.load(f"{path}/model"), json.loads(row["info"])
