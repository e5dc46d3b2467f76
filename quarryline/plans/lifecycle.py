"""A model's life over lines and orders; closed forms have SQL, fits are held to bounds by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import modelling as ML
from ..session import table
from .catalogue import query

INPUTS = ["l_quantity", "l_discount", "l_tax"]
#: The share of the orders that are test orders, and the seed they are drawn by.
TEST = (0.25, 1)


def lines(spark: SparkSession, d: str, classify: bool = False) -> DataFrame:
    label = (F.col("l_quantity") * F.col("l_discount") > 1.2).cast("double") if classify else 3 * F.col("l_quantity") - 40 * F.col("l_discount") + F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", *INPUTS, label.alias("label"))


def measured(spark: SparkSession, d: str, classify: bool = False) -> DataFrame:
    return L.group_shuffle_split(lines(spark, d, classify), "l_orderkey", *TEST)


@query("feature_matrix", "SELECT o_orderkey AS row_id, o_custkey AS group_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status, (o_orderkey % 50)::DOUBLE AS y FROM orders WHERE o_orderkey % 3 <> 0")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts = [("price", F.when(k % 5 != 0, F.col("o_totalprice")), text, F.lit(False)), ("status", number, F.col("o_orderstatus"), k % 4 == 0), ("y", (k % 50).cast("double"), text, k % 3 == 0)]
    cells = None
    for name, v, t, missing in parts:
        one = o.select(k.alias("row_id"), F.col("o_custkey").alias("group_id"), F.lit(name).alias("field"), v.alias("value_number"), t.alias("value_text"), missing.alias("is_missing"))
        cells = one if cells is None else cells.unionByName(one)
    return L.feature_matrix(cells, {"price": "number", "status": "text"}, "y")


@query("group_shuffle_split", "WITH g AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('7/' || o_custkey), o_custkey) AS n, count(*) OVER () AS total FROM g) SELECT o_orderkey, n <= greatest(1, ceil(total * 0.2)) AS is_test FROM orders JOIN n USING (o_custkey)")
def group_shuffle_split(spark: SparkSession, d: str) -> DataFrame:
    return L.group_shuffle_split(table(spark, d, "orders"), "o_custkey", 0.2, 7).select("o_orderkey", "is_test")


def _residuals(model, test: DataFrame) -> float:
    return ML.regression_metrics(model.transform(test), "label", "prediction").first()["residual_sd"]


@query("model_selection")
def model_selection(spark: SparkSession, d: str) -> DataFrame:
    """Test metrics of three estimators, each the best of its grid, and which one is selected."""
    train, test = L.split_foldings(lines(spark, d), INPUTS, "label", "l_orderkey", *TEST)
    models, cv = {}, {}
    for code in ("ridge", "random_forest", "gradient_boosting"):
        models[code], cv[code] = L.searched(None, INPUTS, "label", code, counts=train)
    best, every = L.selected(models, test, "label", False, "_times")
    folds = spark.createDataFrame(list(cv.items()), "code string, cv_rmse double")
    return every.join(folds, "code").withColumn("selected", F.col("code") == best)


@query("predict_regression")
def predict_regression(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of test lines by a forest, with the spread of its trees."""
    rows = measured(spark, d)
    model = ML.trained(rows.filter("not is_test"), INPUTS, "label", "random_forest")
    return L.predicted(model, rows.filter("is_test"), INPUTS).select("l_orderkey", "label", "prediction", "sd", "low", "high")


@query("predict_classes")
def predict_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = measured(spark, d, True)
    model = ML.trained(rows.filter("not is_test"), INPUTS, "label", "random_forest_classifier")
    return L.predicted(model, rows.filter("is_test"), INPUTS).select("l_orderkey", "label", "prediction", "probabilities", "confidence", "entropy")


@query("optimise_model")
def optimise_model(spark: SparkSession, d: str) -> DataFrame:
    """The twenty of three thousand settings that a fitted ridge brings nearest to a target."""
    rows = measured(spark, d)
    train = rows.filter("not is_test")
    model = ML.trained(train, INPUTS, "label", "ridge")
    settings = ML.candidates(spark, {"l_quantity": (1.0, 50.0), "l_discount": (0.0, 0.1), "l_tax": [0.0, 0.02, 0.04]}, 3000, 5)
    return L.optimised(model, settings, INPUTS, "target", 60.0, 20, _residuals(model, rows.filter("is_test"))).select("rank", "candidate", *INPUTS, "prediction", "score", "low", "high")


@query("permutation_importance")
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = measured(spark, d)
    model = ML.trained(rows.filter("not is_test"), INPUTS, "label", "ridge")
    return L.top_features(L.permutation_importance(model, rows.filter("is_test"), INPUTS, "label"))
