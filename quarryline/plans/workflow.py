"""Reads and checks around a dataset's life: exports, nested pages, conversions asked for, scope, importance, folds."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import exports as P
from ..operators import modelling as ML
from ..session import checkpointed, table
from .catalogue import query


@query("publication_time", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 3 = 1 THEN year(o_orderdate)::VARCHAR END, '——') AS published FROM orders")
def publication_time(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", P.publication_time(F.when(k % 3 == 0, at.cast("date")), F.when(k % 3 == 1, F.year(at)).otherwise(F.when(k % 2 == 0, 0))).alias("published"))


@query("export_precedence", "SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN '' END, CASE WHEN p_size % 2 = 1 THEN p_size::VARCHAR END, nullif(p_type, ''), '——') AS raw, coalesce(CASE WHEN p_size % 2 = 1 THEN p_size::VARCHAR END, CASE WHEN p_size % 3 = 0 THEN 'true' END, '') AS ml FROM part")
def export_precedence(spark: SparkSession, d: str) -> DataFrame:
    s, none = F.col("p_size"), F.lit(None).cast("string")
    raw, number = F.when(s % 4 == 0, F.col("p_name")).when(s % 4 == 1, ""), F.when(s % 2 == 1, s.cast("string"))
    return table(spark, d, "part").select("p_partkey", P.raw_cell(F.lit(True), raw, number, F.col("p_type")).alias("raw"), P.ml_cell(number, F.when(s % 3 == 0, F.lit(True)), none, none, none, none).alias("ml"))


@query(
    "dataset_page",
    "SELECT o.o_orderkey, count(l_orderkey) AS n_cells, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS cells FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200) o LEFT JOIN lineitem ON l_orderkey = o.o_orderkey GROUP BY o.o_orderkey",
)
def dataset_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of rows with their cells nested: the page is cut first, and only its cells are gathered."""
    page = table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(200).limit(100)
    both = page.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    cell = F.when(F.col("l_orderkey").isNotNull(), F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    nested = both.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_cells"), F.array_sort(F.collect_list(cell)).alias("c"))
    text = F.array_join(F.transform("c", lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(":"), c["l_partkey"].cast("string"))), ",")
    return nested.select("o_orderkey", "n_cells", F.when(F.size("c") > 0, text).alias("cells"))


@query("rank_in_group", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders")
def rank_in_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rank"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_quantity", "l_discount", "l_tax", (3 * F.col("l_quantity") - 40 * F.col("l_discount") + F.col("l_linenumber")).alias("label"))


@query("group_folds")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Every user's fold of five, whole, and how many events it has; SQL has no step by step dealing, the tests do it."""
    placed = ML.balanced_folds(table(spark, d, "events").select("user_id", "event_id"), "user_id", 5)
    return placed.groupBy("user_id", "fold").agg(F.count("*").alias("n"))


@query("cross_validated_grid")
def cross_validated_grid(spark: SparkSession, d: str) -> DataFrame:
    """regularisation and mean error over folds of whole groups."""
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(_measured(spark, d))
    rows = checkpointed(ML.balanced_folds(rows, "l_orderkey", 3).select("features", "label", "fold"))
    lr = LinearRegression(solver="normal")
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1, 10.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=3, foldCol="fold").fit(rows)
    return spark.createDataFrame([(p[lr.regParam], float(m)) for p, m in zip(grid, cv.avgMetrics, strict=True)], "reg double, rmse double")
