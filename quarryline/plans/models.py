"""Model-building queries: closed forms with an SQL twin, and pyspark.ml fits that only bounds can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import modelling as ML
from ..session import table
from .catalogue import query

MATRIX = "SELECT p_partkey, p_size::DOUBLE AS size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price, p_brand FROM part"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"), "p_brand")


@query("ml_matrix", MATRIX)
def ml_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d)


@query("impute_median", f"SELECT p_partkey, coalesce(price, (SELECT median(price) FROM ({MATRIX}))) AS price FROM ({MATRIX})")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return ML.imputed(m, ML.medians(m, ["price"])).select("p_partkey", "price")


@query("impute_most_frequent", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, (SELECT c_mktsegment FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment FROM customer")
def impute_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    return rows.withColumn("segment", F.coalesce("segment", F.lit(ML.most_frequent(rows, "segment"))))


@query("standard_scale", "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS size FROM part")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    return ML.standardised(matrix(spark, d), ["size"]).select("p_partkey", F.round("size", 6).alias("size"))


@query("minmax_scale", "SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part), 6) AS size FROM part")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    return ML.min_max(matrix(spark, d), ["size"]).select("p_partkey", F.round("size", 6).alias("size"))


@query("robust_scale", "SELECT p_partkey, round((p_size - (SELECT quantile_cont(p_size, 0.5) FROM part)) / (SELECT quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) FROM part), 6) AS size FROM part")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return ML.robust(matrix(spark, d), ["size"]).select("p_partkey", F.round("size", 6).alias("size"))


@query("one_hot", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END::DOUBLE AS c_mktsegment_0, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END::DOUBLE AS c_mktsegment_1 FROM customer")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return ML.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("c_mktsegment")


HASH = "('0x' || left(md5('{}/' || {}), 8))::BIGINT"


@query("group_split", f"SELECT o_orderkey, {HASH.format(42, 'o_custkey')} / 4294967296.0 < 0.2 AS is_test, ({HASH.format(7, 'o_custkey')} % 5)::INTEGER AS fold FROM orders")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    split = ML.group_split(table(spark, d, "orders"), "o_custkey", 0.2, 42)
    return split.select("o_orderkey", "is_test", ML.fold("o_custkey", 5, 7).alias("fold"))


@query("ridge_closed_form", "SELECT round(slope, 4) AS slope, round((sy - slope * sx) / n, 2) AS intercept FROM (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0) AS slope FROM (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem))")
def ridge_closed_form(spark: SparkSession, d: str) -> DataFrame:
    return ML.ridge(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 1.0).select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("regression_metrics", "SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(stddev_samp(e), 4) AS residual_sd FROM (SELECT l_extendedprice AS y, l_extendedprice - 1000 * l_quantity AS e FROM lineitem)")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = ML.regression_metrics(table(spark, d, "lineitem").withColumn("p", 1000 * F.col("l_quantity")), "l_extendedprice", "p")
    return m.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("residual_sd", 4).alias("residual_sd"))


@query(
    "weighted_metrics",
    """WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_quantity > 25 THEN 'N' ELSE l_returnflag END AS p FROM lineitem), s AS (SELECT a AS c, count(*) AS support, count(*) FILTER (a = p) AS hit FROM x GROUP BY a), q AS (SELECT p AS c, count(*) AS said FROM x GROUP BY p),
e AS (SELECT support, hit, coalesce(hit / said, 0) AS pr, hit / support AS re FROM s LEFT JOIN q USING (c))
SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision, round(sum(re * support) / sum(support), 6) AS recall, round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support), 6) AS f1 FROM e""",
)
def weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_quantity") > 25, "N").otherwise(F.col("l_returnflag")).alias("p"))
    m = ML.weighted_metrics(rows, "a", "p")
    return m.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("entropy_interval", "SELECT p_partkey, round(-(q * ln(greatest(q, 1e-12)) + (1 - q) * ln(greatest(1 - q, 1e-12))), 6) + 0.0 AS entropy, round(p_retailprice - 1.96 * p_size, 4) AS low, round(p_retailprice + 1.96 * p_size, 4) AS high FROM (SELECT *, p_size / 50.0 AS q FROM part)")
def entropy_interval(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("p_size") / 50.0
    low, high = ML.interval(F.col("p_retailprice"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.round(ML.entropy(F.array(q, 1 - q)), 6).alias("entropy"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query(
    "optimise_topn",
    f"SELECT candidate, round(y, 6) AS y, row_number() OVER (ORDER BY score, candidate)::INTEGER AS rank FROM (SELECT range AS candidate, 20 + {HASH.format('9/t', 'range')} / 4294967296.0 * 20 - ({HASH.format('9/q', 'range')} / 4294967296.0 * 10) * 0.5 AS y, (20 + {HASH.format('9/t', 'range')} / 4294967296.0 * 20 - ({HASH.format('9/q', 'range')} / 4294967296.0 * 10) * 0.5 - 30) ** 2 AS score FROM range(3000)) ORDER BY score, candidate LIMIT 20",
)
def optimise_topn(spark: SparkSession, d: str) -> DataFrame:
    rows = ML.candidates(spark, {"t": (20.0, 40.0), "q": (0.0, 10.0)}, 3000, 9).withColumn("y", F.col("t") - F.col("q") * 0.5)
    return ML.best_candidates(rows, ML.objective(F.col("y"), "target", 30.0), 20).select("candidate", F.round("y", 6).alias("y"), "rank")


@query("augmented_rows")
def augmented_rows(spark: SparkSession, d: str) -> DataFrame:
    return ML.augmented(matrix(spark, d).filter("price is not null"), ["size", "price"], 0.5, 0.02, 3)


def _fitted(code: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        classify = code in ("logistic", "random_forest_classifier", "gradient_boosting_classifier", *ML.SCALED)
        rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", ((F.col("l_quantity") * F.col("l_discount") > 1.2).cast("double") if classify else 3 * F.col("l_quantity") - 40 * F.col("l_discount") + F.col("l_linenumber")).alias("label"))
        split = ML.group_split(rows, "l_orderkey", 0.25, 1)
        model = ML.trained(split.filter("not is_test"), ["l_quantity", "l_discount", "l_tax"], "label", code)
        said = model.transform(split.filter("is_test"))
        return (ML.weighted_metrics if classify else ML.regression_metrics)(said, "label", "prediction")

    return run


for _code in (*ML.ESTIMATORS, *ML.SCALED):
    query(f"train_{_code}")(_fitted(_code))
