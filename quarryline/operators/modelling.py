"""Small-table modelling: matrices, scaling, splits, closed-form ridge, metrics, ranking of candidates."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians: one aggregation, one row to the driver."""
    row = rows.agg(*(F.median(c).alias(c) for c in columns)).first()
    return {c: row[c] for c in columns}


def imputed(rows: DataFrame, fill: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def most_frequent(rows: DataFrame, column: str) -> str | None:
    """The commonest value, of equal ones the least."""
    row = rows.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return row[column] if row else None


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    row = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return rows.withColumns({c: (F.col(c) - row[f"m_{c}"]) / (row[f"s_{c}"] or 1.0) for c in columns})


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    row = rows.agg(*(F.min(c).alias(f"a_{c}") for c in columns), *(F.max(c).alias(f"b_{c}") for c in columns)).first()
    return rows.withColumns({c: (F.col(c) - row[f"a_{c}"]) / ((row[f"b_{c}"] - row[f"a_{c}"]) or 1.0) for c in columns})


def robust(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Less the median, by the interpolated quartile range."""
    row = rows.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns)).first()
    return rows.withColumns({c: (F.col(c) - row[c][1]) / ((row[c][2] - row[c][0]) or 1.0) for c in columns})


def one_hot(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column per known category; unknown values have none."""
    return rows.withColumns({f"{column}_{i}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for i, v in enumerate(categories)})


def group_split(rows: DataFrame, group: str, test_share: float, seed: int) -> DataFrame:
    """rows with is_test: whole groups are drawn by a seeded digest of the group, a share of the groups."""
    digest = F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(group).cast("string"))), 1, 8)
    return rows.withColumn("is_test", F.conv(digest, 16, 10).cast("double") / float(1 << 32) < test_share)


def fold(group: str, folds: int, seed: int) -> Column:
    return (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count groups of one size each fold gets if every group goes to the lightest fold, of equal ones the first.

    These are the count least of the loads + j * size, so nothing is done group by group.
    """
    low, high = min(loads), max(loads) + size * (count + 1)

    def given(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load in loads]  # groups that start below the level

    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(given(middle)) <= count else (low, middle)
    out = given(low)
    for k in sorted(range(len(loads)), key=lambda k: (loads[k] + out[k] * size, k))[: count - sum(out)]:
        out[k] += 1
    return out


def balanced_folds(rows: DataFrame, group: str, folds: int, out: str = "fold") -> DataFrame:
    """rows with the fold of their group: groups go, largest first, to the fold with the fewest rows so far. A null group is a group."""
    found = folded(rows.groupBy(group).agg(F.count("*").alias("_size")), group, folds, out).withColumnRenamed(group, "_group")
    return rows.join(found, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def folded(groups: DataFrame, group: str, folds: int, out: str) -> DataFrame:
    """The groups of groups(group, _size) with their fold.

    Groups of one size are alike, so the driver only deals a histogram of sizes (there are fewer sizes than the root of twice
    the rows); a group finds its fold by its number in the order of size and name.
    """
    spark = groups.sparkSession
    placed = numbered(groups.select(group, "_size"), [F.desc("_size"), F.col(group)], "_number")
    sizes = placed.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()
    loads, parts, at = [0] * folds, [], 0
    for s in sizes:
        for k, n in enumerate(dealt(loads, s["_size"], s["n"])):
            if n:
                parts.append((s["_size"], at, at + n, k))
                loads[k], at = loads[k] + n * s["_size"], at + n
    if not parts:
        return groups.select(group, F.lit(0).alias(out))
    table = spark.createDataFrame(parts, "_size long, _from long, _to long, _fold int")
    found = placed.join(F.broadcast(table), "_size").filter((F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_to")))  # a row for each size and fold
    return found.select(group, F.col("_fold").alias(out))


def ridge(rows: DataFrame, x: str, y: str, alpha: float) -> DataFrame:
    """Slope and intercept of one-feature ridge regression, from centred sums."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    sums = rows.agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n") + alpha)
    return sums.select(slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))


def regression_metrics(rows: DataFrame, actual: str, predicted: str, times: str | None = None) -> DataFrame:
    """r2 (0 for one row), mae, rmse and the sample deviation of the residuals, in one pass.

    times says how many equal rows a row stands for; a first pass then finds the means that squares are taken from.
    """
    e, y = F.col(actual) - F.col(predicted), F.col(actual)
    if times is not None:
        n, of = F.sum(times), lambda x: F.sum(F.when(x.isNotNull(), F.col(times)))
        mean = lambda x: F.sum(F.col(times) * x) / of(x)
        at = rows.agg(mean(y).alias("y"), mean(e).alias("e")).first()  # one row of means
        y, d = y - F.lit(at["y"]), e - F.lit(at["e"])
        r2 = F.when(n < 2, 0.0).otherwise(1 - F.sum(F.col(times) * e * e) / F.nullif(mean(y * y) * n, F.lit(0.0)))
        sd = F.sqrt(F.sum(F.col(times) * d * d) / F.nullif(of(d) - 1, F.lit(0.0)))
        return rows.agg(r2.alias("r2"), mean(F.abs(e)).alias("mae"), F.sqrt(mean(e * e)).alias("rmse"), sd.alias("residual_sd"))
    r2 = F.when(F.count("*") < 2, 0.0).otherwise(1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0)))
    return rows.agg(r2.alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_samp(e).alias("residual_sd"))


def weighted_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and precision, recall, F1 weighted by class size; a ratio with nothing below is 0."""
    a = rows.groupBy(F.col(actual).alias("c")).agg(F.count("*").alias("support"), F.count_if(F.col(actual) == F.col(predicted)).alias("hit"))
    p = rows.groupBy(F.col(predicted).alias("c")).agg(F.count("*").alias("said"))
    each = a.join(p, "c", "left").select("support", "hit", F.coalesce(F.col("hit") / F.col("said"), F.lit(0.0)).alias("p"), (F.col("hit") / F.col("support")).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    total = F.sum("support")
    return each.agg((F.sum("hit") / total).alias("accuracy"), (F.sum(F.col("p") * F.col("support")) / total).alias("precision"), (F.sum(F.col("r") * F.col("support")) / total).alias("recall"), (F.sum(f1 * F.col("support")) / total).alias("f1"))


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - p * F.log(F.greatest(p, F.lit(1e-12))))


def interval(y: Column, sd: Column) -> tuple[Column, Column]:
    return y - 1.96 * sd, y + 1.96 * sd


def objective(y: Column, goal: str, target: float | None = None) -> Column:
    """What to make small: -y, y or the squared distance to a target."""
    return {"maximise": -y, "minimise": y}.get(goal, (y - F.lit(target)) * (y - F.lit(target)))


ESTIMATORS = {
    "ridge": lambda y, seed: LinearRegression(labelCol=y, regParam=0.1, elasticNetParam=0.0, solver="normal"),
    "random_forest": lambda y, seed: RandomForestRegressor(labelCol=y, numTrees=20, maxDepth=6, seed=seed),
    "gradient_boosting": lambda y, seed: GBTRegressor(labelCol=y, maxIter=10, maxDepth=3, stepSize=0.1, seed=seed),
    "logistic": lambda y, seed: LogisticRegression(labelCol=y, maxIter=30),
    "random_forest_classifier": lambda y, seed: RandomForestClassifier(labelCol=y, numTrees=20, maxDepth=6, seed=seed),
    "gradient_boosting_classifier": lambda y, seed: OneVsRest(labelCol=y, classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=seed)),
}


#: Classifiers that want inputs of one scale; the second one also the number of inputs and of classes.
SCALED = {
    "linear_svc": lambda y, seed, n, classes: OneVsRest(labelCol=y, classifier=LinearSVC(maxIter=50, regParam=0.001)),
    "neural_classifier": lambda y, seed, n, classes: MultilayerPerceptronClassifier(labelCol=y, layers=[n, 16, classes], maxIter=150, seed=seed),
}


def trained(rows: DataFrame, inputs: list[str], y: str, code: str, seed: int = 42):
    """A fitted pipeline of an assembler and an estimator, with a scaler between them where the estimator wants one."""
    if code not in SCALED:
        return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), ESTIMATORS[code](y, seed)]).fit(rows)
    classes = int(rows.agg(F.max(y)).first()[0]) + 1
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="raw_features"), scaler, SCALED[code](y, seed, len(inputs), classes)]).fit(rows)


def candidates(spark, ranges: dict[str, tuple[float, float] | list], n: int, seed: int) -> DataFrame:
    """n settings, uniform in a range or drawn from a list, by a seeded digest of the row, the same on every run."""
    rows = spark.range(n).withColumnRenamed("id", "candidate")
    for k, r in ranges.items():
        u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"{seed}/{k}"), F.col("candidate").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
        rows = rows.withColumn(k, F.get(F.array(*map(F.lit, r)), F.floor(u * len(r)).cast("int")) if isinstance(r, list) else r[0] + u * (r[1] - r[0]))
    return rows


def best_candidates(predicted: DataFrame, score: Column, most: int) -> DataFrame:
    """The least scores with their rank; only so many rows are sorted at the end."""
    few = predicted.withColumn("score", score).orderBy("score", "candidate").limit(most)
    return few.withColumn("rank", F.row_number().over(Window.orderBy("score", "candidate")))


def _uniform(*parts: Column) -> Column:
    """A number above 0 and at most 1 by a digest of the parts, the same on every run."""
    key = F.md5(F.concat_ws("/", *(p.cast("string") for p in parts)))
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)


def augmented(rows: DataFrame, numeric: list[str], share: float, noise: float, seed: int) -> DataFrame:
    """rows and, marked, max(1, int(n * share)) of them drawn with replacement, numbers moved by normal noise.

    The noise of a column has ``noise`` of its sample deviation; null numbers stay null, other columns are those of the row
    drawn. Draws are digests of the seed and the draw's number over rows numbered by all their columns, so they are the same
    on every run; one join of draws with row numbers, whatever the share.
    """
    found = rows.agg(F.count("*").alias("_n"), *(F.stddev_samp(c).alias(c) for c in numeric)).first()
    n, spark = found["_n"], rows.sparkSession
    marked = rows.withColumn("is_augmented", F.lit(False))
    if not n:
        return marked
    draws = spark.range(max(1, int(n * share))).withColumn("_at", F.least(F.lit(n - 1), F.floor(_uniform(F.lit(seed), F.col("id")) * n)))
    more = numbered(rows, [F.col(c) for c in rows.columns], "_at").join(draws, "_at")
    for c in numeric:
        wide = noise * (found[c] or 0.0)
        normal = F.sqrt(-2 * F.log(_uniform(F.lit(f"{seed}/{c}/r"), F.col("id")))) * F.cos(2 * math.pi * _uniform(F.lit(f"{seed}/{c}/a"), F.col("id")))
        more = more.withColumn(c, F.col(c) + wide * normal)
    return marked.unionByName(more.select(*rows.columns, F.lit(True).alias("is_augmented")))


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, bin, low, n with min(20, max(5, n // 2)) equal bins from least to greatest; the last one is closed."""
    out = None
    for c in columns:
        bounds = rows.filter(F.col(c).isNotNull()).agg(F.min(c).alias("a"), F.max(c).alias("b"), F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.count("*") / 2))).alias("k")).withColumn("w", (F.col("b") - F.col("a")) / F.col("k"))
        at = F.least(F.floor((F.col(c) - F.col("a")) / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)), F.col("k") - 1)
        binned = rows.filter(F.col(c).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(F.lit(c).alias("column"), at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first(F.col("a")).alias("a"), F.first(F.col("w")).alias("w"))  # one row of bounds
        one = binned.select("column", "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of each two columns over rows that have both; 0 where it is undefined. All pairs in one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    def r(a: str, b: str) -> Column:
        v = F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
        return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
    row = rows.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs)).alias("m"))
    return row.select(F.inline("m"))
