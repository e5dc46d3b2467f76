"""Row numbers in a global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(df: DataFrame, order: list[str | Column], out: str, first: int = 0) -> DataFrame:
    """df with each row's number in the given order, which should be total, in one more column.

    Rows are range-partitioned, each partition is sorted and materialised, and a number is a row's place in its partition plus
    the sizes of those before. Only one size for each partition reaches the driver.
    """
    spark = df.sparkSession
    spread = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = checkpointed(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, first
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if not starts:
        return placed.select(*df.columns, F.lit(first).cast("long").alias(out))
    table = spark.createDataFrame(list(starts.items()), "_p int, _start long")  # a row for each partition
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", part).join(F.broadcast(table), "_p").select(*df.columns, number.alias(out))


def at_share(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """by, value: of each group's non-null values in order the one at index int(n * share) - 1, the first at least.

    The groups are ordered together by (group, value), so that a group of any size is spread over the cluster.
    """
    known = rows.filter(F.col(value).isNotNull()).select(by, value)
    placed = numbered(known, [by, value], "_number")
    starts = placed.groupBy(by).agg(F.min("_number").alias("_first"), F.count("*").alias("_n"))
    wanted = starts.select(F.col(by).alias("_by"), (F.col("_first") + F.greatest(F.lit(0), F.floor(F.col("_n") * share) - 1)).alias("_number"))
    return placed.join(wanted, "_number").select(by, value)
