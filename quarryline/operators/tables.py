"""Relational operators that recur in the plans: latest rows, first wins, replacement, paging, tallies, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that should be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old with rows of new in place of those of the same key, and new keys added."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, by, F.desc("_new")).drop("_new")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without any row of the keys that new has, plus new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def truncated(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows, and whether there are more: one row beyond the limit is probed, nothing is counted."""
    probe = rows.orderBy(*order).limit(most + 1)
    more = probe.groupBy().agg((F.count("*") > most).alias("more"))
    return probe.orderBy(*order).limit(most).crossJoin(F.broadcast(more))  # one row


def zero_filled(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of each value of a fixed domain, 0 where there is none."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(values).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that break uniqueness."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose immutable columns differ, null-safe."""
    pair = old.select(key, *(F.col(c).alias(f"_{c}") for c in columns)).join(new, key)
    different = F.lit(False)
    for c in columns:
        different = different | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return pair.filter(different).select(key)


def file_tally(files: DataFrame, kept: DataFrame) -> DataFrame:
    """sha256, copies, status of incoming contents: created, or duplicate of a kept one; further copies are duplicates too."""
    digests = files.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("file_id").alias("first_id"))
    return digests.join(kept.select("sha256", F.lit(True).alias("_kept")).distinct(), "sha256", "left").select("sha256", "copies", "first_id", F.when(F.col("_kept"), "duplicate").otherwise("created").alias("status"))


def version_chain(files: DataFrame, by: list[str], name: Column, *order: Column) -> DataFrame:
    """version_no of each file among those of its (case-folded) name."""
    return files.withColumn("version_no", F.row_number().over(Window.partitionBy(*by, F.lower(name)).orderBy(*order)))


def nearest_above(items: DataFrame, texts: DataFrame, most: float) -> DataFrame:
    """item_id, text: of texts on the item's page that overlap it sideways and end at most so far above, the nearest."""
    i, t = items.alias("i"), texts.alias("t")
    gap = F.col("i.y0") - F.col("t.y1")
    overlap = F.least("i.x1", "t.x1") - F.greatest("i.x0", "t.x0")
    pairs = i.join(t, (F.col("i.page") == F.col("t.page")) & (overlap > 0) & gap.between(0, most))
    return pairs.groupBy("i.item_id").agg(F.min_by(F.struct("t.text_id", gap.alias("gap")), F.struct(gap, "t.text_id")).alias("best")).select("item_id", "best.text_id", "best.gap")


def filled_down(rows: DataFrame, column: str, by: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def visible(projects: DataFrame, members: DataFrame, org_members: DataFrame, user: int) -> DataFrame:
    """Projects that a user sees as a member, or as owner or admin of the organisation; with the stronger role."""
    own = members.filter(F.col("user_id") == user).select("project_id", F.col("role").alias("project_role"))
    org = org_members.filter(F.col("user_id") == user).select("org_id", F.col("role").alias("org_role"))
    both = projects.join(own, "project_id", "left").join(org, "org_id", "left")
    strong = F.col("org_role").isin("owner", "admin")
    return both.filter(F.col("project_role").isNotNull() | strong).withColumn("role", F.when(strong, F.lit("owner")).otherwise(F.col("project_role"))).dropDuplicates(["project_id"])


def appended(rows: DataFrame, path: str, *by: str) -> None:
    """Rows added to a Parquet table, partitioned by these columns."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def overwritten(rows: DataFrame, path: str, *by: str) -> None:
    """The partitions that rows name replaced by them; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def updated(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """rows with columns set where a condition holds (a null condition changes nothing)."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})
