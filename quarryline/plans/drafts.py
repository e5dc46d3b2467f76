"""Drafts of datasets: what they are built from, how they are changed, when they are frozen. Nations stand for versions, customers for rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import datasets as D
from ..session import table
from .catalogue import query

VERSIONS = "SELECT n_nationkey AS version_id, CASE WHEN n_nationkey % 5 = 0 THEN 'frozen' ELSE 'draft' END AS status FROM nation"
ROWS = "SELECT c_nationkey AS version_id, c_custkey AS row_id, c_custkey % 11 = 0 AS is_deleted FROM customer"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("version_id"), F.when(F.col("n_nationkey") % 5 == 0, "frozen").otherwise("draft").alias("status"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("version_id"), F.col("c_custkey").alias("row_id"), (F.col("c_custkey") % 11 == 0).alias("is_deleted"))


@query(
    "frozen_versions",
    rf"""WITH v AS ({VERSIONS}), r AS (SELECT * FROM ({ROWS}) WHERE NOT is_deleted),
c AS (SELECT c_nationkey AS version_id, c_custkey AS row_id, 'segment' AS field, c_mktsegment AS text, '\N' AS number FROM customer UNION ALL SELECT c_nationkey, c_custkey, 'balance', '\N', printf('%d.000000', c_custkey * 3) FROM customer WHERE c_custkey % 97 <> 0),
l AS (SELECT c.* FROM c SEMI JOIN r USING (version_id, row_id)),
i AS (SELECT version_id, count_if(row_id % 97 = 0) + count_if(row_id % 97 <> 0 AND row_id % 89 = 0) AS n FROM r GROUP BY version_id),
h AS (SELECT version_id, sha256(concat_ws(chr(31), row_id, field, text, number)) AS h FROM l), p AS (SELECT version_id, left(h, 3) AS part, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL),
s AS (SELECT version_id, sha256(string_agg(h, '' ORDER BY part)) AS h FROM p GROUP BY ALL), k AS (SELECT version_id, count(*) AS n FROM r GROUP BY ALL),
o AS (SELECT v.*, coalesce(i.n, 0) AS issue_count, coalesce(k.n, 0) AS row_count, 3::BIGINT AS field_count, coalesce(s.h, sha256('')) AS h FROM v LEFT JOIN i USING (version_id) LEFT JOIN k USING (version_id) LEFT JOIN s USING (version_id))
SELECT version_id, CASE WHEN status = 'draft' AND issue_count = 0 THEN 'frozen' ELSE status END AS status, CASE WHEN status <> 'draft' THEN 'dataset_not_freezable' WHEN issue_count > 0 THEN 'dataset_freeze_validation_failed' END AS code,
  issue_count::BIGINT AS issue_count, row_count, field_count, CASE WHEN status = 'draft' AND issue_count = 0 THEN h END AS content_hash FROM o""",
)
def frozen_versions(spark: SparkSession, d: str) -> DataFrame:
    versions, c = _versions(spark, d), table(spark, d, "customer")
    names = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(r).alias("is_required")) for n, r in (("segment", True), ("balance", True), ("note", False))))
    fields = versions.select("version_id", F.inline(names))
    key = [F.col("c_nationkey").alias("version_id"), F.col("c_custkey").alias("row_id")]
    text = c.select(*key, F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value_text"), F.lit(None).cast("double").alias("value_number"), F.lit(False).alias("is_missing"), F.lit("confirmed").alias("review_status"))
    number = c.filter("c_custkey % 97 != 0").select(*key, F.lit("balance").alias("field"), F.lit(None).cast("string").alias("value_text"), (F.col("c_custkey") * 3).cast("double").alias("value_number"), F.lit(False).alias("is_missing"), F.when(F.col("c_custkey") % 89 == 0, "doubtful").otherwise("pending").alias("review_status"))
    return D.frozen(versions, _rows(spark, d), fields, text.unionByName(number))


@query(
    "draft_edits",
    f"""WITH v AS ({VERSIONS}), e AS (SELECT o_custkey % 27 AS version_id, o_custkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN 'colour' ELSE 'segment' END AS field, o_orderkey AS edit FROM orders)
SELECT edit, CASE WHEN status IS NULL THEN 'dataset_version_not_found' WHEN status <> 'draft' THEN 'dataset_immutable' WHEN r.row_id IS NULL THEN 'dataset_row_not_found' WHEN field = 'colour' THEN 'dataset_field_not_found' END AS code
FROM e LEFT JOIN v USING (version_id) LEFT JOIN ({ROWS}) r USING (version_id, row_id)""",
)
def draft_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every edit of a cell with the reason for which it is refused."""
    versions = _versions(spark, d)
    edits = table(spark, d, "orders").select((F.col("o_custkey") % 27).alias("version_id"), F.col("o_custkey").alias("row_id"), F.when(F.col("o_orderkey") % 7 == 0, "colour").otherwise("segment").alias("field"), F.col("o_orderkey").alias("edit"))
    return D.judged(edits, versions, _rows(spark, d), versions.select("version_id", F.lit("segment").alias("field"))).select("edit", "code")


NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY row_id) AS row_no FROM ({ROWS})"


@query(
    "draft_rows",
    f"""WITH r AS ({NUMBERED}), v AS ({VERSIONS}), n AS (SELECT version_id, max(row_no) AS last FROM r GROUP BY version_id),
a AS (SELECT s_nationkey AS version_id, -1 - s_suppkey AS row_id FROM supplier)
SELECT version_id, row_id, row_no::BIGINT AS row_no, CASE WHEN row_id % 13 = 0 AND status = 'draft' THEN 'deleted' ELSE 'confirmed' END AS review_status, is_deleted OR (row_id % 13 = 0 AND status = 'draft') AS is_deleted FROM r JOIN v USING (version_id)
UNION ALL SELECT version_id, row_id, coalesce(last, 0) + row_number() OVER (PARTITION BY version_id ORDER BY row_id), 'pending', false FROM a JOIN v USING (version_id) LEFT JOIN n USING (version_id) WHERE status = 'draft'""",
)
def draft_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all versions after some were deleted and others added, where the version is a draft."""
    versions = _versions(spark, d)
    rows = _rows(spark, d).withColumn("row_no", F.row_number().over(Window.partitionBy("version_id").orderBy("row_id")).cast("long")).withColumn("review_status", F.lit("confirmed"))
    gone = D.judged(rows.filter("row_id % 13 = 0").select("version_id", "row_id"), versions)
    new = D.judged(table(spark, d, "supplier").select(F.col("s_nationkey").alias("version_id"), (-1 - F.col("s_suppkey")).alias("row_id")), versions)
    return D.with_added_rows(D.with_deleted_rows(rows, gone), new).select("version_id", "row_id", "row_no", "review_status", "is_deleted")


@query(
    "dataset_of_reviewed",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_linenumber % 4 <> 3)
SELECT l_orderkey AS row_key, row_number() OVER (ORDER BY l_orderkey) AS row_no, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS quantity FROM r GROUP BY l_orderkey""",
)
def dataset_of_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each row among those whose review lets them in."""
    states = F.get(F.array(*map(F.lit, ("pending", "confirmed", "modified", "rejected"))), F.col("l_linenumber") % 4)
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_key"), F.lit("quantity").alias("field"), F.col("l_quantity").alias("value"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), states.alias("review_status"))
    kept = D.reviewed(line)
    rows = D.numbered(kept.groupBy("row_key").agg(F.min("row_key").alias("first_ord")), "first_ord").select("row_key", "row_no")
    return rows.join(D.first_records(kept).select("row_key", F.col("value").alias("quantity")), "row_key", "left")
