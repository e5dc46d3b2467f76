"""Extraction over blocks, table rows and figures made from orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import values as V
from ..session import table
from .catalogue import query
from .datasets import NUMBERS, PARSED

#: The same expressions make the tables in Spark and in DuckDB.
CONTENT = "CASE o_orderkey % 4 WHEN 0 THEN concat('yield ', o_orderkey % 50, ' ± 0.5 mg/L') WHEN 1 THEN concat('treatment: A', o_orderkey % 7, ' after ', o_orderkey % 48, ' h') WHEN 2 THEN concat('acid ', o_orderkey % 9, '.5 g/L at 37°C, output ', o_orderkey % 11, ' %') ELSE '' END"
BLOCKS = f"SELECT o_custkey AS version_id, o_custkey * 10 + o_orderkey % 3 AS page_id, CAST(o_orderkey % 3 AS INTEGER) AS page_no, o_orderkey AS block_id, o_orderkey AS sequence_no, {CONTENT} AS content FROM orders"
CELL = "SELECT p_size AS version_id, CAST(p_size * 10 AS BIGINT) AS page_id, 0 AS page_no, CAST(floor(p_partkey / 3) AS BIGINT) AS table_id, CASE WHEN p_size % 2 = 0 THEN concat('Table ', p_size) END AS title, CASE WHEN p_size % 3 = 0 THEN 'group: C1' END AS caption, p_partkey * 2 + {c} AS table_cell_id, CAST(p_partkey % 3 AS INTEGER) AS row, {c} AS column_no, CASE WHEN p_partkey % 3 = 0 THEN 'header' ELSE 'data' END AS role, CASE WHEN p_partkey % 3 = 0 THEN '{h}' WHEN p_size % 5 = {c} THEN ' ' ELSE concat(p_partkey % 90, '.{c} mg/g') END AS text, '{h}' AS head FROM part"
CELLS = f"{CELL.format(c=0, h='yield')} UNION ALL {CELL.format(c=1, h='acid')}"
FIGURES = "SELECT s_nationkey AS version_id, CAST(s_nationkey AS BIGINT) AS page_id, 0 AS page_no, s_suppkey AS figure_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Yield over time' END AS title, 'Figure' AS caption, CASE WHEN s_suppkey % 3 = 0 THEN 0.8 END AS confidence, s_name AS label, concat('yield ', s_suppkey % 100, '.5') AS first_value, CASE WHEN s_suppkey % 2 = 0 THEN 0.98 ELSE 0.0 END AS first_confidence FROM supplier"
FIELDS = [X.Field("yield", ("yield", "output"), 1), X.Field("acid", ("acid",)), X.Field("none", ("",))]


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    for name in ("orders", "part", "supplier"):
        table(spark, d, name).createOrReplaceTempView(f"_{name}")
    blocks, cells, figures = (spark.sql(q.replace(f"FROM {n}", f"FROM _{n}")) for q, n in ((BLOCKS, "orders"), (CELLS, "part"), (FIGURES, "supplier")))
    cells = cells.withColumnRenamed("column_no", "column").withColumn("header_path", F.array("head")).drop("head")
    direct = F.array(F.struct(F.col("first_value").alias("text"), F.col("first_confidence").cast("double").alias("confidence")), F.struct(F.lit("7 %").alias("text"), F.lit(None).cast("double").alias("confidence")))
    figures = figures.select("version_id", "page_id", "page_no", "figure_id", "title", "caption", F.col("confidence").cast("double").alias("confidence"), F.array(F.lit("Acid"), F.lit("10"), F.col("label")).alias("labels"), direct.alias("direct_values"))
    return blocks, cells, figures


BLOCK_SQL = f"""SELECT version_id, 'text' AS kind, concat('block=', block_id, ':page=', page_no) AS source_key, concat_ws(chr(10), nullif(lag(content) OVER w, ''), nullif(content, ''), nullif(lead(content) OVER w, '')) AS text, content AS evidence, 0.85::DOUBLE AS confidence FROM ({BLOCKS}) WINDOW w AS (PARTITION BY version_id, page_id ORDER BY sequence_no)"""
TABLE_SQL = f"""SELECT version_id, 'table' AS kind, concat('table=', table_id, ':row=', row) AS source_key, concat_ws(' | ', title, caption, nullif(segments, '')) AS text, segments AS evidence, 0.9::DOUBLE AS confidence FROM (SELECT version_id, table_id, row, title, caption, bool_and(role = 'header') AS head, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN concat(head, ': ', trim(text)) END, ' | ' ORDER BY column_no, table_cell_id), '') AS segments FROM ({CELLS}) GROUP BY version_id, page_id, page_no, table_id, title, caption, row) WHERE NOT head"""
FIGURE_SQL = f"""SELECT version_id, 'figure' AS kind, concat('figure=', figure_id, ':value=', k) AS source_key, concat(concat_ws(' | ', title, caption, concat('Acid | ', label)), ' | ', CASE k WHEN 1 THEN first_value ELSE '7 %' END) AS text, CASE k WHEN 1 THEN first_value ELSE '7 %' END AS evidence, coalesce(nullif(CASE k WHEN 1 THEN first_confidence END, 0.0), nullif(confidence, 0.0), 0.7)::DOUBLE AS confidence FROM ({FIGURES}), (VALUES (1), (2)) v(k)"""
CONTEXTS = f"{BLOCK_SQL} UNION ALL {TABLE_SQL} UNION ALL {FIGURE_SQL}"


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    blocks, cells, figures = _tables(spark, d)
    return X.block_contexts(blocks).unionByName(X.table_contexts(cells)).unionByName(X.figure_contexts(figures))


@query("extraction_contexts", f"SELECT version_id, kind, source_key, sha256(text) AS text_sha256, evidence, confidence FROM ({CONTEXTS})")
def extraction_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d).select("version_id", "kind", "source_key", F.sha2("text", 256).alias("text_sha256"), "evidence", "confidence")


def _found(field: str, names: str) -> str:
    whole = rf"(?i)(?:{names}).{{0,50}}?{V.VALUE_UNIT}"
    return f"SELECT version_id, kind, source_key, text, confidence, '{field}' AS field, unnest(range(1, len(regexp_extract_all(text, '{whole}')) + 1))::INTEGER AS match_no, unnest(regexp_extract_all(text, '{whole}', 1)) AS raw, nullif(unnest(regexp_extract_all(text, '{whole}', 2)), '') AS raw_unit FROM c"


RECORDS = f"""WITH c AS ({CONTEXTS}), m AS ({_found("yield", "output|yield")} UNION ALL {_found("acid", "acid")}),
n AS (SELECT *, {NUMBERS} AS n, nullif(concat(regexp_extract(text, '(?i){V.TIMEPOINT}', 1), regexp_extract(text, '(?i){V.TIMEPOINT}', 2)), '') AS timepoint, coalesce(nullif(regexp_extract(text, '(?i){V.TREATMENT}', 1), ''), 'unspecified') AS treatment FROM m),
k AS (SELECT *, {PARSED} AS value_type, concat(source_key, ':treatment=', treatment, ':time=', coalesce(timepoint, 'unspecified')) AS group_key FROM n)
SELECT kind, field, match_no, raw AS raw_value, raw_unit, value_type, CASE value_type WHEN 'range' THEN (n[1] + n[2]) / 2 ELSE n[1] END AS number, group_key, timepoint, left(concat_ws(':', version_id, group_key, field, match_no), 255) AS sample_key, confidence FROM k"""


@query("extract_contexts", RECORDS)
def extract_contexts(spark: SparkSession, d: str) -> DataFrame:
    found = X.run("frozen", _contexts(spark, d), FIELDS)
    return found.select("kind", "field", "match_no", "raw_value", "raw_unit", "value_type", "number", "group_key", "timepoint", "sample_key", "confidence")


@query(
    "extract_included",
    f"""WITH h AS (SELECT o_orderkey AS block_id, p_table AS table_id, NULL::BIGINT AS figure_id, o_orderkey % 2 = 0 AS is_included FROM (SELECT o_orderkey, o_orderkey % 20 AS p_table FROM orders) UNION ALL SELECT NULL, NULL, s_suppkey, s_suppkey % 5 = 0 FROM supplier),
b AS (SELECT 'text' AS kind, count(*) AS n FROM ({BLOCKS}) b WHERE EXISTS (SELECT 1 FROM h WHERE is_included AND h.block_id = b.block_id)), t AS (SELECT 'table' AS kind, count(*) AS n FROM ({CELLS}) t WHERE EXISTS (SELECT 1 FROM h WHERE is_included AND h.table_id = t.table_id)), f AS (SELECT 'figure' AS kind, count(*) AS n FROM ({FIGURES}) f WHERE EXISTS (SELECT 1 FROM h WHERE is_included AND h.figure_id = f.figure_id))
FROM b UNION ALL FROM t UNION ALL FROM f""",
)
def extract_included(spark: SparkSession, d: str) -> DataFrame:
    """How many blocks, cells and figures an extraction restricted to the included hits of a search reads."""
    blocks, cells, figures = _tables(spark, d)
    none = F.lit(None).cast("long")
    k = F.col("o_orderkey")
    hits = table(spark, d, "orders").select(k.alias("block_id"), (k % 20).alias("table_id"), none.alias("figure_id"), (k % 2 == 0).alias("is_included")).union(table(spark, d, "supplier").select(none, none, F.col("s_suppkey").cast("long"), F.col("s_suppkey") % 5 == 0))
    parts = [X.included(rows, key, hits).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for rows, key, kind in ((blocks, "block_id", "text"), (cells, "table_id", "table"), (figures, "figure_id", "figure"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


UNITS = "(VALUES (1, 'mg/L'), (2, 'g/L'), (3, 'mg/g'), (4, '%')) u(unit_id, token)"


@query(
    "normalise_values",
    f"""WITH r AS (SELECT * FROM ({RECORDS}) WHERE field = 'yield' AND value_type IN ('number', 'mean_sd')), s AS (SELECT r.*, unit_id FROM r LEFT JOIN {UNITS} ON lower(raw_unit) = lower(token))
SELECT sample_key, unit_id AS source, CASE unit_id WHEN 3 THEN 31 WHEN 4 THEN 41 END AS rule_id, CASE WHEN unit_id IN (1, 4) THEN 'applied' WHEN unit_id = 3 THEN 'pending' END AS status, CASE unit_id WHEN 1 THEN number WHEN 3 THEN number * 2 + 1 WHEN 4 THEN number * 10 END AS target, CASE unit_id WHEN 1 THEN number WHEN 4 THEN number * 10 END AS normalised FROM s""",
)
def normalise_values(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame([(1, "mg_l", "mg/L", "milligram", None), (2, "g_l", "g/L", "gram", None), (3, "mg_g", "mg/g", "share", None), (4, "pct", "%", "percent", None)], "unit_id int, code string, symbol string, name string, aliases array<string>")
    rules = spark.createDataFrame([(31, 3, 1, 2.0, 1.0, None, 2, True, True), (30, 3, 1, 9.0, 9.0, None, 1, True, False), (41, 4, 1, 10.0, None, "mine", 1, True, False), (40, 4, 1, 5.0, 0.0, None, 7, True, False), (21, 2, 1, None, None, None, 1, True, False)], "rule_id int, source int, target int, multiplier double, offset double, org string, version int, active boolean, confirm boolean")
    records = X.run("frozen", _contexts(spark, d), FIELDS).filter("field = 'yield' and value_type in ('number', 'mean_sd')")
    out = V.normalised_values(records, F.broadcast(units), F.broadcast(rules), "mine")  # a handful of rows each
    return out.select("sample_key", "source", "rule_id", "status", V.main_number(F.col("target_value")).alias("target"), V.main_number(F.col("normalised")).alias("normalised"))
