"""Sheets and the evaluation of all sections, over rows made from orders, customers, parts, lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import exports as P
from ..operators import search as S
from ..session import table
from .catalogue import query
from .evidence import AND, BLOCKS, OR, _match, _names

#: The same expressions make the tables in Spark and in DuckDB.
ROWS = """SELECT o_orderkey AS row_id, CASE o_orderkey % 4 WHEN 0 THEN concat('{"treatment":"T', o_orderkey % 9, '"}') WHEN 1 THEN '{"treatment":"","variety":"V"}' ELSE '{}' END AS row_metadata, CASE WHEN o_orderkey % 3 = 0 THEN '{"variety":"W","material":"soil"}' ELSE '{"location":"field"}' END AS document_metadata,
 concat('block=', o_custkey, ':treatment=', CASE WHEN o_orderkey % 5 = 0 THEN 'K' ELSE 'unspecified' END, ':time=24h:y:1') AS sample_key, CASE WHEN o_orderkey % 6 <> 0 THEN concat('f', o_custkey, '.pdf') END AS filename, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS date, CAST(o_orderkey % 3 * 1000 AS INTEGER) AS year, CAST(NULL AS VARCHAR(9)) AS publication, o_orderstatus AS review_status FROM orders"""
BASE = """row_id, coalesce(nullif(filename, ''), '——') AS filename, coalesce(nullif(title, ''), '——') AS title, coalesce(date::VARCHAR, nullif(year, 0)::VARCHAR, '——') AS published, '——' AS publication,
 coalesce(nullif(json_extract_string(row_metadata, '$.treatment'), ''), nullif(json_extract_string(row_metadata, '$.variety'), ''), nullif(regexp_extract(sample_key, 'treatment=([^:]+)', 1), ''), '——') AS treatment, coalesce(nullif(json_extract_string(document_metadata, '$.location'), ''), nullif(json_extract_string(document_metadata, '$.material'), ''), '——') AS location, '24h' AS timepoint, coalesce(nullif(review_status, ''), '——') AS review_status"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("_orders")
    return spark.sql(ROWS.replace("FROM orders", "FROM _orders"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    null = {c: F.lit(None).cast(t) for c, t in (("raw_value", "string"), ("value_number", "double"), ("value_boolean", "boolean"), ("value_date", "date"), ("value_text", "string"), ("normalized_value", "string"), ("ml_value", "string"))}
    price = null | {"raw_value": F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("about "), k.cast("string"))), "value_number": F.when(k % 3 > 0, (k % 100).cast("double")), "value_text": F.when(k % 2 == 0, F.lit("few"))}
    other = null | {"value_boolean": F.when(k % 5 == 0, k % 2 == 0), "value_date": F.when(k % 5 == 1, F.lit("2024-02-03").cast("date")), "value_text": F.when(k % 5 == 2, F.lit("t")), "normalized_value": F.when(k % 5 == 3, F.lit('{"value":7}')).when(k % 5 == 4, F.lit("{}")), "ml_value": F.when(k % 5 == 4, F.lit('{"min":1,"max":2}'))}
    one = [o.filter(keep).select(k.alias("row_id"), F.lit(f).alias("field"), *(v.alias(c) for c, v in values.items())) for f, values, keep in (("price", price, k % 10 != 9), ("other", other, k % 10 != 8))]
    return one[0].unionByName(one[1])


@query(
    "export_dataset_main",
    f"""SELECT {BASE}, CASE WHEN row_id % 10 = 9 THEN '——' WHEN row_id % 4 = 0 THEN '' WHEN row_id % 4 = 1 THEN concat('about ', row_id) WHEN row_id % 3 > 0 THEN (row_id % 100)::DOUBLE::VARCHAR WHEN row_id % 2 = 0 THEN 'few' ELSE '——' END AS price, CASE WHEN row_id % 5 = 2 AND row_id % 10 <> 8 THEN 't' ELSE '——' END AS other FROM ({ROWS})""",
)
def export_dataset_main(spark: SparkSession, d: str) -> DataFrame:
    return P.dataset_sheet(_rows(spark, d), _cells(spark, d), ["price", "other"], "raw")


@query(
    "export_dataset_ml",
    f"""SELECT {BASE}, CASE WHEN row_id % 10 = 9 THEN '' WHEN row_id % 3 > 0 THEN (row_id % 100)::DOUBLE::VARCHAR WHEN row_id % 2 = 0 THEN 'few' ELSE '' END AS price,
 CASE WHEN row_id % 10 = 8 THEN '' ELSE CASE row_id % 5 WHEN 0 THEN (row_id % 2 = 0)::VARCHAR WHEN 1 THEN '2024-02-03' WHEN 2 THEN 't' WHEN 3 THEN '7' ELSE '{{"min":1,"max":2}}' END END AS other FROM ({ROWS})""",
)
def export_dataset_ml(spark: SparkSession, d: str) -> DataFrame:
    return P.dataset_sheet(_rows(spark, d), _cells(spark, d), ["price", "other"], "ml")


def _dictionary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    terms = part.select(k.alias("term_id"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), F.when(k % 3 == 0, "confirmed").otherwise("candidate").alias("status"), (k % 5 == 0).alias("is_selected"), (k % 7 == 0).alias("deleted"), (k % 30).alias("category_id"), (k % 40).alias("unit_id"))
    categories = table(spark, d, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"))
    aliases = part.filter(k % 4 != 0).select(k.alias("term_id"), F.explode(F.array("p_type", "p_brand", F.lit(""))).alias("alias"))
    units = table(spark, d, "region").select(F.col("r_regionkey").alias("unit_id"), F.col("r_name").alias("symbol"))
    return terms, categories, aliases, units


ALIASES = "CASE WHEN p_partkey % 4 = 0 THEN '——' ELSE concat(least(p_type, p_brand), '、', greatest(p_type, p_brand)) END"


@query("export_token_dictionary", f"SELECT p_name || ' ' || p_partkey AS name, coalesce(n_name, '——') AS category, {ALIASES} AS aliases, coalesce(r_name, '——') AS unit, CASE WHEN p_partkey % 3 = 0 THEN 'confirmed' ELSE 'candidate' END AS status FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30 LEFT JOIN region ON r_regionkey = p_partkey % 40 WHERE p_partkey % 7 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0)")
def export_token_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return P.token_dictionary(*_dictionary(spark, d))


@query("export_token_candidates", f"""WITH o AS (SELECT l_partkey, sum(l_quantity::BIGINT) AS n, count(DISTINCT l_orderkey) AS docs, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS example FROM lineitem GROUP BY l_partkey)
SELECT p_name || ' ' || p_partkey AS name, coalesce(n_name, '——') AS category, coalesce(n, 0)::BIGINT AS occurrences, coalesce(docs, 0) AS documents, {ALIASES} AS aliases, coalesce(example, '——') AS example, CASE WHEN p_partkey % 3 = 0 THEN 'confirmed' ELSE 'candidate' END AS status FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30 LEFT JOIN o ON l_partkey = p_partkey WHERE p_partkey % 7 <> 0""")
def export_token_candidates(spark: SparkSession, d: str) -> DataFrame:
    terms, categories, aliases, _ = _dictionary(spark, d)
    found = table(spark, d, "lineitem").select(F.col("l_partkey").alias("term_id"), F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_returnflag").alias("place"), F.col("l_quantity").cast("long").alias("n"), F.col("l_returnflag").alias("context"))
    return P.candidate_sheet(terms, categories, found, aliases)


@query("export_traceability", "SELECT c_name AS row_key, o_orderpriority AS field, o_orderstatus AS raw_value, n_regionkey AS page_no, l_returnflag AS evidence_text FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = l_suppkey % 25")
def export_traceability(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("row_key"))
    cells = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("row_id"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("raw_value"))
    evidence = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), (F.col("l_suppkey") % 25).alias("page_id"), F.col("l_returnflag").alias("evidence_text"))
    return P.traceability(rows, cells, evidence, table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), F.col("n_regionkey").alias("page_no")))


@query("export_conversions", "SELECT o_orderkey::VARCHAR AS source_value, coalesce(s.r_name, CASE WHEN o_orderkey % 2 = 0 THEN 'raw' END, '——') AS source_unit, o_custkey::VARCHAR AS target_value, coalesce(t.r_name, '——') AS target_unit, 'x * ' || o_orderkey % 5 AS formula, o_orderstatus AS status, '——' AS created_at FROM orders LEFT JOIN region s ON s.r_regionkey = o_orderkey % 8 LEFT JOIN region t ON t.r_regionkey = o_custkey % 7")
def export_conversions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.cast("string").alias("source_value"), (k % 8).alias("source_unit_id"), F.when(k % 2 == 0, "raw").otherwise("").alias("source_unit_text"), F.col("o_custkey").cast("string").alias("target_value"), (F.col("o_custkey") % 7).alias("target_unit_id"), F.concat(F.lit("x * "), (k % 5).cast("string")).alias("formula"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("timestamp").alias("created_at"))
    return P.conversion_sheet(rows, table(spark, d, "region").select(F.col("r_regionkey").alias("unit_id"), F.col("r_name").alias("symbol")))


@query("export_audit", "SELECT strftime(ts, '%Y-%m-%d') AS created_at, event_type AS action, '——' AS entity_type, event_id::VARCHAR AS entity_id, coalesce(c_name, user_id::VARCHAR) AS actor, CASE WHEN event_id % 2 = 0 THEN 'why' ELSE coalesce(props, '') END AS summary FROM (SELECT * FROM events ORDER BY ts::DATE DESC, event_id DESC LIMIT 5000) LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0")
def export_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    logs = table(spark, d, "events").select(k.alias("log_id"), F.col("ts").cast("date").alias("created_at"), F.col("event_type").alias("action"), F.lit("").alias("entity_type"), k.alias("entity_id"), F.col("user_id").alias("actor_id"), F.when(k % 2 == 0, "why").alias("reason"), F.col("props").alias("after"))
    users = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("actor_id"), F.col("c_name").alias("name"))
    return P.audit_sheet(logs, users)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(k % 4 != 0, F.concat(F.lit("Doc "), k.cast("string"))).alias("title"), F.when(k % 2 == 0, F.array(F.lit("A"), F.col("lang"))).alias("authors"), F.lit(None).cast("date").alias("date"), (k % 3 * 700).cast("int").alias("year"), F.col("source").alias("publication"), F.when(k % 5 == 0, F.lit('{"treatment":"X"}')).alias("metadata"), F.concat(k.cast("string"), F.lit(".txt")).alias("filename"))


@query("export_found_documents", f"""WITH {BLOCKS}, hits AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, page_no, sequence_no) AS result_no FROM blocks WHERE {" OR ".join(_match("content", OR))}), f AS (SELECT doc_id, min(result_no) AS order_no FROM hits GROUP BY doc_id)
SELECT order_no, doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'Doc ' || doc_id ELSE '——' END AS title, CASE WHEN doc_id % 2 = 0 THEN concat_ws('、', 'A', lang) ELSE '——' END AS authors, coalesce(nullif(doc_id % 3 * 700, 0)::VARCHAR, '——') AS published, coalesce(nullif(source, ''), '——') AS publication, CASE WHEN doc_id % 5 = 0 THEN 'X' ELSE '——' END AS treatment, '——' AS location, doc_id || '.txt' AS filename FROM f JOIN documents USING (doc_id)""")
def export_found_documents(spark: SparkSession, d: str) -> DataFrame:
    hits = S.search(S.blocks(table(spark, d, "documents")), OR, "or")
    return P.found_documents(hits, _documents(spark, d))


@query("export_hits", f"""WITH {BLOCKS}, near AS (SELECT *, lag(content) OVER w AS previous, lead(content) OVER w AS next FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, sequence_no)), hits AS (SELECT *, row_number() OVER (ORDER BY doc_id, page_no, sequence_no) AS result_no FROM near WHERE {" AND ".join(_match("content", AND))})
SELECT result_no, doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'Doc ' || doc_id ELSE '——' END AS title, {_names("content", AND)} AS terms, 'text' AS evidence_type, page_no, coalesce(previous, '') AS previous, content, coalesce(next, '') AS next, concat_ws(' ', previous, content, next) AS evidence, CASE WHEN result_no % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS review_status FROM hits""")
def export_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = S.search(S.blocks(table(spark, d, "documents")), AND, "and")
    said = hits.filter("result_no % 2 = 0").select("result_no", F.lit(True).alias("is_included"), F.lit("confirmed").alias("review_status"))
    return P.hit_sheet(S.reviewed(hits, said), _documents(spark, d))


@query("export_structured", f"""WITH {BLOCKS}, hits AS (SELECT DISTINCT doc_id FROM blocks WHERE {" OR ".join(_match("content", OR))}) SELECT 'table' AS kind, o_orderkey::VARCHAR AS number, '——' AS title, o_orderpriority AS caption, left(repeat(o_orderstatus, (o_orderkey % 3000)::INTEGER), 2000) AS structured, o_orderkey AS page_no, CASE WHEN o_custkey % 4 <> 0 THEN 'Doc ' || o_custkey ELSE '——' END AS document FROM orders JOIN hits ON doc_id = o_custkey""")
def export_structured(spark: SparkSession, d: str) -> DataFrame:
    hits = S.scored(S.blocks(table(spark, d, "documents")), OR, "or")
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("table").alias("kind"), F.col("o_orderkey").alias("number"), F.lit("").alias("title"), F.col("o_orderpriority").alias("caption"), F.repeat("o_orderstatus", (F.col("o_orderkey") % 3000).cast("int")).alias("structured"), F.col("o_orderkey").alias("page_no"))
    return P.structured_sheet(hits, items, _documents(spark, d))


def _gold(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    i, price = k.cast("string").alias("id"), F.col("o_totalprice")
    cells = F.array(F.array(F.lit("a"), F.col("o_orderstatus")))
    none = F.lit(None).cast("array<string>")
    expected = {
        "documents": o.select(i),
        "fields": o.select(i, F.col("o_orderpriority").alias("value")),
        "numbers": o.select(i, price.alias("value"), F.lit("mg / L").alias("unit"), F.lit(1.0).alias("tolerance"), F.when(k % 10 == 4, -0.1).otherwise(0.01).alias("relative_tolerance")),
        "associations": o.select(i, F.col("o_orderstatus").alias("treatment_group"), F.lit("24 h").alias("timepoint"), F.lit(None).cast("string").alias("condition")),
        "tables": o.select(i, F.array("o_orderpriority").alias("headers"), none.alias("merged_cells"), none.alias("footnotes"), cells.alias("cells")),
        "translations": o.filter(k % 3 != 2).select(i, F.when(k % 9 == 0, "").otherwise("abcd efgh").alias("reference"), F.when(k % 2 == 0, 0.8).alias("min_score")),
    }
    actual = {
        "documents": o.filter(k % 7 != 0).select(i, (k % 5 != 0).alias("parsed"), F.when(k % 3 != 0, True).alias("evidence_locatable")),
        "fields": o.select(i, F.when(k % 4 != 0, F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" "))).otherwise("x").alias("value")),
        "numbers": o.select(i, F.when(k % 2 == 0, price * 1.005).otherwise(price * 1.5).alias("value"), F.lit("MG  / l").alias("unit")).union(o.filter(k % 9 == 0).select(F.concat(F.lit("x"), k.cast("string")), price, F.lit("g"))),
        "associations": o.filter(k % 6 != 0).select(i, F.col("o_orderstatus").alias("treatment_group"), F.lit("24  H").alias("timepoint"), F.when(k % 5 == 1, "dry").otherwise("").alias("condition")),
        "tables": o.select(i, F.array("o_orderpriority").alias("headers"), F.array().cast("array<string>").alias("merged_cells"), F.when(k % 8 == 0, F.array(F.lit("note"))).alias("footnotes"), F.when(k % 11 == 0, F.array(F.array(F.col("o_orderstatus"), F.lit("a")))).otherwise(cells).alias("cells")),
        "translations": o.filter(k % 4 != 1).select(i, F.when(k % 4 == 2, "abcx  EFGH").otherwise("ABCD efgh").alias("translation")),
    }
    return expected, actual


#: By order: whether each section's record is met, and the likeness of its translation.
MET = """SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS documents, o_orderkey % 4 <> 0 AS fields, o_orderkey % 2 = 0 AND o_orderkey % 10 <> 4 AS numbers, o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 1 AS associations, o_orderkey % 8 <> 0 AND o_orderkey % 11 <> 0 AS tables,
 CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 4 = 1 THEN 0.0 WHEN o_orderkey % 4 = 2 THEN 16.0 / 18 ELSE 1.0 END AS likeness FROM orders"""


@query(
    "gold_evaluation",
    f"""WITH m AS ({MET}) SELECT 'parsing_completeness' AS metric, count(*) FILTER (documents) AS matched, count(*) AS total, round(avg(documents::INTEGER), 6) AS score FROM m UNION ALL SELECT 'field_accuracy', count(*) FILTER (fields), count(*), round(avg(fields::INTEGER), 6) FROM m
UNION ALL SELECT 'numeric_tolerance_accuracy', count(*) FILTER (numbers), count(*), round(avg(numbers::INTEGER), 6) FROM m UNION ALL SELECT 'association_accuracy', count(*) FILTER (associations), count(*), round(avg(associations::INTEGER), 6) FROM m UNION ALL SELECT 'table_structure_accuracy', count(*) FILTER (tables), count(*), round(avg(tables::INTEGER), 6) FROM m
UNION ALL SELECT 'translation_reference_score', count(*) FILTER (k % 4 <> 1 AND likeness >= CASE WHEN k % 2 = 0 THEN 0.8 ELSE 1.0 END), count(*), round(avg(likeness), 6) FROM m WHERE k % 3 <> 2""",
)
def gold_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return E.evaluated(*_gold(spark, d))[0].withColumn("score", F.round("score", 6))


@query(
    "gold_issues",
    f"""WITH m AS ({MET}) SELECT 'parsing' AS category, 'documents' AS section, k::VARCHAR AS id, CASE WHEN k % 7 = 0 THEN 'missing' ELSE 'wrong' END AS status FROM m WHERE NOT documents UNION ALL SELECT 'field', 'fields', k::VARCHAR, 'wrong' FROM m WHERE NOT fields UNION ALL SELECT 'numeric', 'numbers', k::VARCHAR, 'wrong' FROM m WHERE NOT numbers
UNION ALL SELECT 'unexpected', 'numbers', 'x' || k, 'unexpected' FROM m WHERE k % 9 = 0 UNION ALL SELECT 'association', 'associations', k::VARCHAR, CASE WHEN k % 6 = 0 THEN 'missing' ELSE 'wrong' END FROM m WHERE NOT associations UNION ALL SELECT 'table', 'tables', k::VARCHAR, 'wrong' FROM m WHERE NOT tables
UNION ALL SELECT 'translation', 'translations', k::VARCHAR, CASE WHEN k % 4 = 1 THEN 'missing' ELSE 'wrong' END FROM m WHERE k % 3 <> 2 AND NOT (k % 4 <> 1 AND likeness >= CASE WHEN k % 2 = 0 THEN 0.8 ELSE 1.0 END) UNION ALL SELECT 'unexpected', 'translations', k::VARCHAR, 'unexpected' FROM m WHERE k % 3 = 2 AND k % 4 <> 1""",
)
def gold_issues(spark: SparkSession, d: str) -> DataFrame:
    return E.evaluated(*_gold(spark, d))[1].select("category", "section", "id", "status")
