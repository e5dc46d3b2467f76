"""Extraction, units, datasets, evaluation and report queries over generated measurement texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import evaluation as E
from ..operators import layout as Y
from ..operators import modelling as ML
from ..operators import values as V
from ..session import table
from .catalogue import query

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
#: Raw values with every mark, by line; the same text makes them in Spark and in DuckDB.
RAW = """CASE (l_orderkey + l_linenumber) % 12 WHEN 0 THEN concat(CAST(l_quantity AS INTEGER)) WHEN 1 THEN concat(CAST(l_quantity AS INTEGER), ' ± ', l_linenumber, '.5') WHEN 2 THEN concat(CAST(l_quantity AS INTEGER), ' +/- ', l_linenumber) WHEN 3 THEN concat(CAST(l_quantity AS INTEGER), ' ±')
 WHEN 4 THEN concat(CAST(l_quantity AS INTEGER), '~', CAST(l_quantity AS INTEGER) + 7) WHEN 5 THEN concat(CAST(l_quantity AS INTEGER), '～', l_linenumber) WHEN 6 THEN concat(CAST(l_quantity AS INTEGER), ' — ', l_linenumber) WHEN 7 THEN concat(CAST(l_quantity AS INTEGER), '–', l_linenumber)
 WHEN 8 THEN concat(CAST(l_quantity AS INTEGER), '-', l_linenumber) WHEN 9 THEN concat(CAST(l_quantity AS INTEGER), ' ', l_linenumber) WHEN 10 THEN concat(l_linenumber, '~', CAST(l_quantity AS INTEGER), '~99') ELSE concat('-', l_linenumber, '.25') END"""
#: By n, a list of the numbers of raw, the parts of its parsed struct.
PARSED = """CASE WHEN contains(raw, '±') OR contains(raw, '+/-') THEN 'mean_sd' WHEN len(n) > 0 AND (regexp_matches(raw, '~|～|—|–') OR (len(n) > 1 AND contains(raw[2:], '-'))) THEN 'range' WHEN len(n) > 0 THEN 'number' END"""
NUMBERS = r"list_transform(regexp_extract_all(raw, '[-+]?\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE))"


@query(
    "numeric_parse",
    f"""WITH r AS (SELECT {KEYS}, {RAW} AS raw FROM lineitem), n AS (SELECT *, {NUMBERS} AS n FROM r), k AS (SELECT *, {PARSED} AS kind FROM n)
SELECT {KEYS}, raw, kind, CASE kind WHEN 'range' THEN (n[1] + coalesce(n[2], 0)) / 2 ELSE n[1] END AS main, CASE kind WHEN 'mean_sd' THEN n[2] END AS sd, CASE kind WHEN 'range' THEN list_min(n) END AS low, CASE kind WHEN 'range' THEN list_max(n) END AS high FROM k""",
)
def numeric_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("raw", F.expr(RAW)).withColumn("p", V.parsed(F.col("raw")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw", F.col("p.type").alias("kind"), V.main_number(F.col("p")).alias("main"), "p.sd", F.col("p.min").alias("low"), F.col("p.max").alias("high"))


@query("convert_parsed", f"""WITH r AS (SELECT {KEYS}, {RAW} AS raw FROM lineitem), n AS (SELECT *, {NUMBERS} AS n FROM r), k AS (SELECT *, {PARSED} AS kind FROM n)
SELECT {KEYS}, CASE kind WHEN 'number' THEN n[1] * -1.8 + 32 END AS value, CASE kind WHEN 'mean_sd' THEN n[1] * -1.8 + 32 END AS mean, CASE kind WHEN 'mean_sd' THEN n[2] * 1.8 END AS sd, CASE kind WHEN 'range' THEN list_max(n) * -1.8 + 32 END AS min, CASE kind WHEN 'range' THEN list_min(n) * -1.8 + 32 END AS max, CASE kind WHEN 'range' THEN (n[1] + coalesce(n[2], 0)) / 2 * -1.8 + 32 END AS mid FROM k""")
def convert_parsed(spark: SparkSession, d: str) -> DataFrame:
    p = V.converted(V.parsed(F.expr(RAW)), F.lit(-1.8), F.lit(32.0))
    return table(spark, d, "lineitem").withColumn("p", p).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(f"p.{k}" for k in ("value", "mean", "sd", "min", "max", "mid")))


SAID = """CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN concat('yield 10~20 %, yield ', CAST(l_quantity AS INTEGER), ' ± ', l_linenumber, '.5 mg/L') WHEN 1 THEN concat('Yield: ', CAST(l_quantity AS INTEGER), ' +/- ', l_linenumber, ' mg/g; yields ', l_linenumber, ' ppm')
 WHEN 2 THEN concat('sample: B', l_linenumber, ' after ', l_linenumber, ' days, pH: 6.5, 200 r/min, yield ', CAST(l_quantity AS INTEGER), ' kg') WHEN 3 THEN concat('处理组: A', l_linenumber, ' ', l_linenumber, ' h, 37℃ yield ', l_linenumber, '.25 μg/L') ELSE concat('treatment: control at 24 h, 37°C, pH 6.5 and 180 rpm; yield ', CAST(l_quantity AS INTEGER)) END"""
WHOLE = rf"(?i)(?:yield).{{0,50}}?{V.VALUE_UNIT}"


@query(
    "extract_values",
    f"""WITH t AS (SELECT {KEYS}, {SAID} AS text FROM lineitem)
SELECT {KEYS}, unnest(range(1, len(regexp_extract_all(text, '{WHOLE}')) + 1))::INTEGER AS match_no, unnest(regexp_extract_all(text, '{WHOLE}', 1)) AS raw, nullif(unnest(regexp_extract_all(text, '{WHOLE}', 2)), '') AS unit FROM t""",
)
def extract_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("text", F.expr(SAID))
    found = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(V.mined(F.col("text"), ["yield"])).alias("i", "m"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("i") + 1).alias("match_no"), "m.raw", "m.unit")


@query(
    "dimension_tags",
    f"""WITH t AS (SELECT {KEYS}, {SAID} AS text FROM lineitem)
SELECT {KEYS}, nullif(regexp_extract(text, '(?i){V.TREATMENT}', 1), '') AS treatment, nullif(concat(regexp_extract(text, '(?i){V.TIMEPOINT}', 1), regexp_extract(text, '(?i){V.TIMEPOINT}', 2)), '') AS timepoint,
 concat_ws('|', {", ".join(f"nullif(regexp_extract(text, '(?i){p}', 0), '')" for p in V.CONDITIONS.values())}) AS conditions FROM t""",
)
def dimension_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("d", V.dimensions(F.expr(SAID)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "d.treatment", "d.timepoint", F.array_join("d.conditions", "|").alias("conditions"))


@query(
    "sample_keys",
    f"""WITH t AS (SELECT {KEYS}, {SAID} AS text FROM lineitem), d AS (SELECT *, coalesce(nullif(regexp_extract(text, '(?i){V.TREATMENT}', 1), ''), 'unspecified') AS treatment, coalesce(nullif(concat(regexp_extract(text, '(?i){V.TIMEPOINT}', 1), regexp_extract(text, '(?i){V.TIMEPOINT}', 2)), ''), 'unspecified') AS tp FROM t)
SELECT {KEYS}, left(concat(l_orderkey, ':block=', l_partkey, ':page=', l_linenumber, ':treatment=', treatment, ':time=', tp, ':yield:1'), 255) AS sample_key, treatment AS treatment, l_partkey::VARCHAR AS block FROM d""",
)
def sample_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("d", V.dimensions(F.expr(SAID)))
    source = F.concat(F.lit("block="), F.col("l_partkey").cast("string"), F.lit(":page="), F.col("l_linenumber").cast("string"))
    keyed = rows.withColumn("sample_key", V.sample_key(F.col("l_orderkey"), V.group_key(source, F.col("d")), F.lit("yield"), F.lit(1)))
    return keyed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sample_key", V.key_part(F.col("sample_key"), "treatment").alias("treatment"), V.key_part(F.col("sample_key"), "block").alias("block"))


@query(
    "unit_convert",
    f"SELECT {KEYS}, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 0.001 ELSE l_quantity * 1.8 + 32 END AS converted, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 3 END::INTEGER AS version FROM lineitem",
)
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame([(1, "mg_l", "mg/L", "milligram per litre", ["mg / l"]), (2, "g_l", "g/L", "gram per litre", None), (3, "cel", "°C", "degree", ["℃"]), (4, "fah", "°F", "fahrenheit", None)], "unit_id int, code string, symbol string, name string, aliases array<string>")
    rules = spark.createDataFrame([(1, 1, 2, 0.5, 0.0, None, 1, True), (2, 1, 2, 0.001, 0.0, None, 2, True), (3, 3, 4, 9.0, 9.0, None, 9, True), (4, 3, 4, 1.8, 32.0, "mine", 3, True), (5, 3, 4, 7.0, 7.0, "other", 10, True), (6, 1, 2, 8.0, 8.0, None, 3, False)], "rule_id int, source int, target int, m double, o double, org string, version int, active boolean")
    rows = table(spark, d, "lineitem").withColumn("token", F.when(F.col("l_linenumber") % 2 == 0, F.lit(" MG / L ")).otherwise(F.lit(" ℃ ")))
    known = V.with_units(rows, F.broadcast(units), F.col("token")).withColumn("source", F.col("unit_id")).withColumn("target", F.col("unit_id") + 1)
    ruled = V.with_rules(known, F.broadcast(rules), "mine")
    p = V.converted(F.struct(F.lit("number").alias("type"), F.col("l_quantity").alias("value"), *(F.lit(None).cast("double").alias(k) for k in ("mean", "sd", "min", "max", "mid"))), F.col("m"), F.col("o"))
    return ruled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p["value"].alias("converted"), "version")


@query("significance_marker", r"SELECT p_partkey, nullif(regexp_extract(concat(p_size, CASE p_size % 3 WHEN 0 THEN 'ab' WHEN 1 THEN '' ELSE ' c' END), '\d([a-zA-Z]{1,3})$', 1), '') AS marker FROM part")
def significance_marker(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "ab").when(F.col("p_size") % 3 == 1, "").otherwise(" c"))
    return table(spark, d, "part").select("p_partkey", V.significance(raw).alias("marker"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Long extraction records: a row per line and field; ord is total, so first means one thing."""
    line = table(spark, d, "lineitem").withColumn("row_key", F.col("l_orderkey"))
    ord_ = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return D.long(line.select("row_key", ord_.alias("ord"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")), ["row_key", "ord"], ["quantity", "price", "discount"])


FIRST = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS n FROM lineitem"


@query("eav_unpivot", "SELECT l_orderkey AS row_key, field, count(*) AS n, round(sum(value), 2) AS total FROM (UNPIVOT (SELECT l_orderkey, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem) ON quantity, price, discount INTO NAME field VALUE value) GROUP BY ALL")
def eav_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("row_key", "field").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("eav_pivot", f"SELECT l_orderkey AS row_key, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM ({FIRST}) WHERE n = 1")
def eav_pivot(spark: SparkSession, d: str) -> DataFrame:
    return D.wide(D.first_records(records(spark, d)), ["quantity", "price", "discount"])


@query("dataset_first_wins", f"SELECT l_orderkey AS row_key, row_number() OVER (ORDER BY l_orderkey) AS row_no, l_quantity AS quantity FROM ({FIRST}) WHERE n = 1")
def dataset_first_wins(spark: SparkSession, d: str) -> DataFrame:
    found = records(spark, d)
    cells = D.first_records(found.filter("field = 'quantity'")).select("row_key", F.col("value").alias("quantity"))
    rows = D.numbered(found.groupBy("row_key").agg(F.min("row_key").alias("first_ord")), "first_ord").select("row_key", "row_no")
    return rows.join(cells, "row_key", "left")


@query(
    "freeze_issues",
    """SELECT c_custkey AS row_id, f.field, 'required_value_missing' AS code FROM customer CROSS JOIN (VALUES ('segment'), ('balance')) f(field) WHERE (f.field = 'segment' AND c_custkey % 6 = 0) OR (f.field = 'balance' AND c_custkey % 10 = 0)
UNION ALL SELECT c_custkey, 'balance', 'doubtful_value' FROM customer WHERE c_custkey % 15 = 1 AND c_custkey % 10 <> 0""",
)
def freeze_issues(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    fields = spark.createDataFrame([("segment", True), ("balance", True), ("note", False)], "field string, is_required boolean")
    blank = F.when(F.col("c_custkey") % 6 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    text = c.select(F.col("c_custkey").alias("row_id"), F.lit("segment").alias("field"), blank.alias("value_text"), F.lit(None).cast("double").alias("value_number"), F.lit(False).alias("is_missing"), F.lit("confirmed").alias("review_status"))
    number = c.filter("c_custkey % 10 != 0").select(F.col("c_custkey").alias("row_id"), F.lit("balance").alias("field"), F.lit(None).cast("string").alias("value_text"), F.when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("value_number"), F.lit(False).alias("is_missing"), F.when(F.col("c_custkey") % 15 == 1, "doubtful").otherwise("pending").alias("review_status"))
    return D.freeze_issues(c.select(F.col("c_custkey").alias("row_id")), fields, text.unionByName(number))


@query(
    "snapshot_hash",
    r"""WITH r AS (SELECT o_orderpriority, sha256(concat_ws(chr(31), o_orderkey, coalesce(o_custkey::VARCHAR, '\N'), coalesce(o_orderstatus, '\N'))) AS h FROM orders), p AS (SELECT o_orderpriority, left(h, 3) AS part, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY ALL)
SELECT o_orderpriority, sha256(string_agg(h, '' ORDER BY part)) AS content_hash FROM p GROUP BY ALL""",
)
def snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    return D.content_hash(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"))


@query("clone_version", "SELECT sha256('v2/' || o_orderkey) AS o_orderkey, sha256('v2/' || o_custkey) AS o_custkey, 'v2' AS version, o_totalprice FROM orders")
def clone_version(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit("v1").alias("version"), "o_totalprice")
    return D.cloned(old, ["o_orderkey", "o_custkey"], "version", "v2")


GOLD = "SELECT o_orderkey AS id, o_totalprice AS value, 'g' AS unit FROM orders WHERE o_orderkey % 50 <> 1"
ACTUAL = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 1.01 WHEN o_orderkey % 3 = 1 THEN o_totalprice * 1.5 ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'kg' ELSE ' G' END AS unit FROM orders WHERE o_orderkey % 50 <> 2"
STATUS = f"SELECT coalesce(e.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' WHEN abs(a.value - e.value) <= abs(e.value) * 0.02 AND e.unit = lower(trim(a.unit)) THEN 'matched' ELSE 'wrong' END AS status FROM ({GOLD}) e FULL JOIN ({ACTUAL}) a ON e.id = a.id"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    expected = o.filter("o_orderkey % 50 != 1").select(k.alias("id"), v.alias("value"), F.lit("g").alias("unit"))
    actual = o.filter("o_orderkey % 50 != 2").select(k.alias("id"), F.when(k % 3 == 0, v * 1.01).when(k % 3 == 1, v * 1.5).otherwise(v).alias("value"), F.when(k % 7 == 0, "kg").otherwise(" G").alias("unit"))
    return E.compared(expected, actual, E.number_ok(F.col("e.value"), F.col("a.value"), F.lit(None).cast("double"), F.lit(0.02)) & E.unit_ok(F.col("e.unit"), F.col("a.unit")))


@query("gold_eval_status", STATUS)
def gold_eval_status(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d)


@query("gold_eval_numbers", f"SELECT 'numbers' AS category, count(*) FILTER (status = 'matched') AS matched, count(*) AS total, round(count(*) FILTER (status = 'matched') / count(*), 4) AS score FROM ({STATUS}) WHERE status <> 'unexpected'")
def gold_eval_numbers(spark: SparkSession, d: str) -> DataFrame:
    return E.metric(_gold(spark, d), "numbers")


@query("manifest_problems", "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 9 = 1 THEN 'size' WHEN doc_id % 9 = 2 AND n_chars > 0 THEN 'digest' END AS problem FROM documents WHERE doc_id % 9 <= 2")
def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.col("text").cast("binary").alias("content"))
    stated = E.manifest(docs).join(docs.select("path", "doc_id"), "path")
    stated = stated.withColumn("size", F.when(F.col("doc_id") % 9 == 1, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(F.col("doc_id") % 9 == 2, F.lit("0")).otherwise(F.col("sha256"))).drop("doc_id")
    return E.manifest_problems(stated, E.manifest(docs.filter("doc_id % 9 != 0")))


@query("histogram_bins", """WITH b AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, least(20, greatest(5, floor(count(*) / 2))) AS k FROM customer)
SELECT 'c_acctbal' AS column, least(floor((c_acctbal - a) / ((b - a) / k)), k - 1)::INTEGER AS bin, round(any_value(a + least(floor((c_acctbal - a) / ((b - a) / k)), k - 1) * ((b - a) / k)), 6) AS low, count(*) AS n FROM customer, b GROUP BY 1, 2""")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return ML.histogram(table(spark, d, "customer"), ["c_acctbal"]).withColumn("low", F.round("low", 6))


@query("correlation_matrix", "SELECT a, b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', corr(l_extendedprice, l_quantity) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0)")
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ML.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("r", F.round("r", 6))


@query("bbox_scale", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity * 0.5, 3) AS x0, round_even(l_extendedprice * (1000::DOUBLE / 3000), 3) AS y0, round_even((l_quantity + 10) * 0.5, 3) AS x1, round_even((l_extendedprice + 7) * (1000::DOUBLE / 3000), 3) AS y1 FROM lineitem")
def bbox_scale(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    boxes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("x0"), p.alias("y0"), (q + 10).alias("x1"), (p + 7).alias("y1"))
    return Y.scaled(boxes, (2000.0, 3000.0), (1000.0, 1000.0))


LABEL = "CASE l_linenumber % 4 WHEN 0 THEN 'Yield' WHEN 1 THEN concat(' ', CAST(l_quantity AS INTEGER), ' ') WHEN 2 THEN concat(CAST(l_quantity AS INTEGER), '.5 +/- 2 mg/L') ELSE concat(CAST(l_quantity AS INTEGER), ' apples') END"
IS_VALUE = f"regexp_matches(trim({LABEL}), '{Y.VALUE_LABEL}')"


@query(
    "figure_labels",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN {IS_VALUE} AND l_quantity > 6 AND l_discount < 0.082 THEN 'direct' END, CASE WHEN l_quantity >= 30 AND ({IS_VALUE} OR (l_discount < 0.072 AND l_quantity > 11)) THEN 'legend' END, CASE WHEN l_discount >= 0.072 AND NOT {IS_VALUE} THEN 'x_axis' END, CASE WHEN l_quantity <= 11 AND NOT {IS_VALUE} THEN 'y_axis' END) AS labels FROM lineitem""",
)
def figure_labels(spark: SparkSession, d: str) -> DataFrame:
    found = Y.label_classes(F.expr(LABEL), F.col("l_quantity"), F.col("l_discount"), F.lit(50.0), F.lit(0.1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(found, ",").alias("labels"))


GRID = "SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS table_id, CAST(p_partkey % 8 AS INTEGER) AS row, {c} AS column_no, {t} AS text FROM part"
GRIDS = " UNION ALL ".join(GRID.format(c=c, t=t) for c, t in ((0, "CASE WHEN p_partkey % 8 < 1 + p_size % 3 THEN 'Group' ELSE p_brand END"), (1, "CASE WHEN p_partkey % 8 = 0 THEN 'Acid (g/L)' WHEN p_partkey % 8 < 1 + p_size % 3 THEN '' ELSE concat(p_size, '.5') END"), (2, "CASE WHEN p_partkey % 8 < 1 + p_size % 3 THEN concat('H', p_partkey % 8) ELSE concat(p_size, ' h') END")))


@query(
    "table_headers",
    f"""WITH l AS (SELECT table_id, row, count(*) FILTER (trim(text) <> '') AS n, count(*) FILTER (regexp_matches(text, '\\d')) AS k FROM ({GRIDS}) GROUP BY table_id, row)
SELECT table_id, least(coalesce(min(row) FILTER (row > 0 AND row < 5 AND n > 0 AND k >= 0.6 * n), 5), max(row) + 1)::INTEGER AS header_rows FROM l GROUP BY table_id""",
)
def table_headers(spark: SparkSession, d: str) -> DataFrame:
    return Y.header_rows(_grids(spark, d)).select("table_id", F.col("header_rows").cast("int").alias("header_rows"))


def _grids(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("_part")
    return spark.sql(GRIDS.replace("FROM part", "FROM _part")).withColumnRenamed("column_no", "column")


HEADS = f"""g AS ({GRIDS}), l AS (SELECT table_id, row, count(*) FILTER (trim(text) <> '') AS n, count(*) FILTER (regexp_matches(text, '\\d')) AS k FROM g GROUP BY table_id, row),
h AS (SELECT table_id, least(coalesce(min(row) FILTER (row > 0 AND row < 5 AND n > 0 AND k >= 0.6 * n), 5), max(row) + 1) AS header_rows FROM l GROUP BY table_id),
f AS (SELECT table_id, column_no, row, last_value(nullif(trim(text), '') IGNORE NULLS) OVER (PARTITION BY table_id, column_no ORDER BY row) AS t FROM g JOIN h USING (table_id) WHERE row < header_rows),
p AS (SELECT table_id, column_no, string_agg(t, ' / ' ORDER BY first) AS path FROM (SELECT table_id, column_no, t, min(row) AS first FROM f WHERE t IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


@query("header_paths", f"WITH {HEADS} SELECT table_id, column_no, coalesce(path, '') AS path, nullif(regexp_extract(coalesce(path, ''), '{Y.HEADER_UNIT}', 1), '') AS unit FROM (SELECT DISTINCT table_id, column_no FROM f) LEFT JOIN p USING (table_id, column_no)")
def header_paths(spark: SparkSession, d: str) -> DataFrame:
    return Y.header_paths(_grids(spark, d)).select("table_id", F.col("column").alias("column_no"), F.array_join("path", " / ").alias("path"), "unit")


@query("table_row_texts", f"WITH {HEADS} SELECT table_id, row, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN concat_ws(': ', nullif(path, ''), trim(text)) END, ' | ' ORDER BY column_no), '') AS text FROM g JOIN h USING (table_id) LEFT JOIN p USING (table_id, column_no) WHERE row >= header_rows GROUP BY table_id, row")
def table_row_texts(spark: SparkSession, d: str) -> DataFrame:
    return Y.row_texts(_grids(spark, d))
