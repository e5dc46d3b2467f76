"""Joins, aggregations, windows, paging and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tables as R
from ..operators.datasets import numbered
from ..operators.ordering import at_share
from ..session import table
from .catalogue import query

MONEY = "round({}, 2)"


@query(
    "star_join",
    "SELECT r_name, n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL",
)
def star_join(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer, nation, region = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    small = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    dated = orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    all_ = line.join(dated, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    return all_.groupBy("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("left_primary_evidence", "SELECT c_custkey, o_orderkey, n_name FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def left_primary_evidence(spark: SparkSession, d: str) -> DataFrame:
    primary = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(primary, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "o_orderkey", "n_name")


@query("self_alias_lookup", "SELECT s.s_suppkey, a.n_name AS source, b.n_name AS target FROM supplier s LEFT JOIN nation a ON a.n_nationkey = s.s_nationkey LEFT JOIN nation b ON b.n_nationkey = (s.s_nationkey + 1) % 30")
def self_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    nation, s = table(spark, d, "nation"), table(spark, d, "supplier")
    a, b = nation.alias("a"), nation.alias("b")
    return s.join(a, F.col("a.n_nationkey") == F.col("s_nationkey"), "left").join(b, F.col("b.n_nationkey") == (F.col("s_nationkey") + 1) % 30, "left").select("s_suppkey", F.col("a.n_name").alias("source"), F.col("b.n_name").alias("target"))


@query("semi_included", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_included(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey")
    return table(spark, d, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select("o_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("latest_version", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("latest_by_max", "SELECT e.user_id, e.event_type, count(*) AS n FROM events e JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) m ON e.user_id = m.user_id AND e.ts = m.ts GROUP BY ALL")
def latest_by_max(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.join(events.groupBy("user_id").agg(F.max("ts").alias("ts")), ["user_id", "ts"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("upsert_cells", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'X', 0.0 FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey + 100000000, 'N', 1.0 FROM orders WHERE o_orderkey % 11 = 0")
def upsert_cells(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.filter("o_orderkey % 7 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})
    added = old.filter("o_orderkey % 11 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return R.upserted(old, new.unionByName(added), ["o_orderkey"])


@query("replace_by_key", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT DISTINCT o_custkey, -1 FROM orders WHERE o_custkey % 5 = 0")
def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return R.replaced(old, old.filter("o_custkey % 5 = 0").select("o_custkey").distinct().withColumn("o_orderkey", F.lit(-1).cast("long")), "o_custkey")


@query("review_update", "SELECT event_id, CASE WHEN value > 50 AND event_type <> 'error' THEN 'confirmed' WHEN value IS NULL THEN 'doubtful' ELSE 'pending' END AS review FROM events")
def review_update(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when((F.col("value") > 50) & (F.col("event_type") != "error"), "confirmed").when(F.col("value").isNull(), "doubtful").otherwise("pending").alias("review"))


@query("distinct_pair_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def distinct_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("status_histogram_zero_fill", "SELECT v.event_type, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('refund'), ('never')) v(event_type) LEFT JOIN events e USING (event_type) GROUP BY v.event_type")
def status_histogram_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return R.zero_filled(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "refund", "never"])


@query("group_count_sum", "SELECT p_brand, coalesce(sum(l_quantity), 0)::DOUBLE AS qty, count(DISTINCT l_orderkey) AS orders FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def group_count_sum(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return both.groupBy("p_brand").agg(F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("qty"), F.countDistinct("l_orderkey").alias("orders"))


@query("doc_rollup_min_order", "SELECT o_orderkey, o_orderstatus, o_orderpriority, min(l_linenumber) AS first_line, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL ORDER BY first_line, o_orderkey")
def doc_rollup_min_order(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("n")).orderBy("first_line", "o_orderkey")


@query("next_sequence", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_no FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def next_sequence(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy("c_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_no"))


@query("scalar_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS overdrawn, (SELECT max(l_linenumber) FROM lineitem) AS most_lines")
def scalar_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").agg(F.count("*").alias("orders"))
    b = table(spark, d, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))
    return a.crossJoin(b).crossJoin(table(spark, d, "lineitem").agg(F.max("l_linenumber").alias("most_lines")))  # one row each


@query("ordered_concat", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities, arg_min(o_orderpriority, o_orderkey) AS first_one FROM orders GROUP BY o_custkey")
def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda r: r["o_orderpriority"]), ",").alias("priorities"), F.min_by("o_orderpriority", "o_orderkey").alias("first_one"))


@query("all_any_mean", "SELECT l_orderkey, bool_and(l_quantity > 5) AS all_large, bool_or(l_discount > 0.09) AS any_cut, round(avg(l_tax), 6) AS mean_tax FROM lineitem GROUP BY l_orderkey")
def all_any_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("all_large"), F.bool_or(F.col("l_discount") > 0.09).alias("any_cut"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))


@query("best_of_group", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def best_of_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", F.negative("o_orderkey"))).alias("best"))


@query("file_dedup_tally", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id, CASE WHEN bool_or(source = 'src1') THEN 'duplicate' ELSE 'created' END AS status FROM documents GROUP BY 1")
def file_dedup_tally(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"), "source")
    return R.file_tally(docs, docs.filter("source = 'src1'"))


@query("version_chain", "SELECT doc_id, row_number() OVER (PARTITION BY source, lower(lang || '-' || doc_id % 97) ORDER BY n_chars, doc_id) AS version_no FROM documents")
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    return R.version_chain(table(spark, d, "documents"), ["source"], F.concat("lang", F.lit("-"), (F.col("doc_id") % 97).cast("string")), F.col("n_chars"), F.col("doc_id")).select("doc_id", F.col("version_no").cast("long").alias("version_no"))


@query("batch_tally", "SELECT count(*) FILTER (n = 1) AS created, count(*) FILTER (n > 1) AS repeated, sum(n)::BIGINT AS files FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)")
def batch_tally(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") == 1).alias("created"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("files"))


@query("p95_by_index", "SELECT event_type, v[greatest(1, CAST(floor(len(v) * 0.95) AS INTEGER) - 1 + 1)] AS p95, round(m, 6) AS mean FROM (SELECT event_type, list(value ORDER BY value) AS v, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def p95_by_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("value is not null")
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return at_share(rows, "event_type", "value", 0.95).withColumnRenamed("value", "p95").join(means, "event_type")


@query("spatial_nearest", """WITH i AS (SELECT l_orderkey AS page, l_partkey AS item_id, l_quantity AS x0, l_quantity + 10 AS x1, l_linenumber * 100.0 AS y0 FROM lineitem WHERE l_linenumber % 2 = 0), t AS (SELECT l_orderkey AS page, l_suppkey AS text_id, l_quantity - 5 AS x0, l_quantity + 5 AS x1, l_linenumber * 100.0 + 20 + l_suppkey % 50 AS y1 FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT item_id, arg_min((text_id, i.y0 - t.y1), (i.y0 - t.y1, text_id))[1] AS text_id, min(i.y0 - t.y1) AS gap FROM i JOIN t USING (page) WHERE least(i.x1, t.x1) - greatest(i.x0, t.x0) > 0 AND i.y0 - t.y1 BETWEEN 0 AND 90 GROUP BY item_id""")
def spatial_nearest(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    items = line.filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_linenumber") * 100.0).alias("y0"))
    texts = line.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("text_id"), (F.col("l_quantity") - 5).alias("x0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_linenumber") * 100.0 + 20 + F.col("l_suppkey") % 50).alias("y1"))
    return R.nearest_above(items, texts, 90)


@query("forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    marked = table(spark, d, "events").withColumn("header", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return R.filled_down(marked, "header", ["user_id"], "ts", "event_id").select("event_id", "header")


@query("membership_visibility", """SELECT p.c_custkey AS project_id, CASE WHEN o.role IN ('owner', 'admin') THEN 'owner' ELSE m.role END AS role FROM customer p LEFT JOIN (SELECT DISTINCT o_custkey, 'viewer' AS role FROM orders WHERE o_orderkey % 10 = 3) m ON m.o_custkey = p.c_custkey LEFT JOIN (SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'admin' ELSE 'member' END AS role FROM nation WHERE n_nationkey % 2 = 0) o ON o.n_nationkey = p.c_nationkey WHERE m.role IS NOT NULL OR o.role IN ('owner', 'admin')""")
def membership_visibility(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("org_id"))
    members = table(spark, d, "orders").filter("o_orderkey % 10 = 3").select(F.col("o_custkey").alias("project_id")).distinct().select("project_id", F.lit(1).alias("user_id"), F.lit("viewer").alias("role"))
    org = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("org_id"), F.lit(1).alias("user_id"), F.when(F.col("n_regionkey") == 2, "admin").otherwise("member").alias("role"))
    return R.visible(projects, members, org, 1).select("project_id", "role")


@query("paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, 50, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("truncation_probe", "SELECT o_orderkey, (SELECT count(*) > 1000 FROM orders) AS more FROM orders ORDER BY o_orderkey LIMIT 1000")
def truncation_probe(spark: SparkSession, d: str) -> DataFrame:
    return R.truncated(table(spark, d, "orders").select("o_orderkey"), 1000, F.col("o_orderkey"))


@query("audit_top_n", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def audit_top_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id", "user_id", "event_type")


@query("union_all_contexts", "SELECT 'order' AS kind, o_orderkey AS id, o_orderpriority AS label, NULL::DOUBLE AS amount FROM orders UNION ALL SELECT 'part', p_partkey, p_type, p_retailprice FROM part UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM customer")
def union_all_contexts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    b = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_retailprice").alias("amount"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("set_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("case_folded_first", "SELECT lower(source) AS key, arg_min(source || lang, doc_id) AS first_spelling FROM documents GROUP BY 1")
def case_folded_first(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "documents").withColumn("key", F.lower("source")), ["key"], F.col("doc_id")).select("key", F.concat("source", "lang").alias("first_spelling"))


@query("uniqueness_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("orphan_check", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 300)")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(table(spark, d, "labels"), "doc_id", table(spark, d, "documents").filter("n_chars > 300"), "doc_id").select("doc_id", "quality")


@query("immutability_check", "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0")
def immutability_check(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.changed(old, old.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("cube_rollup", "SELECT r_name, c_mktsegment, count(*) AS n, grouping(r_name)::INTEGER * 2 + grouping(c_mktsegment)::INTEGER AS g FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("g"))


@query("group_row_numbers", "SELECT o_custkey, row_number() OVER (ORDER BY first_key) AS row_no FROM (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey)")
def group_row_numbers(spark: SparkSession, d: str) -> DataFrame:
    firsts = table(spark, d, "orders").filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"))
    return numbered(firsts, "first_key").select("o_custkey", "row_no")
