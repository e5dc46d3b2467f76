"""The rules around a project's data, over events, customers, orders, lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators import terms as M
from ..operators import values as V
from ..operators import workflow as W
from ..session import table
from .catalogue import query
from .evidence import BLOCKS, OR, TOKENS, _match

JOBS = "SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' ELSE 'completed' END AS status, user_id % 5 AS priority, ts AS queued_at, (event_id % 6)::INTEGER AS retry_count, 3 AS max_retries FROM events"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 4 == 0, "queued").when(k % 4 == 1, "failed").when(k % 4 == 2, "cancelled").otherwise("completed")
    return table(spark, d, "events").select(k.alias("job_id"), status.alias("status"), (F.col("user_id") % 5).alias("priority"), F.col("ts").alias("queued_at"), (k % 6).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"))


@query("claim_jobs", f"SELECT job_id, priority, 'running' AS status FROM ({JOBS}) WHERE status = 'queued' ORDER BY priority DESC, queued_at, job_id LIMIT 8")
def claim_jobs(spark: SparkSession, d: str) -> DataFrame:
    return W.claimed(_jobs(spark, d), 8).select("job_id", "priority", "status")


@query("manual_retry", f"SELECT job_id, may AS may_retry, retry_count + may::INTEGER AS retry_count, CASE WHEN may THEN 'queued' ELSE status END AS status FROM (SELECT *, status IN ('failed', 'cancelled') AND retry_count < max_retries AS may FROM ({JOBS}))")
def manual_retry(spark: SparkSession, d: str) -> DataFrame:
    return W.retried(_jobs(spark, d)).select("job_id", "may_retry", "retry_count", "status")


@query("progress_events", "SELECT user_id AS job_id, count(*) AS n, arg_max(event_type, event_id) AS stage, least(100.0, greatest(0.0, arg_max(coalesce(value, 0) * 2 - 20, event_id))) AS percent FROM events GROUP BY user_id")
def progress_events(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), (F.coalesce("value", F.lit(0.0)) * 2 - 20).alias("percent"))
    return W.progress(events)


@query("append_events", "SELECT user_id AS job_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, CASE WHEN event_id % 2 = 0 THEN event_id END, ts, event_id)::BIGINT AS event_no FROM events")
def append_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of even id are the log, numbered within their user; the others are appended in order of time."""
    events = table(spark, d, "events")
    log = events.filter("event_id % 2 = 0").selectExpr("row_number() over (partition by user_id order by event_id) as event_id", "user_id as job_id", "event_type").withColumn("event_id", F.col("event_id").cast("long"))
    new = events.filter("event_id % 2 = 1").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("at"), "event_type")
    return W.recorded(log, new).select("job_id", "event_type", F.col("event_id").alias("event_no"))


MEMBERS = "SELECT c_nationkey AS project_id, c_custkey AS user_id, CASE WHEN c_custkey % 12 = 0 THEN 'owner' ELSE 'editor' END AS role, CASE WHEN c_custkey % 5 = 0 THEN 'left' ELSE 'active' END AS status FROM customer"


@query("last_owner_guard", f"SELECT project_id, user_id, NOT (role = 'owner' AND status = 'active') OR count(*) FILTER (role = 'owner' AND status = 'active') OVER (PARTITION BY project_id) > 1 AS may_leave FROM ({MEMBERS})")
def last_owner_guard(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), k.alias("user_id"), F.when(k % 12 == 0, "owner").otherwise("editor").alias("role"), F.when(k % 5 == 0, "left").otherwise("active").alias("status"))
    return W.guarded_owners(members).select("project_id", "user_id", "may_leave")


def _archived(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    projects = c.select(k.alias("project_id"), F.when(k % 4 == 0, "archived").when(k % 7 == 0, "deleted").otherwise("active").alias("status"))
    return W.archived(projects, c.filter(k % 3 != 0).select(k.alias("project_id"), (F.col("c_acctbal") < 0).alias("archive")))


PROJECTS = "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 4 = 0 THEN 'archived' WHEN c_custkey % 7 = 0 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal < 0 END AS archive FROM customer"
STATUS = f"SELECT project_id, status AS old, CASE WHEN status = 'deleted' OR archive IS NULL THEN status WHEN archive THEN 'archived' ELSE 'active' END AS status FROM ({PROJECTS})"


@query("archive_projects", f"SELECT project_id, status FROM ({STATUS})")
def archive_projects(spark: SparkSession, d: str) -> DataFrame:
    return _archived(spark, d)[0]


@query("archive_audit", f"SELECT project_id, CASE status WHEN 'archived' THEN 'archive' ELSE 'unarchive' END AS action FROM ({STATUS}) WHERE status <> old")
def archive_audit(spark: SparkSession, d: str) -> DataFrame:
    return _archived(spark, d)[1]


@query(
    "source_scope",
    """SELECT o_orderkey AS report_id, 'dataset' AS part, CASE WHEN c_custkey IS NULL THEN 'not_found' ELSE 'other_project' END AS code FROM orders LEFT JOIN customer ON c_custkey = o_custkey + o_orderkey % 3 * 100000 WHERE o_orderkey % 5 <> 0 AND (c_custkey IS NULL OR c_nationkey <> o_orderkey % 25)
UNION ALL SELECT o_orderkey, 'run', CASE WHEN s_suppkey IS NULL THEN 'not_found' ELSE 'other_project' END FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 300 WHERE s_suppkey IS NULL OR s_nationkey <> o_orderkey % 25""",
)
def source_scope(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    reports = table(spark, d, "orders").select(k.alias("report_id"), (k % 25).alias("project_id"), F.when(k % 5 != 0, F.col("o_custkey") + k % 3 * 100000).alias("dataset"), (k % 300).alias("run"))
    return W.scope_issues(reports, {"dataset": table(spark, d, "customer").select("c_custkey", "c_nationkey"), "run": table(spark, d, "supplier").select("s_suppkey", "s_nationkey")})


@query(
    "conversion_requests",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber IN (6, 7) OR (l_linenumber = 3 AND l_suppkey % 2 = 0) THEN 'conversion_rule_not_found' WHEN l_linenumber = 4 AND l_returnflag <> 'N' THEN 'conversion_requires_confirmation' WHEN l_linenumber = 5 THEN 'formula_conversion_not_executable' END AS code,
 CASE WHEN l_linenumber < 3 OR (l_linenumber = 3 AND l_suppkey % 2 = 1) OR (l_linenumber = 4 AND l_returnflag = 'N') THEN l_quantity * l_linenumber + CASE WHEN l_linenumber = 2 THEN 0.0 ELSE 1.0 END END AS target FROM lineitem""",
)
def conversion_requests(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(i, i != 6, "mine" if i == 3 else None, None if i == 5 else float(i), None if i == 2 else 1.0, i == 4) for i in range(1, 7)], "rule_id int, active boolean, org string, multiplier double, offset double, confirm boolean")
    line = table(spark, d, "lineitem")
    asked = line.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("request_id"), F.col("l_linenumber").alias("rule_id"), F.col("l_suppkey").alias("user_id"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "N").alias("confirmed"))
    users = table(spark, d, "supplier").filter("s_suppkey % 2 = 1").select(F.lit("mine").alias("org"), F.col("s_suppkey").alias("user_id"), F.lit("active").alias("status"))
    return W.converted_requests(asked, F.broadcast(rules), users).select("request_id.*", "code", "target")  # six rules


@query("report_sources", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def report_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("deleted_at"))
    return W.report_sources(docs).select(F.col("document_id").alias("o_orderkey"), F.col("created_at").alias("o_orderdate"))


@query("untranslated_blocks", f"WITH {BLOCKS} SELECT doc_id, page_no, sequence_no, sha256(content) AS content_sha256 FROM blocks WHERE (doc_id + sequence_no) % 3 <> 0")
def untranslated_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = S.blocks(table(spark, d, "documents")).withColumn("block_id", F.struct("doc_id", "sequence_no"))
    done = blocks.filter((F.col("doc_id") + F.col("sequence_no")) % 3 == 0)
    return W.untranslated(blocks, done).select("doc_id", "page_no", "sequence_no", F.sha2("content", 256).alias("content_sha256"))


@query(
    "value_presence",
    """SELECT l_orderkey, count(*) FILTER (missing AND l_linenumber < 6) AS required_missing, count(*) FILTER (l_returnflag = 'R') AS doubtful, count(*) AS total FROM (SELECT *, l_linenumber IN (3, 7) OR (l_linenumber = 1 AND l_partkey % 2 = 0) OR (l_linenumber = 5 AND l_partkey % 3 = 0) AS missing FROM lineitem) GROUP BY l_orderkey""",
)
def value_presence(spark: SparkSession, d: str) -> DataFrame:
    """Counters over cells of thirteen value columns: by line a blank or filled text, 0, nothing, false, an array, a map; one marked as missing."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    cells = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("version_id"), (n < 6).alias("is_required"), F.when(F.col("l_returnflag") == "R", "doubtful").otherwise("pending").alias("review_status"), (n == 7).alias("is_missing"),
        F.when(n == 1, F.when(part % 2 == 0, "  ").otherwise("x")).alias("raw_value"), F.when(n == 6, F.create_map(F.lit("value"), F.lit(0))).alias("normalized_value"), F.lit(None).cast("map<string,int>").alias("ml_value"), text.alias("value_text"),
        F.when(n == 2, 0.0).when(n == 7, 1.0).alias("value_number"), F.when(n == 4, F.lit(False)).alias("value_boolean"), F.lit(None).cast("date").alias("value_date"), F.when(n == 5, F.when(part % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))).alias("value_json"),
        *(number.alias(c) for c in ("range_min", "range_max", "mean_value", "standard_deviation")), text.alias("significance_marker"),
    )
    values = cells.drop("version_id", "is_required", "review_status", "is_missing")
    counted = W.cell_counters(cells, ~F.col("is_missing") & V.any_present(values))
    return counted.withColumnRenamed("version_id", "l_orderkey")


@query("facet_lists", "SELECT p_brand AS key, arg_max(p_name, p_partkey) AS name, count(*) AS n FROM part GROUP BY p_brand")
def facet_lists(spark: SparkSession, d: str) -> DataFrame:
    return W.facets(table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("name"), "p_partkey"), "key", "name", "p_partkey")


@query("permission_subset", "SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY l_orderkey")
def permission_subset(spark: SparkSession, d: str) -> DataFrame:
    needed = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("item"))
    held = needed.join(table(spark, d, "part").filter("p_size < 40").select(F.col("p_partkey").cast("string").alias("item")), "item", "left_semi")
    return W.lacking(needed, held.select("l_orderkey", "item"), "l_orderkey", "item").select("l_orderkey", F.array_join("missing", ",").alias("missing"))


@query("view_join", "SELECT c_custkey, o_orderkey, n_name, r_name FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = CASE WHEN c_nationkey % 2 = 0 THEN 'O' ELSE 'F' END JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE NOT (c_acctbal < 0)")
def view_join(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "customer").filter(~(F.col("c_acctbal") < 0)).withColumn("wanted", F.when(F.col("c_nationkey") % 2 == 0, "O").otherwise("F"))
    own = live.join(table(spark, d, "orders"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == F.col("wanted")))
    return own.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", "o_orderkey", "n_name", "r_name")


@query("nested_evidence", "SELECT c_custkey, coalesce(o.n, 0) AS n, coalesce(o.s, '') AS said FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey")
def nested_evidence(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    out = W.nested(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "rows", ["o_orderkey"])
    return out.select("c_custkey", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderpriority"])), ",").alias("said"))


@query("upload_tally", "SELECT (SELECT count(DISTINCT text) FROM documents WHERE n_chars >= 50) AS created, (SELECT count(*) - count(DISTINCT text) FROM documents WHERE n_chars >= 50) AS duplicate, (SELECT count(*) FROM documents WHERE n_chars < 50) AS failed")
def upload_tally(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"), F.when(F.col("n_chars") < 50, "empty").alias("problem"))
    return W.upload_tally(files)


@query("mean_confidence", "SELECT l_orderkey, round(avg(l_discount), 6) AS confidence FROM lineitem WHERE l_quantity > 3 GROUP BY l_orderkey")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_quantity > 3").groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 6).alias("confidence"))


@query("author_lists", "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(concat(p_name, '; ', p_brand, '，', ' ', ',', p_type), '[;,，；]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names FROM part")
def author_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(T.authors(F.concat("p_name", F.lit("; "), "p_brand", F.lit("，"), F.lit(" "), F.lit(","), "p_type")), "|").alias("names"))


@query("merged_metadata", "SELECT event_id, 'new' AS a, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'old' END AS b, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    old = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("old"), F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")))
    new = F.when(k % 2 == 0, F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.lit("new"))).otherwise(F.create_map(F.lit("a"), F.lit("new")))
    return table(spark, d, "events").withColumn("m", T.merged_maps(old, new)).select("event_id", *(F.col("m")[c].alias(c) for c in "abk"))


@query("field_union", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderstatus), list(o_orderpriority)))), ',') AS fields FROM orders GROUP BY o_custkey")
def field_union(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set("o_orderpriority").alias("b"))
    return sets.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("fields"))


@query("case_folded_equality", "SELECT p_partkey, replace(lower(p_name), 'ß', 'ss') || '-strasse' AS folded, true AS same FROM part")
def case_folded_equality(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.casefolded(F.concat("p_name", F.lit("-Straße"))), T.casefolded(F.concat(F.upper("p_name"), F.lit("-STRASSE")))
    return table(spark, d, "part").select("p_partkey", a.alias("folded"), (a == b).alias("same"))


@query("canonical_json", """SELECT o_orderkey, '{"a":[1,' || o_custkey || '],"m":{"x":"' || o_orderstatus || '","y":null},"z":"' || o_orderpriority || '"}' AS json FROM orders""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    loose = F.format_string('{"z": "%s", "m": {"y": null, "x": "%s"}, "a": [1, %s]}', F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.canonical_json(loose).alias("json"))


@query("tables_equal", "SELECT o_custkey, n % 3 <> 0 AS same FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def tables_equal(spark: SparkSession, d: str) -> DataFrame:
    """Cells of two tables, equal in every place or not; one of every third has its first cell changed."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))).alias("cells"))
    other = F.transform("cells", lambda r, i: F.when((i == 0) & (F.col("n") % 3 == 0), F.array(F.lit("?"), r[1])).otherwise(r))
    return rows.select("o_custkey", F.col("cells").eqNullSafe(other).alias("same"))


TERMS = "SELECT p_partkey AS term_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'candidate' ELSE 'confirmed' END AS status, p_partkey % 3 = 0 AS is_selected FROM part"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("term_id"), F.col("p_name").alias("name"), F.when(k % 2 == 0, "candidate").otherwise("confirmed").alias("status"), (k % 3 == 0).alias("is_selected"))


@query("term_split", f"""SELECT term_id, name, CASE WHEN term_id % 10 < 2 THEN 'split' ELSE status END AS status, is_selected AND term_id % 10 >= 2 AS is_selected FROM ({TERMS})
UNION ALL SELECT p_partkey + 1000000 * i, p_name || i, 'confirmed', true FROM part, (VALUES (1), (2), (3)) v(i) WHERE p_partkey % 10 < 2 AND i <= 2 + p_partkey % 10""")
def term_split(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every tenth id get two children, of the next three, of the one after one, which is too few."""
    k = F.col("p_partkey")
    n = F.when(k % 10 == 0, 2).when(k % 10 == 1, 3).when(k % 10 == 2, 1)
    children = table(spark, d, "part").filter(k % 10 < 3).select(k, "p_name", F.explode(F.sequence(F.lit(1), n)).alias("i")).select((k + 1000000 * F.col("i")).alias("term_id"), k.alias("parent_id"), F.concat("p_name", F.col("i").cast("string")).alias("name"))
    return M.split(_terms(spark, d), children)


@query("term_edits", f"SELECT term_id, CASE WHEN term_id % 11 = 0 THEN 'deleted' WHEN term_id % 7 = 0 THEN 'merged' ELSE status END AS status, is_selected AND term_id % 11 <> 0 AND term_id % 7 <> 0 AS is_selected FROM ({TERMS})")
def term_edits(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d)
    merges = terms.filter("term_id % 7 = 0").select("term_id", (F.col("term_id") + 1).alias("target_id"))
    return M.deleted(M.merged_status(terms, merges), terms.filter("term_id % 11 = 0")).select("term_id", "status", "is_selected")


@query("term_occurrences_repointed", "SELECT CASE WHEN l_partkey % 7 = 0 THEN l_partkey + 1 ELSE l_partkey END AS term_id, count(*) AS n FROM lineitem GROUP BY 1")
def term_occurrences_repointed(spark: SparkSession, d: str) -> DataFrame:
    merges = table(spark, d, "part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("term_id"), (F.col("p_partkey") + 1).alias("target_id"))
    found = table(spark, d, "lineitem").select(F.col("l_partkey").alias("term_id"))
    known = found.join(table(spark, d, "part").select(F.col("p_partkey").alias("term_id")), "term_id", "left")
    return M.repointed(known, "term_id", merges).groupBy("term_id").agg(F.count("*").alias("n"))


@query("alias_replacement", "SELECT p_partkey AS term_id, p_brand AS alias FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_partkey % 4 = 0 AND lower(p_type) <> lower(p_name)")
def alias_replacement(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "term_id")
    new = part.filter("term_id % 4 = 0").select("term_id", F.array(F.concat(F.lit("  "), "p_name"), F.upper("p_name"), F.lit(" "), F.col("p_type")).alias("aliases"))
    return M.replaced_aliases(part.select("term_id", F.col("p_brand").alias("alias")), new)


@query("category_template", "SELECT n_nationkey AS project_id, code, name, position FROM nation, (VALUES ('process_parameters', '工艺参数', 0), ('chemical_indicators', '化学指标', 1), ('sensory_evaluation', '感官评价', 2)) t(code, name, position) WHERE NOT (n_nationkey % 2 = 0 AND code = 'chemical_indicators') UNION ALL SELECT n_nationkey, 'chemical_indicators', 'own', 9 FROM nation WHERE n_nationkey % 2 = 0")
def category_template(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"))
    own = nation.filter("project_id % 2 = 0").select("project_id", F.lit("chemical_indicators").alias("code"), F.lit("own").alias("name"), F.lit(9).alias("position"))
    return M.with_template(own, nation)


@query(
    "discover_from_hits",
    f"""WITH {BLOCKS}, near AS (SELECT *, lag(content) OVER w AS previous, lead(content) OVER w AS next FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, sequence_no)),
hits AS (SELECT *, row_number() OVER (ORDER BY doc_id, page_no, sequence_no) AS result_no FROM near WHERE {" OR ".join(_match("content", OR))}),
said AS (SELECT doc_id, sequence_no, concat_ws(' ', previous, content, next) AS content FROM hits WHERE result_no % 3 <> 0),
{TOKENS.replace("FROM blocks", "FROM said")}, c AS (SELECT token, count(*) AS n, min((doc_id, sequence_no, pos)) AS first FROM tokens GROUP BY token ORDER BY n DESC, first LIMIT 500) SELECT token, n FROM c WHERE n >= 2""",
)
def discover_from_hits(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a search's hits and their neighbours; every third hit was rejected in review."""
    hits = S.search(S.blocks(table(spark, d, "documents")), OR, "or")
    no = hits.filter("result_no % 3 = 0").select("result_no", F.lit(False).alias("is_included"), F.lit("rejected").alias("review_status"))
    return M.discover(M.hit_texts(S.reviewed(hits, no))).select("token", "n")
