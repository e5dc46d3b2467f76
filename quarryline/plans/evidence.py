"""Search, terminology and text queries over documents, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import matcher_similarity, partial_similarity
from ..operators import search as S
from ..operators import terms as M
from ..operators.semantics import fit_with, meant
from ..session import table
from .catalogue import query

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
BLOCKS = rf"""blocks AS (SELECT doc_id, CAST(floor(i / 5) AS INTEGER) AS page_no, CAST(i AS INTEGER) AS sequence_no, content FROM (
  SELECT doc_id, i, {STRIP.format("p[i + 1]")} AS content FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE content <> '')"""
AND, OR = [S.Term("license", ("lizenz",)), S.Term("apache")], [S.Term("public"), S.Term("tion")]


def _match(column: str, terms: list[S.Term]) -> list[str]:
    return ["(" + " OR ".join(f"contains(lower({column}), '{v}')" for v in t.variants) + ")" for t in terms]


def _score(column: str, terms: list[S.Term]) -> str:
    return "(" + " + ".join(f"CASE WHEN {m} THEN 100.0 ELSE 0.0 END" for m in _match(column, terms)) + f")::DOUBLE / {len(terms)}"


def _names(column: str, terms: list[S.Term]) -> str:
    return "concat_ws('、', " + ", ".join(f"CASE WHEN {m} THEN '{t.text}' END" for m, t in zip(_match(column, terms), terms, strict=True)) + ")"


def _block_sql(terms: list[S.Term], logic: str) -> str:
    return f"""WITH {BLOCKS}, near AS (SELECT *, lag(content) OVER w AS previous, lead(content) OVER w AS next FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, sequence_no))
SELECT row_number() OVER (ORDER BY doc_id, page_no, sequence_no) AS result_no, doc_id, page_no, sequence_no, content, previous, next, {_names("content", terms)} AS matched, {_score("content", terms)} AS score
FROM near WHERE {f" {logic} ".join(_match("content", terms))}"""


def _block(terms: list[S.Term], logic: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = S.search(S.blocks(table(spark, d, "documents")), terms, logic)
        return hits.select("result_no", "doc_id", "page_no", "sequence_no", "content", "previous", "next", S.matched_terms(F.col("matches")).alias("matched"), "score")

    return run


query("search_exact_and_block", _block_sql(AND, "AND"))(_block(AND, "and"))
query("search_exact_or_block", _block_sql(OR, "OR"))(_block(OR, "or"))


def _scope(scope: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = S.search(S.blocks(table(spark, d, "documents")), AND, "and", scope)
        return hits.select("result_no", "doc_id", "page_no", "sequence_no", F.sha2("content", 256).alias("content_sha256"), F.sha2("previous", 256).alias("previous_sha256"), F.sha2("next", 256).alias("next_sha256"), "score")

    return run


# A block that holds a term is the best of its unit, the first such one. Units that match by aliases alone are left to the tests.
for _name, _by in (("page", "doc_id, page_no"), ("document", "doc_id")):
    query(
        f"search_{_name}_scope",
        f"""WITH {BLOCKS}, near AS (SELECT *, lag(content) OVER w AS previous, lead(content) OVER w AS next FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, sequence_no)),
units AS (SELECT {_by}, string_agg(content, chr(10) ORDER BY sequence_no) AS content FROM blocks GROUP BY {_by}), hits AS (SELECT {_by}, {_score("content", AND)} AS score FROM units WHERE {" AND ".join(_match("content", AND))}),
best AS (SELECT {_by}, arg_min((page_no, sequence_no, content, previous, next), (page_no, sequence_no)) AS b FROM near JOIN hits USING ({_by}) WHERE {" OR ".join(f"contains(lower(near.content), '{t.text}')" for t in AND)} GROUP BY {_by})
SELECT row_number() OVER (ORDER BY doc_id, b[1], b[2]) AS result_no, doc_id, b[1] AS page_no, b[2] AS sequence_no, sha256(b[3]) AS content_sha256, sha256(b[4]) AS previous_sha256, sha256(b[5]) AS next_sha256, score FROM best JOIN hits USING ({_by})""",
    )(_scope(_name))


@query("search_fuzzy")
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    hits = S.scored(S.blocks(table(spark, d, "documents")), [S.Term("licensed under the apache licence")], mode="fuzzy", fuzzy=82.0)
    return hits.select("doc_id", "page_no", "sequence_no", F.round("score", 6).alias("score"))


def _meant(units: DataFrame, terms: list[S.Term]) -> DataFrame:
    """units with the scores of the terms' meaning, by the space of the units and the terms."""
    asked = [t.text for t in terms]
    return meant(units, "content", asked, fit_with(units, "content", asked))


@query("search_hybrid")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that hold a term, or are like it in letters or in meaning."""
    terms = [S.Term("gnu general public license")]
    hits = S.scored(_meant(S.blocks(table(spark, d, "documents")), terms), terms, mode="hybrid", semantic="scores", semantic_least=0.4)
    return hits.select("doc_id", "page_no", "sequence_no", F.round("score", 6).alias("score"))


@query("search_semantic")
def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by blended meaning for two terms; either may match."""
    terms = [S.Term("water and air"), S.Term("history of the nation")]
    hits = S.scored(_meant(S.blocks(table(spark, d, "documents")), terms), terms, "or", mode="semantic", semantic="scores")
    return hits.select("doc_id", "page_no", "sequence_no", F.round("score", 6).alias("score"), S.matched_terms(F.col("matches")).alias("matched"))


QUERY = "the nation of water"


@query(
    "search_char_tfidf",
    f"""WITH corpus AS (SELECT doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT NULL, '{QUERY}'),
g AS (SELECT id, t[i:i + 2] AS gram FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM corpus WHERE len(t) >= 3)),
tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), n AS (SELECT count(*) AS n FROM corpus),
w AS (SELECT id, gram, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (gram), n),
q AS (SELECT gram, w AS qw FROM w WHERE id IS NULL)
SELECT id AS doc_id, round(sum(w * coalesce(qw, 0)) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS cosine FROM w LEFT JOIN q USING (gram) WHERE id IS NOT NULL GROUP BY id HAVING sum(w * coalesce(qw, 0)) > 0""",
)
def search_char_tfidf(spark: SparkSession, d: str) -> DataFrame:
    found = S.gram_tfidf(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), QUERY)
    return found.select(F.col("id").alias("doc_id"), F.round("cosine", 6).alias("cosine"))


@query(
    "vector_cosine_topk",
    """SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS cosine
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT 10""",
)
def vector_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    asked = vectors.filter("vec_id = 0").select("x").first()["x"]  # one query vector

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    q = F.array(*map(F.lit, asked))
    cosine = F.round(dot(F.col("x"), q) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(q, q)), 6)
    return vectors.filter("vec_id != 0").select("vec_id", "label", cosine.alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


@query("blocks_from_text", f"WITH {BLOCKS} SELECT doc_id, page_no, sequence_no, sha256(content) AS content_sha256, len(content)::INTEGER AS chars FROM blocks")
def blocks_from_text(spark: SparkSession, d: str) -> DataFrame:
    return S.blocks(table(spark, d, "documents")).select("doc_id", "page_no", "sequence_no", F.sha2("content", 256).alias("content_sha256"), F.char_length("content").alias("chars"))


@query(
    "context_within_page",
    f"""WITH {BLOCKS}, kept AS (SELECT * FROM blocks WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = blocks.doc_id AND l.quality = 1))
SELECT doc_id, page_no, sequence_no, sha256(lag(content) OVER w) AS previous_sha256, sha256(lead(content) OVER w) AS next_sha256 FROM kept WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY sequence_no)""",
)
def context_within_page(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    kept = S.with_neighbours(S.blocks(table(spark, d, "documents")).join(good, "doc_id", "left_semi"), ("doc_id", "page_no"), ("sequence_no",))
    return kept.select("doc_id", "page_no", "sequence_no", F.sha2("previous", 256).alias("previous_sha256"), F.sha2("next", 256).alias("next_sha256"))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = rf"""tokens AS (SELECT doc_id, sequence_no, k AS pos, w[k + 1] AS token FROM (SELECT doc_id, sequence_no, w, unnest(range(len(w))) AS k FROM (
  SELECT doc_id, sequence_no, list_filter(regexp_extract_all(lower(content), '(\p{{L}}+)'), lambda x: len(x) >= 2 AND x NOT IN ({STOP})) AS w FROM blocks)))"""


@query("token_frequency_topk", f"WITH {BLOCKS}, {TOKENS}, c AS (SELECT token, count(*) AS n, min((doc_id, sequence_no, pos)) AS first FROM tokens GROUP BY token ORDER BY n DESC, first LIMIT 500) SELECT token, n, round(least(0.99, 0.5 + n / 20.0), 4)::DOUBLE AS confidence FROM c WHERE n >= 2")
def token_frequency_topk(spark: SparkSession, d: str) -> DataFrame:
    return M.discover(S.blocks(table(spark, d, "documents"))).select("token", "n", F.round("confidence", 4).alias("confidence"))


@query("token_occurrences_cap20", f"WITH {BLOCKS}, {TOKENS} SELECT token, doc_id, sequence_no, pos::INTEGER AS pos, occurrence::INTEGER AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, sequence_no, pos) AS occurrence FROM tokens) WHERE occurrence <= 20")
def token_occurrences_cap20(spark: SparkSession, d: str) -> DataFrame:
    return M.occurrences(S.blocks(table(spark, d, "documents"))).select("token", "doc_id", "sequence_no", "pos", "occurrence")


def _part_terms(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), F.array(F.concat(F.lit("k"), (F.col("p_partkey") / 3).cast("int").cast("string"))).alias("aliases"), F.col("p_size").cast("long").alias("occurrences"))


PART_TERMS = "terms AS (SELECT p_name || ' ' || p_partkey AS name, 'k' || CAST(floor(p_partkey / 3) AS INTEGER) AS alias, p_size::BIGINT AS occurrences FROM part)"


@query("synonym_edges", f"WITH {PART_TERMS} SELECT t.name AS u, m.v FROM terms t JOIN (SELECT alias, min(name) AS v FROM terms GROUP BY alias) m USING (alias) WHERE t.name <> m.v")
def synonym_edges(spark: SparkSession, d: str) -> DataFrame:
    return M.shared_spellings(_part_terms(spark, d))


@query(
    "synonym_clusters",
    f"WITH {PART_TERMS}, g AS (SELECT alias, min(name) AS cluster FROM terms GROUP BY alias HAVING count(*) > 1) SELECT cluster, arg_min(name, (-occurrences, len(name), name)) AS standard, array_to_string(list_sort(list(name)), '|') AS members, count(*) AS size FROM terms JOIN g USING (alias) GROUP BY cluster",
)
def synonym_clusters(spark: SparkSession, d: str) -> DataFrame:
    terms = _part_terms(spark, d)
    return M.clusters(terms, M.shared_spellings(terms)).select("cluster", "standard", F.array_join("members", "|").alias("members"), "size")


@query("similar_names")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs among the first 2000 names of parts, suppliers and nations, as many as the operator compares."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "supplier").select("s_name")).union(table(spark, d, "nation").select("n_name"))
    return M.similar_names(names.distinct())


@query("suggested_synonyms")
def suggested_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all names of parts, nations and regions that are alike, the largest first; a name's rows are its occurrences."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).unionAll(table(spark, d, "nation").select("n_name")).unionAll(table(spark, d, "region").select("r_name"))
    terms = names.groupBy("name").agg(F.count("*").alias("occurrences")).withColumn("aliases", F.array(F.lower("name")))
    found = M.suggested_synonyms(terms, most_terms=None)
    return found.select("cluster", "standard", F.array_join("members", "|").alias("members"), "size", "similarity")


@query(
    "merge_alias_dedup",
    """WITH a AS (SELECT p_size AS term_id, 0 AS f, dense_rank() OVER (PARTITION BY p_size ORDER BY p_brand) AS p, p_brand AS alias FROM part UNION ALL SELECT p_size, p_partkey, 0, upper(p_name) FROM part UNION ALL SELECT p_size, p_partkey, 1, p_type FROM part UNION ALL SELECT p_size, p_partkey, 2, p_name FROM part)
SELECT term_id, arg_min(alias, (f, p)) AS alias FROM a GROUP BY term_id, lower(alias)""",
)
def merge_alias_dedup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    target = part.groupBy(F.col("p_size").alias("term_id")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    sources = part.select(F.col("p_partkey").alias("term_id"), F.col("p_size").alias("target_id"), F.upper("p_name").alias("name"), F.array("p_type", "p_name").alias("aliases"))
    return M.merged(target, sources)


@query("normalised_text", r"SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS digest FROM documents")
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalised(F.col("text")), 256).alias("digest"))


@query("slug", r"SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '_1' ELSE '' END), '[^\p{L}\p{N}_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 20), '[-_]+$', '') AS slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    """Names with full-width digits in places, which the compatibility form makes plain."""
    tail = F.when(F.col("p_partkey") % 3 == 0, "＿１").otherwise("")
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_brand", tail), 20).alias("slug"))


@query("secret_scan", r"""SELECT doc_id, contains(text, 'PRIVATE KEY-----') AND regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') AS private_key, doc_id % 5 = 0 AS database_password, doc_id % 5 = 2 AS windows_workspace FROM documents WHERE doc_id % 5 IN (0, 2) OR regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')""")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Patterns over texts of which some are given a password, a harmless placeholder or a workspace path."""
    k = F.col("doc_id")
    more = F.when(k % 5 == 0, F.concat(F.lit("\nDB_PASSWORD = s"), k.cast("string"))).when(k % 5 == 1, F.lit("\nDB_PASSWORD=change-me")).when(k % 5 == 2, F.concat(F.lit("\nC:\\Users\\u"), k.cast("string"), F.lit("\\Desktop"))).otherwise("")
    found = table(spark, d, "documents").withColumn("s", T.secrets(F.concat("text", more))).filter(F.size("s") > 0)
    return found.select("doc_id", *(F.array_contains("s", n).alias(a) for n, a in (("private_key", "private_key"), ("database_password", "database_password"), ("hardcoded_windows_workspace", "windows_workspace"))))


@query("redacted_settings", """SELECT event_id, '{"Api-Key":"***","list":[{"db_password":"***"},' || event_id || '],"nested":{"access_token":"***","model":"' || event_type || '"},"timeout":30}' AS shown FROM events""")
def redacted_settings(spark: SparkSession, d: str) -> DataFrame:
    setting = F.format_string('{"timeout": 30, "Api-Key": "%s", "nested": {"access_token": {"a": 1}, "model": "%s"}, "list": [{"db_password": null}, %s]}', F.col("event_type"), F.col("event_type"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", T.redacted_json(setting).alias("shown"))


@query("json_first_key", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.variety'), ''), nullif(json_extract_string(props, '$.k'), '')) AS found FROM events")
def json_first_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.first_key(F.col("props"), "variety", "k").alias("found"))


@query("missing_marker", "SELECT conv_id, turn, CASE WHEN role IS NULL OR role = '' OR role = 'system' THEN '——' ELSE role END AS shown FROM conversations")
def missing_marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.missing_as(F.when(F.col("role") != "system", F.col("role"))).alias("shown"))


@query("segment_join", r"SELECT n_nationkey, concat_ws(' | ', nullif(trim(CASE WHEN n_regionkey = 1 THEN ' ' ELSE n_name END), ''), nullif(r_name, 'ASIA')) AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def segment_join(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # one row per world region
    return both.select("n_nationkey", T.joined(" | ", F.when(F.col("n_regionkey") == 1, F.lit(" ")).otherwise(F.col("n_name")), F.nullif(F.col("r_name"), F.lit("ASIA"))).alias("path"))


@query("html_text", r"SELECT page_id, sha256(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS digest FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "), 256).alias("digest"))


@query("text_similarity")
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    after = F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = turns.withColumn("b", after).filter("b is not null")
    return both.select("conv_id", "turn", F.round(matcher_similarity("a", "b"), 6).alias("ratio"), F.round(partial_similarity("a", "b"), 6).alias("partial"))
