"""Project rules, terms, search and similarity on rows made by hand, and against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import similarity as Y
from quarryline.functions import text as T
from quarryline.operators import extraction as X
from quarryline.operators import layout as L
from quarryline.operators import ordering as O
from quarryline.operators import search as S
from quarryline.operators import semantics as M
from quarryline.operators import terms as W
from quarryline.operators import values as V
from quarryline.operators import workflow as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_texts(spark):
    assert one(spark, T.slug(F.lit("  Ｆull／Width__Name! "), 12)) == "full-width"
    assert one(spark, T.authors(F.lit("A; B，C, ；"))) == ["A", "B", "C"]
    assert one(spark, T.casefolded(F.lit("Straße"))) == "strasse" and one(spark, F.lower(F.lit("Straße"))) == "straße"
    assert one(spark, T.clamped(F.lit(120.0))) == 100 and one(spark, T.clamped(F.lit(-1.0))) == 0
    assert one(spark, T.merged_maps(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"))) == {"a": "1"}
    assert one(spark, T.redacted_json(F.lit('{"timeout": 30, "api_key": "s", "nested": {"access_token": "s", "model": "chat"}}'))) == '{"api_key":"***","nested":{"access_token":"***","model":"chat"},"timeout":30}'
    assert one(spark, T.redacted_json(F.lit("no json"))) is None
    found = {t: one(spark, T.secrets(F.lit(t))) for t in ("DB_PASSWORD=change-me", "db_password = x", "-----BEGIN EC PRIVATE KEY-----", r"C:\Users\me\Desktop\x", "plain")}
    assert list(found.values()) == [[], ["database_password"], ["private_key"], ["hardcoded_windows_workspace"], []]


def test_labels_of_a_figure(spark):
    rows = [("Yield", 200.0, 10.0), ("10", 5.0, 100.0), ("42.5", 250.0, 80.0), ("time (h)", 200.0, 150.0), ("rate", 10.0, 50.0), ("3 ± 1 %", 100.0, 20.0), ("series A", 300.0, 20.0)]
    d = spark.createDataFrame(rows, "t string, x double, y double")
    got = {r.t: r.c for r in d.select("t", L.label_classes(F.col("t"), F.col("x"), F.col("y"), F.lit(400.0), F.lit(200.0)).alias("c")).collect()}
    assert got == {"Yield": [], "10": [], "42.5": ["direct", "legend"], "time (h)": ["x_axis"], "rate": ["y_axis"], "3 ± 1 %": ["direct"], "series A": ["legend"]}


def test_numbering_and_shares(spark):
    rows = spark.createDataFrame([(i % 3, float(i)) for i in range(100)] + [(9, None), (8, 1.0)], "g int, v double")
    got = {r.g: r.v for r in O.at_share(rows, "g", "v", 0.95).collect()}
    want = {8: 1.0}
    for g in range(3):
        values = sorted(float(i) for i in range(100) if i % 3 == g)
        want[g] = values[max(0, int(len(values) * 0.95) - 1)]
    assert got == want
    assert O.numbered(rows.limit(0), ["g"], "n").count() == 0


def test_jobs_and_roles(spark):
    jobs = spark.createDataFrame([(1, "queued", 1, 5), (2, "queued", 9, 6), (3, "queued", 9, 4), (4, "running", 99, 1)], "job_id int, status string, priority int, queued_at int")
    assert [r.job_id for r in K.claimed(jobs, 2).collect()] == [3, 2]
    retry = spark.createDataFrame([(1, "failed", 2, 3), (2, "failed", 3, 3), (3, "cancelled", 0, 3), (4, "running", 0, 3)], "job_id int, status string, retry_count int, max_retries int")
    assert {r.job_id: (r.status, r.retry_count) for r in K.retried(retry).collect()} == {1: ("queued", 3), 2: ("failed", 3), 3: ("queued", 1), 4: ("running", 0)}
    members = spark.createDataFrame([(1, 1, "owner", "active"), (1, 2, "owner", "left"), (1, 3, "editor", "active"), (2, 1, "owner", "active"), (2, 2, "owner", "active")], "project_id int, user_id int, role string, status string")
    assert {(r.project_id, r.user_id): r.may_leave for r in K.guarded_owners(members).collect()} == {(1, 1): False, (1, 2): True, (1, 3): True, (2, 1): True, (2, 2): True}
    projects = spark.createDataFrame([(1, "active"), (2, "archived"), (3, "deleted"), (4, "active")], "project_id int, status string")
    state, audit = K.archived(projects, spark.createDataFrame([(1, True), (2, True), (3, True)], "project_id int, archive boolean"))
    assert {r.project_id: r.status for r in state.collect()} == {1: "archived", 2: "archived", 3: "deleted", 4: "active"}
    assert [tuple(r) for r in audit.collect()] == [(1, "archive")]


def test_reports_stay_in_their_project(spark):
    reports = spark.createDataFrame([(1, 7, 10, None), (2, 7, 11, 20), (3, 7, 99, 21)], "report_id int, project_id int, dataset int, run int")
    parts = {"dataset": spark.createDataFrame([(10, 7), (11, 8)], "k int, p int"), "run": spark.createDataFrame([(20, 7), (21, 7)], "k int, p int")}
    assert sorted(map(tuple, K.scope_issues(reports, parts).collect())) == [(2, "dataset", "other_project"), (3, "dataset", "not_found")]


def test_values_presence(spark):
    cells = spark.createDataFrame([("  ", None, None, []), (None, 0.0, None, None), (None, None, False, None), (None, None, None, [1]), (None, None, None, None), ("x", None, None, None)], "raw string, number double, flag boolean, items array<int>")
    assert [r.x for r in cells.select(V.any_present(cells).alias("x")).collect()] == [False, True, True, True, False, True]


def test_extraction_contexts(spark):
    cells = spark.createDataFrame([(1, 1, 0, 5, "T", None, c, 0, c, "header", h, []) for c, h in enumerate("ab")] + [(1, 1, 0, 5, "T", None, 10 + c, 1, c, "data", v, ["Head", h]) for c, (v, h) in enumerate(((" 4 ", "a"), (" ", "b")))], "version_id int, page_id int, page_no int, table_id int, title string, caption string, table_cell_id int, row int, column int, role string, text string, header_path array<string>")
    assert [(r.source_key, r.text, r.evidence, r.table_cell_id) for r in X.table_contexts(cells).collect()] == [("table=5:row=1", "T | Head / a: 4", "Head / a: 4", 10)]
    figures = spark.createDataFrame([(1, 1, 0, 3, None, "cap", 0.6, ["Yield", "10", ""], [("42.5", 0.0), ("7", 0.9)])], "version_id int, page_id int, page_no int, figure_id int, title string, caption string, confidence double, labels array<string>, direct_values array<struct<text:string,confidence:double>>")
    assert [(r.source_key, r.text, r.confidence) for r in X.figure_contexts(figures).orderBy("source_key").collect()] == [("figure=3:value=1", "cap | Yield | 42.5", 0.6), ("figure=3:value=2", "cap | Yield | 7", 0.9)]
    blocks = spark.createDataFrame([(1, 1, 0, 1, 1, "acid 3 +/- 1 mg/g"), (1, 1, 0, 2, 2, "treatment: K at 24 h"), (1, 2, 1, 3, 3, "yield 0")], "version_id int, page_id int, page_no int, block_id int, sequence_no int, content string")
    found = X.run("frozen", X.block_contexts(blocks), [X.Field("acid", ("acid",)), X.Field("yield", ("yield",))]).orderBy("source_key").collect()
    assert [(r.field, r.raw_value, r.raw_unit, r.number, r.sample_key) for r in found] == [("acid", "3 +/- 1", "mg/g", 3.0, "1:block=1:page=0:treatment=K:time=24h:acid:1"), ("acid", "3 +/- 1", "mg/g", 3.0, "1:block=2:page=0:treatment=K:time=24h:acid:1"), ("yield", "0", None, 0.0, "1:block=3:page=1:treatment=unspecified:time=unspecified:yield:1")]
    with pytest.raises(ValueError, match="frozen"):
        X.run("draft", X.block_contexts(blocks), [])
    assert X.extracted(X.block_contexts(blocks), []).count() == 0
    assert one(spark, X.is_footnote(F.lit(" note: x"))) and one(spark, X.is_footnote(F.lit("a) x"))) and not one(spark, X.is_footnote(F.lit("plain")))


def test_reviews_and_conversions(spark):
    records = spark.createDataFrame([(1, "pending", 2.0), (2, "pending", 3.0)], "record_id int, review_status string, number double")
    said = spark.createDataFrame([(1, "modified", 0.0), (2, "tampered", 9.0)], "record_id int, status string, number double")
    assert {r.record_id: (r.review_status, r.number) for r in X.reviewed(records, said).collect()} == {1: ("modified", 0.0), 2: ("pending", 3.0)}
    pending = spark.createDataFrame([(1, "pending", 5.0, None), (2, "applied", 6.0, 6.0), (3, "pending", 7.0, None)], "record_id int, status string, target_value double, normalised double")
    got = X.confirmed_conversions(pending, spark.createDataFrame([(1,), (2,)], "record_id int"))
    assert {r.record_id: (r.status, r.normalised) for r in got.collect()} == {1: ("applied", 5.0), 2: ("applied", 6.0), 3: ("pending", None)}


def test_hits_stand_with_their_best_block(spark):
    docs = spark.createDataFrame([(1, "nothing\nsome acid\nyield and acid yield\nthe yield\nend"), (2, "other\nlines"), (3, "acids\nyeild")], "doc_id long, text string")
    units = S.blocks(docs)
    terms = [S.Term("acid"), S.Term("yield", ("yeild",))]
    got = S.search(units, terms, "and", "document").orderBy("result_no").collect()
    assert [(r.result_no, r.doc_id, r.content, r.previous, r.next) for r in got] == [(1, 1, "some acid", "nothing", "yield and acid yield"), (2, 3, "acids", None, "yeild")]
    hits = S.search(units, terms, "or")
    assert [r.result_no for r in hits.orderBy("result_no").collect()] == list(range(1, hits.count() + 1))
    no = spark.createDataFrame([(1, False, "rejected")], "result_no long, is_included boolean, review_status string")
    kept = S.reviewed(hits, no)
    assert kept.filter("not is_included").count() == 1 and W.hit_texts(kept).count() == hits.count() - 1


def test_fuzzy_search_equals_brute_force(spark, data):
    units = S.blocks(spark.read.parquet(f"{data}/documents.parquet").filter("doc_id % 5 = 0")).cache()
    terms = [S.Term("licensed under the apache licence"), S.Term("tehre was")]
    for logic, test in (("or", any), ("and", all)):
        got = {(r.doc_id, r.sequence_no): round(r.score, 6) for r in S.scored(units, terms, logic, mode="fuzzy", fuzzy=62.0).collect()}
        want = {}
        for r in units.collect():
            text = r.content.lower()
            found = [100.0 if t.text in text else Y.best_window_ratios([(t.text, text)])[0] for t in terms]
            if test(x >= 62.0 for x in found):
                want[r.doc_id, r.sequence_no] = round(sum(found) / 2, 6)
        assert got == want


def test_similar_names_equal_brute_force(spark):
    names = ["abcdefghij", "xbcdefghij", "photosynthesis", "fotosynthesis", "total acid", "acid total", "TOTAL  acid number", "ph", "PH", "zinc", "zink", ""]
    d = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.u, r.v): round(r.similarity, 6) for r in W.similar_names(d, 85.0).collect()}
    norm = lambda t: " ".join(t.lower().split())
    want = {(u, v): round(s, 6) for u in names for v in names if u < v and (s := Y.token_set_ratio(norm(u), norm(v))) >= 85}
    assert got == want and ("abcdefghij", "xbcdefghij") in got and ("fotosynthesis", "photosynthesis") in got
    assert W.similar_names(d, 85.0, most=2).count() == 0


def test_suggested_synonyms(spark):
    terms = spark.createDataFrame([("total acid", ["TA"], 3), ("acid total", [], 10), ("titratable", ["ta"], 1), ("zinc", [], 5), ("zincs", [], 5), ("iron", [], 1)], "name string, aliases array<string>, occurrences long")
    got = [(r.standard, r.members, r.similarity) for r in W.suggested_synonyms(terms).collect()]
    assert got == [("acid total", ["acid total", "titratable", "total acid"], 100.0), ("zinc", ["zinc", "zincs"], round(100 * 8 / 9, 1))]
    assert len(W.suggested_synonyms(terms, most_clusters=1).collect()) == 1


def test_split_needs_two_children(spark):
    terms = spark.createDataFrame([(1, "a", "confirmed", True), (2, "b", "confirmed", True)], "term_id int, name string, status string, is_selected boolean")
    children = spark.createDataFrame([(11, 1, "a1"), (12, 1, "a2"), (21, 2, "b1")], "term_id int, parent_id int, name string")
    assert sorted(map(tuple, W.split(terms, children).collect())) == [(1, "a", "split", False), (2, "b", "confirmed", True), (11, "a1", "confirmed", True), (12, "a2", "confirmed", True)]


def brute_semantics(texts, terms, k=128):
    corpus = [*texts, *terms]

    def matrix(grams):
        names = sorted({g for t in corpus for g in grams(t)})
        x = np.zeros((len(corpus), len(names)))
        for i, t in enumerate(corpus):
            for g in grams(t):
                x[i, names.index(g)] += 1
        x *= np.log((1 + len(corpus)) / (1 + (x > 0).sum(axis=0))) + 1
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def chars(t):
        return [w[i : i + n] for w in (f" {w} " for w in t.lower().split()) for n in range(2, min(5, len(w)) + 1) for i in range(len(w) - n + 1)]

    def words(t):
        import re

        w = re.findall(r"\b\w\w+\b", t.lower())
        return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]

    c, w = matrix(chars), matrix(words)
    n = len(texts)
    k = min(k, len(corpus) - 1, w.shape[1] - 1)
    latent = w @ np.linalg.svd(w, full_matrices=False)[2][:k].T
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-300)
    return 0.45 * c[:n] @ c[n:].T + 0.55 * np.maximum(0, latent[:n] @ latent[n:].T)


def test_semantic_scores(spark):
    texts = ["Fermentation temperature strongly changed the product yield.", "The unrelated control discusses publication formatting.", "Temperature and yield of the fermentation", "Ångström units, 12 of them", ""]
    terms = ["fermentation yield", "publication control", "zzz"]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.scores for r in M.semantic_scores(units, terms).collect()}
    want = brute_semantics(texts, terms)
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-6)
    assert got[0][0] > got[1][0]
    assert [r.scores for r in M.semantic_scores(spark.createDataFrame([(1, "a")], "id long, text string"), ["a"]).collect()] == [[pytest.approx(1.0)]]  # no words: characters alone
    scored = units.join(M.semantic_scores(units, terms), "id").select(F.col("id").alias("doc_id"), F.col("text").alias("content"), "scores")
    hits = S.scored(scored, [S.Term(t) for t in terms[:2]], "or", mode="semantic", semantic="scores", semantic_least=0.18)
    assert {r.doc_id for r in hits.collect()} == {i for i in range(len(texts)) if want[i, :2].max() >= 0.18}
