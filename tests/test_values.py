import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import similarity as Y
from quarryline.functions import text as T
from quarryline.operators import datasets as D
from quarryline.operators import evaluation as E
from quarryline.operators import modelling as M
from quarryline.operators import search as S
from quarryline.operators import tables as R
from quarryline.operators import terms as W
from quarryline.operators import values as V
from quarryline.plans import evidence, streams
from quarryline.streaming import jobs as J


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("12.5", ("number", 12.5, None, None, None, None, None)),
        ("10~20", ("range", None, None, None, 10.0, 20.0, 15.0)),
        ("3.25 ± 0.12", ("mean_sd", None, 3.25, 0.12, None, None, None)),
        ("0", ("number", 0.0, None, None, None, None, None)),
        ("10-20", ("range", None, None, None, -20.0, 10.0, -5.0)),
        ("10 - 20", ("range", None, None, None, 10.0, 20.0, 15.0)),
        ("none", None),
        (None, None),
        ("5 10", ("number", 5.0, None, None, None, None, None)),
        ("3 +/- 1", ("mean_sd", None, 3.0, 1.0, None, None, None)),
        ("10 ±", ("mean_sd", None, 10.0, None, None, None, None)),
        ("1~2~9", ("range", None, None, None, 1.0, 9.0, 1.5)),
        ("5～8", ("range", None, None, None, 5.0, 8.0, 6.5)),
        ("-5", ("number", -5.0, None, None, None, None, None)),
        ("5—", ("range", None, None, None, 5.0, 5.0, 2.5)),
    ],
)
def test_parsed(spark, raw, want):
    got = one(spark, V.parsed(F.lit(raw).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("raw", "m", "o", "want"),
    [("25", 1.0, 273.15, ("number", 298.15, None, None, None, None, None)), ("0~10", 1.8, 32.0, ("range", None, None, None, 32.0, 50.0, 41.0)), ("10±2", 1.8, 32.0, ("mean_sd", None, 50.0, 3.6, None, None, None)), ("0~10", -1.0, 0.0, ("range", None, None, None, -10.0, 0.0, -5.0))],
)
def test_converted(spark, raw, m, o, want):
    assert tuple(one(spark, V.converted(V.parsed(F.lit(raw)), F.lit(m), F.lit(o)))) == pytest.approx(want)


def test_dimensions(spark):
    d = one(spark, V.dimensions(F.lit("treatment: control at 24 h, 37°C, pH 6.5 and 180 rpm")))
    assert (d["treatment"], d["timepoint"], d["conditions"]) == ("control", "24h", ["37°C", "pH 6.5", "180 rpm"])
    d = one(spark, V.dimensions(F.lit("sample: B2 after 3 days, pH: 6.5, 200 r/min")))
    assert (d["treatment"], d["timepoint"], d["conditions"]) == ("B2", "3d", ["pH: 6.5", "200 r/min"])
    d = one(spark, V.dimensions(F.lit("处理组: A 发酵时间 48 h")))
    assert (d["treatment"], d["timepoint"]) == ("A", "48h")


def test_mined_values_keep_their_first_number(spark):
    got = one(spark, V.mined(F.lit("yield 10~20 %, YIELD is 3.25 ± 0.12 g/L, yield 3 +/- 1 mg/g, yield 37 kg, yield 48 days"), ["yield"]))
    assert [tuple(m) for m in got] == [("10", None), ("3.25 ± 0.12", "g/L"), ("3 +/- 1", "mg/g"), ("37", "k"), ("48", "d")]  # units have no right border


def test_units_and_significance(spark):
    assert one(spark, T.unit_token(F.lit(" ℃ ")) == T.unit_token(F.lit("°C")))
    assert one(spark, V.significance(F.lit("12.5ab"))) == "ab"
    assert one(spark, V.significance(F.lit("12.5 ab"))) is None


@pytest.mark.parametrize(("kind", "value", "want"), [("number", 0, True), ("boolean", False, True), ("string", "  ", False), ("string", None, False), ("array", [], False), ("array", [1], True)])
def test_present(spark, kind, value, want):
    column = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
    assert one(spark, V.present(kind, column)) is want


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarities():
    words = ["fermentation", "fermentation yield", "yield", "", "tempe", "temperature", "ratio of yield"]
    for a in words:
        for b in words:
            assert Y.common_length(a, b) == longest_common(a, b)
    assert Y.best_window_ratio("yield", "the fermentation yield was") == 100
    assert 0 < Y.best_window_ratio("yeild", "the fermentation yield was") < 100
    assert Y.best_window_ratio("", "x") == 0
    assert Y.token_set_ratio("fuzzy was a bear", "a bear fuzzy fuzzy was") == 100
    assert Y.token_set_ratio("a b", "c d") < 100


def test_window_ratios_of_blocks_equal_those_of_pairs():
    draw = random.Random(3)
    texts = ["".join(draw.choice("abé梦 ") for _ in range(n)) for n in (0, 1, 1, 2, 3, 5, 8, 13, 30, 70, 71)]
    pairs = [(a, b) for a in texts for b in texts]
    assert Y.best_window_ratios(pairs) == pytest.approx([Y.best_window_ratio(a, b) for a, b in pairs], abs=1e-9)


def test_text_similarity_reads_whole_texts(spark, tmp_path):
    same = "".join(chr(0x4E00 + i) for i in range(300))
    rows = [(1, 1, "user", same + "abc" * 50), (1, 2, "user", same + "xyz" * 50), (1, 3, "user", "q" * 250 + same), (1, 4, "user", None), (1, 5, "user", "q" * 250)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r for r in evidence.text_similarity(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 4} and got[4].ratio is None and got[4].partial is None
    assert got[1].ratio == round(600 / 900, 6) and got[1].partial == round(200 * 300 / 750, 6)
    assert got[2].ratio > 0.5 and got[2].partial == round(Y.best_window_ratio(rows[1][3], rows[2][3]), 6)


def test_search_modes(spark):
    docs = spark.createDataFrame([(1, "fermentaton yield\nother"), (2, "Fermentation Yield high"), (3, None), (4, "")], "doc_id long, text string")
    units = S.blocks(docs)
    term = [S.Term("fermentation yield")]
    assert [r.doc_id for r in S.search(units, term).collect()] == [2]
    assert sorted(r.doc_id for r in S.scored(units, term, mode="fuzzy").collect()) == [1, 2]
    assert S.scored(units, [S.Term("zz"), S.Term("yield")], "or").first()["score"] == 50
    near = {r.id: r.cosine for r in S.gram_tfidf(docs.select(F.col("doc_id").alias("id"), "text"), "fermentation yield").collect()}
    assert near[2] > near[1] > 0
    assert S.search(units, term, scope="document").first()["result_no"] == 1
    with pytest.raises(ValueError):
        S.scored(units, [])


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "甲。乙。\n\n丙\n丁\n \n　")], "doc_id long, text string")
    assert [r.content for r in S.paragraphs(docs).orderBy("sequence_no").collect()][:3] == ["甲。", "乙。", "丙\n丁"]


def test_top_terms_come_before_the_threshold(spark):
    text = " ".join(["alpha"] * 8 + ["beta"] * 5 + ["gamma"] * 3 + ["delta"])
    units = S.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r.token for r in W.discover(units, most=2, least=4).orderBy(F.desc("n")).collect()] == ["alpha", "beta"]
    assert [r.token for r in W.discover(units, most=10, least=6).collect()] == ["alpha"]


def test_clusters(spark):
    terms = spark.createDataFrame([("total acid", ["TA"], 10), ("titratable acidity", ["ta"], 3), ("pH", [], 5)], "name string, aliases array<string>, occurrences long")
    got = W.clusters(terms, W.shared_spellings(terms)).collect()
    assert [(r.standard, r.members) for r in got] == [("total acid", ["titratable acidity", "total acid"])]


def test_evaluation(spark):
    e = spark.createDataFrame([("a", 100.0), ("b", 1.0)], "id string, value double")
    a = spark.createDataFrame([("a", 101.9), ("c", 2.0)], "id string, value double")
    found = E.compared(e, a, E.number_ok(F.col("e.value"), F.col("a.value"), F.lit(None).cast("double"), F.lit(0.02)))
    assert {r.id: r.status for r in found.collect()} == {"a": "matched", "b": "missing", "c": "unexpected"}
    assert tuple(E.metric(found, "numbers").first()) == ("numbers", 1, 2, 0.5)
    assert E.metric(found.limit(0), "numbers").first()["score"] is None
    assert one(spark, E.text_ok(F.lit("24  H"), F.lit(" 24 h ")))
    assert not one(spark, E.number_ok(F.lit(1.0), F.lit(float("nan")), F.lit(9.0), F.lit(9.0)))


def test_content_hash_follows_values_not_order(spark):
    rows = [("d", i, f"note {i}") for i in range(50)]
    h = [D.content_hash(spark.createDataFrame(r, "v string, i long, note string"), ["v"], F.col("i"), F.col("note")).first()["content_hash"] for r in (rows, rows[::-1], [*rows[:-1], ("d", 49, "changed")])]
    assert h[0] == h[1] != h[2]


def test_freeze_issues(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id long")
    fields = spark.createDataFrame([("f", True)], "field string, is_required boolean")
    cells = spark.createDataFrame([(1, "f", None, 0.0, False, "doubtful")], "row_id long, field string, value_text string, value_number double, is_missing boolean, review_status string")
    assert sorted(map(tuple, D.freeze_issues(rows, fields, cells).collect())) == [(1, "f", "doubtful_value"), (2, "f", "required_value_missing")]


def test_numbering(spark):
    rows = spark.range(0, 100_000, 7).withColumnRenamed("id", "k")
    got = D.numbered(rows, "k").orderBy("k").collect()
    assert [r.row_no for r in got] == list(range(1, len(got) + 1))


def test_scaling_of_constants_and_metrics_of_one_row(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x double, y double")
    assert [r.x for r in M.standardised(rows, ["x"]).collect()] == [0, 0]
    assert [r.x for r in M.min_max(rows, ["x"]).collect()] == [0, 0]
    assert M.regression_metrics(rows.limit(1), "x", "y").first()["r2"] == 0


def test_groups_stay_together(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("g"))
    assert M.group_split(rows, "g", 0.3, 1).groupBy("g").agg(F.countDistinct("is_test").alias("n")).filter("n > 1").count() == 0


def test_upsert_and_unique(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, R.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert R.duplicates(old.union(new), "k").collect()[0]["k"] == 2


def test_throttle_judges_each_user_apart(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a user's state passes from batch to batch
    try:
        rows = [(i, f"2024-01-01 00:00:{i:02d}", user, "view") for i, user in enumerate([1, 21] * 4 + [2] * 7)]
        events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
        events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
        got = {r.event_id: (r.key, r.failures, r.blocked) for r in streams.login_throttle(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(8)] == [(user, n, False) for n in range(1, 5) for user in (1, 21)]
    assert [got[i] for i in range(8, 15)] == [(2, min(n, 5), n > 5) for n in range(1, 8)]


def test_throttle_blocks_after_five_failures(spark):
    rows = [(1, i, f"2024-01-01 00:{i:02d}:00", True) for i in range(7)] + [(1, 9, "2024-01-01 01:00:00", True)]
    attempts = spark.createDataFrame(rows, "key long, event_id long, ts string, failed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: (r.failures, r.blocked) for r in J.throttle(attempts).collect()}
    assert got[4] == (5, False) and got[5] == (5, True) and got[6] == (5, True) and got[9] == (1, False)


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i % 3, i, f"2024-01-01 00:{i:02d}:00", i % 4 != 0, float(i), "a" if i % 2 else "b") for i in range(50)]
    schema = "key long, event_id long, ts timestamp, failed boolean, value double, event_type string"
    batch = spark.createDataFrame(rows, "key long, event_id long, ts string, failed boolean, value double, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))

    def streamed(make, mode, name):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted(map(str, spark.table(name).collect()))

    assert streamed(J.throttle_stream, "append", "throttled") == sorted(map(str, J.throttle(batch).collect()))
    assert streamed(lambda s: J.windowed(s, "10 minutes"), "complete", "tumbled") == sorted(map(str, J.windowed(batch, "10 minutes").collect()))
