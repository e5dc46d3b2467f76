"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, divergence, hilbert, langid, neardup_vectors, periodic, phrases, pieces, pii, quality, simhash, syncmers, toxicity

CLASH = ("h", "words", "_id", "_a", "_b", "ids", "fp", "shard", "label", "kept", "items", "hits", "component", "node", "u", "v", "x", "at", "toxic_score", "pii_kinds", "_shard", "lang_pred", "lang_score", "quality_score", "n_words", "parts", "_fold", "_label", "word")
LONG = "lorem ipsum dolor sit amet " * 4000 + "x" * 50_000 + "1@" + "y" * 50_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", None, None, None),
    (3, None, "de", "b", None),
    (4, "", "fr", "b", 0),
    (5, "   \n\t ", "es", "b", 6),
    (6, LONG, "en", "c", len(LONG)),
    (None, "a row without an id", "en", "c", 19),
    (None, None, None, None, None),
    (7, "⁂ 12345 !!", "en", None, 10),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, None), (6, 1, 0), (None, 1, 1), (7, 0, 1), (4, 0, 0)]


@pytest.fixture(scope="module", params=["plain", "clashing", "empty"])
def docs(spark, request):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    if request.param == "clashing":
        d = d.withColumns({c: F.lit(c) for c in CLASH})
    return d.limit(0) if request.param == "empty" else d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, ""), (None, "lorem ipsum"), (4, "lorem ipsum"), (4, "lorem ipsum")], "item_id long, text string")


def size(d):
    return d.count()


def test_decontaminate(docs, benchmark):
    got = decontaminate.contamination(docs, benchmark).collect()
    assert len(got) == size(docs)
    by = {r.doc_id: r for r in got}
    if got:
        assert by[1].n_hit == by[1].n_words == 14 and by[1].items == ["1"] and by[1].contaminated
        assert by[3].n_words == by[4].n_words == 0 and not by[4].contaminated
        assert by[6].items == ["4"] and by[6].n_hit == 8000 and by[6].contaminated and by[6].n_words == 20_002
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and size(left) == (0 if not got else 6)


def test_decontaminate_without_items(docs, benchmark):
    assert not any(r.n_hit for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


def test_pii(docs):
    got = pii.pseudonymise(docs)
    assert size(got) == size(docs) and size(got.join(docs, ["doc_id", "text"], "left_anti").filter("doc_id is not null and text is not null")) == 0


def test_hilbert(docs, tmp_path):
    got = hilbert.assign(docs, 4).collect()
    counts = [sum(r.shard == s for r in got) for s in range(4)]
    assert sum(counts) == size(docs) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(counts))
    if got:
        hilbert.write_shards(docs, str(tmp_path / "out"), 4)
        back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
        assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
        same = [(r.shard, r.slot) for r in got if r.doc_id == 1]  # repeated rows keep apart slots
        assert len(set(same)) == 2


def test_toxicity(docs, labels):
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(docs, known)
        got = toxicity.score(docs, model)
        assert size(got.filter("toxic_score between 0 and 1")) == size(docs)
        civil = toxicity.keep_civil(docs, model)
        assert civil.columns == docs.columns and size(civil) == size(got.filter("toxic_score < 0.5"))
        if "toxic_score" in docs.columns:
            assert size(civil.filter("toxic_score != 'toxic_score'")) == 0  # the input's own column
        by = {}
        for r in got.select("doc_id", "text", "toxic_score").collect():
            by.setdefault(r.text, set()).add(r.toxic_score)
        assert all(len(s) == 1 for s in by.values()) and by.get(None, set()) == by.get("", set())  # equal texts score alike


def test_quality(docs, labels):
    for known in (labels, labels.limit(0)):
        got = quality.score(docs, known)
        assert size(got.filter("quality_score between 0 and 1")) == size(docs)
        assert len({r.quality_score for r in got.filter("doc_id = 1 or doc_id = 2").collect()}) <= 1  # one text, three rows


def test_phrases(docs):
    got = phrases.without_repeats(docs).collect()
    assert len(got) == size(docs)
    by = {r.doc_id: r for r in got}
    if got:
        assert by[2].n_removed == by[2].n_words == 14 and by[2].kept == ""
        assert by[1].n_removed == 0 and by[3].kept is None and by[4].kept == "" and by[6].n_removed == 0


def test_language(docs):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    if got:
        assert got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[7].lang_score == 0
        assert got[1].lang_pred in ("en", "de", "fr", "es")
    assert all(r.lang_pred == "und" for r in langid.predict(docs, None).collect())


def test_simhash(docs):
    got = simhash.components(docs).collect()
    assert len(got) == size(docs)
    by = {r.doc_id: r for r in got}
    if got:
        assert by[2].component_id == 1 and by[5].component_id == by[4].component_id == 3
        assert by[3].fingerprint == "0" * 16
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    if got:
        assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 0, 1, 3, 6, 7]


def test_pieces(docs):
    got = pieces.round_trip(docs.select("doc_id", "text")).collect()
    assert len(got) == size(docs) and all(r.exact is not False for r in got)
    assert {r.ids is None for r in got if r.doc_id == 3} <= {True}
    assert pieces.encode(docs).columns[-1] == "ids"


def test_periodic_runs(docs):
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == size(docs)
    by = {r.doc_id: r for r in got}
    if got:
        assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].collapsed is None and by[4].collapsed == ""
        assert [tuple(r) for r in by[6].runs] == [(0, 20_000, 5)] and by[6].n_words == 20_001 and by[1].runs == []


def test_divergence(docs):
    got = divergence.audit(docs).collect()
    pairs = [("en", s, t, 0) for s in ("", "a", "c") for t in ("", "a", "c") if s != t]  # too few documents for a term
    assert sorted((r.lang, r.source, r.item, r.value) for r in got) == (sorted(pairs) if size(docs) else [])


def test_syncmers(docs):
    got = syncmers.edited_likeness(docs).collect()
    assert len(got) == size(docs) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if got:
        by = {r.doc_id: r for r in got}
        assert by[1].fingerprint == by[2].fingerprint != by[6].fingerprint and by[2].near_next == 1 and by[6].n_chars == len(LONG)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage(spark, tmp_path, docs, labels, benchmark, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = stage(spark, docs, str(tmp_path))
    assert size(got) <= size(docs)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(c) for c in ("id", "u", "vec", "n")})
    got = neardup_vectors.near_duplicates(v).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[1].n_links == by[3].n_links == 3 and by[3].component_id == 1 and by[1].kept and not by[3].kept
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert by[None].kept and by[None].n_links == 0
    assert neardup_vectors.near_duplicates(v.limit(0)).count() == 0
