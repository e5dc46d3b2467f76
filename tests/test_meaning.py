"""Grams counted many texts at a time, and the meaning of units told in one pass: against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import search as S
from quarryline.operators import semantics as M
from quarryline.plans import evidence as Q

TEXTS = ["", "a", "  ", "Ab ab, AB!", "x" * 50, "the nation of the water", "水和空气。 water", "\ud800 odd", "one two one two one"]


def plain(kind, text):
    if kind == "word":
        w = M.WORD.findall(text.lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return [w[i : i + n] for w in (f" {x} " for x in text.lower().split()) for n in range(2, min(5, len(w)) + 1) for i in range(len(w) - n + 1)]


def made(n, seed):
    r = random.Random(seed)
    return [" ".join("".join(r.choices("abcé水", k=r.randint(1, 4))) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["char", "word"])
@pytest.mark.parametrize("letters", [1 << 12, 3])
def test_tallies_are_plain_counts(monkeypatch, kind, letters):
    monkeypatch.setattr(M, "SENT", 70)
    monkeypatch.setattr(M, "LETTERS", letters)  # with few letters to a number, words are halved and then read one by one
    texts = [t for t in TEXTS if "\ud800" not in t] + made(60, 3)
    tally = M.Tally(kind)
    for part in (texts[:20], texts[20:21], texts[21:]):
        tally.add(part)
    n, df = Counter(), Counter()
    for batch in tally.emitted():
        for gram, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n[gram] += a
            df[gram] += b
    assert n == sum((Counter(plain(kind, t)) for t in texts), Counter()) and df == sum((Counter(set(plain(kind, t))) for t in texts), Counter())


@pytest.mark.parametrize("kind", ["char", "word"])
def test_rows_are_weighted_counts_of_known_grams(kind):
    texts = TEXTS + made(40, 5)
    names = sorted({g for t in texts for g in plain(kind, t)})[::2]
    side = M.Side(kind, {g: k for k, g in enumerate(names)}, np.linspace(1, 2, len(names)))
    words = side.words()
    for part in (texts[:9], texts[9:]):
        at, w, ends = side.matrix(part, words)
        for text, a, b in zip(part, np.r_[0, ends[:-1]], ends, strict=True):
            want = {side.number[g]: k * side.idf[side.number[g]] for g, k in Counter(plain(kind, text)).items() if g in side.number}
            length = math.sqrt(sum(x * x for x in want.values()))
            assert dict(zip(at[a:b].tolist(), w[a:b].tolist(), strict=True)) == pytest.approx({k: x / length for k, x in want.items()})


def test_units_of_one_file_are_spread_before_terms_join_them(spark, monkeypatch):
    units = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "id long, content string").coalesce(1)
    most = []
    monkeypatch.setattr(M, "fit", lambda texts, *_: most.append(texts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]))
    M.fit_with(units, "content", ["a term"])
    assert most[0] < 60


def test_units_are_scored_where_they_stand(spark):
    docs = spark.createDataFrame([(1, "water and air\nrain"), (2, "the nation\n\nthe air"), (3, None)], "doc_id long, text string")
    units = S.blocks(docs)
    terms = [S.Term("air and water"), S.Term("nation")]
    got = Q._meant(units, terms)
    assert got.columns == [*units.columns, "scores"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    want = {r.id: r.scores for r in M.semantic_scores(units.select(F.concat_ws(":", "doc_id", "sequence_no").alias("id"), F.col("content").alias("text")), [t.text for t in terms]).collect()}
    assert {f"{r.doc_id}:{r.sequence_no}": pytest.approx(r.scores) for r in got.collect()} == want and len(want) == 4
