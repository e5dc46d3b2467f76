"""The latent space: against a full decomposition, kept and loaded again, used for texts it was not fitted on."""

import random

import numpy as np
import pytest

from quarryline.operators import semantics as M

TOPICS = ["yield acid ferment yeast".split(), "nation trade river border".split(), "water air cloud rain".split()]


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choices(TOPICS[i % 3], k=9) + ["common"]) for i in range(n)]


def dense(side, rows):
    out = np.zeros((len(rows), len(side.number)))
    for k, (at, w) in enumerate(side.rows(rows)):
        out[k, at] = w
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


@pytest.mark.parametrize("k", [3, 128])
def test_vectors_span_what_a_full_decomposition_does(spark, k):
    rows = texts(60, 1) + [None, "", "x"]
    space = M.fit(frame(spark, rows).repartition(5), components=k)
    a = dense(space.word, [t or "" for t in rows])
    want = np.linalg.svd(a, full_matrices=False)[2][: space.vectors.shape[1]]
    assert space.vectors.shape[1] == min(k, len(rows) - 1, len(space.word.number) - 1)
    one, two = a @ space.vectors, a @ want.T
    assert np.allclose(one @ one.T, two @ two.T, atol=1e-6)  # all products of places, and so all cosines


def test_features_are_the_most_frequent(spark):
    rows = ["aa bb", "aa cc aa", "bb aa", "dd"]
    assert M.features(frame(spark, rows), "word", 3) == {"aa": 3, "bb": 2, "aa bb": 1}
    assert M.features(frame(spark, rows), "char", 2) == {" a": 3, " aa": 3}


def test_counts_handed_on_early_change_nothing(spark, monkeypatch):
    rows = texts(40, 2)
    whole = M.features(frame(spark, rows), "char", 50)
    monkeypatch.setattr(M, "HELD", 7)
    assert M.features(frame(spark, rows), "char", 50) == whole


def test_a_space_is_kept_and_used_again(spark, tmp_path):
    units, terms = frame(spark, texts(30, 3) + [None, ""]), ["ferment yield", "rain cloud", "zzz"]
    space = M.fit(units, components=3)
    space.save(spark, str(tmp_path))
    again = M.Space.load(spark, str(tmp_path))
    one, two = ({r.id: r.scores for r in M.scores(units, terms, s).collect()} for s in (space, again))
    assert one == two and one[30] == one[31] == [0.0, 0.0, 0.0]
    assert all((s[0] > 0.5) == (i % 3 == 0) and (s[1] > 0.5) == (i % 3 == 2) and s[2] < 0.1 for i, s in one.items() if i < 30)
    new = {r.id: r.scores for r in M.scores(frame(spark, ["yeast and acid", "other"]), terms, again).collect()}
    assert new[0][0] > 0.5 > new[0][1] and new[1] == pytest.approx([0.0] * 3, abs=0.3)


def test_without_words_characters_count(spark, tmp_path):
    space = M.fit(frame(spark, ["a", "b c"]))
    space.save(spark, str(tmp_path))
    assert space.vectors is None and M.Space.load(spark, str(tmp_path)).vectors is None
    assert {r.id: r.scores[0] for r in M.scores(frame(spark, ["a", "c"]), ["a"], space).collect()} == {0: pytest.approx(1.0), 1: 0.0}
    assert M.scores(frame(spark, ["a"]).limit(0), ["a"], space).count() == 0
