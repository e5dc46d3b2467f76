"""The similarity join of names: no pair is lost, few pairs are compared."""

import random

import pytest

from quarryline.functions import similarity as Y
from quarryline.operators import terms as M
from quarryline.plans import evidence


def drawn(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlucmfw", k=r.randint(2, 9))) for _ in range(n // 4)] + ["a", "red"]

    def typed(w):
        x = list(w)
        if r.random() < 0.5:
            x[r.randrange(len(x))] = r.choice("abcxyz")
        if r.random() < 0.3:
            x.insert(r.randrange(len(x) + 1), r.choice("aeiou"))
        return "".join(x)

    names = set()
    while len(names) < n:
        k = r.choices(words, k=r.randint(1, 4)) + ["green"] * (r.random() < 0.3)  # a token of a third of the names
        names.add(" ".join(k))
        if r.random() < 0.6:
            names.add(" ".join(r.sample([typed(x) if r.random() < 0.4 else x for x in k], len(k))))
    return sorted(names)


def pairs(names, least):
    plain = [" ".join(t.lower().split()) for t in names]
    return {(u, v): round(s, 6) for i, u in enumerate(names) for j, v in enumerate(names[i + 1 :], i + 1) if (s := Y.token_set_ratio(plain[i], plain[j])) >= least}


@pytest.mark.parametrize(("n", "least"), [(250, 50.0), (250, 60.0), (250, 67.0), (250, 95.0), (250, 100.0), (2000, 85.0)])
def test_no_pair_is_lost(spark, monkeypatch, n, least):
    monkeypatch.setattr(M, "KEY_ROWS", 20)  # many keys are split
    names = sorted({*drawn(n, n), "", "  ", "İstanbul x", "Green", "green  red", "RED green", "😀 b", "ß", "aaaa aaaa", "aaaaa"})
    df = spark.createDataFrame([(x,) for x in names] * 2 + [(None,)], "name string")
    assert {(r.u, r.v): round(r.similarity, 6) for r in M.similar_names(df, least, None).collect()} == pairs(names, least)
    if n == 2000:
        assert M.candidate_pairs(df.distinct().na.drop(), least).count() < 0.05 * len(names) ** 2 / 2


def test_candidates_grow_far_below_the_square(spark):
    few, many = (M.candidate_pairs(spark.createDataFrame([(x,) for x in drawn(n, 1)], "name string"), 85.0).count() for n in (400, 1600))
    assert many < 9 * few  # 16 times the pairs


def test_no_names(spark):
    assert M.similar_names(spark.createDataFrame([], "name string"), 85.0, None).count() == 0


def test_query_equals_all_pairs(spark, data):
    rows = evidence.suggested_synonyms(spark, data).collect()
    names = {r[0] for t, c in (("part", "p_name"), ("nation", "n_name"), ("region", "r_name")) for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).distinct().collect()}
    group = {n: n for n in names}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    same = {(u, v) for u in names for v in names if u < v and u.lower() == v.lower()}
    for u, v in [*pairs(sorted(names), 85.0), *same]:
        group[root(max(root(u), root(v)))] = min(root(u), root(v))
    want = {}
    for n in names:
        want.setdefault(root(n), set()).add(n)
    assert {frozenset(r.members.split("|")) for r in rows} == {frozenset(m) for m in want.values() if len(m) > 1}
    assert [r.size for r in rows] == sorted((r.size for r in rows), reverse=True)
