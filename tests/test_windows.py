"""The windows that can reach a ratio: all of them are found, and little else is compared."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import similarity as Y
from quarryline.operators import search as S


def edited(r, term, letters):
    x = list(term)
    for _ in range(r.randint(0, 5)):
        at = r.randrange(len(x) + 1)
        if x and r.random() < 0.5:
            x.pop(min(at, len(x) - 1))
        else:
            x.insert(at, r.choice(letters))
    return "".join(x)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz ", "aé中😀 b"])
def test_ratios_equal_all_windows_compared(letters):
    r, reached = random.Random(letters), 0
    for _ in range(250):
        term, least = "".join(r.choices(letters, k=r.randint(1, 24))), r.choice([30, 50, 60, 82, 82, 90, 100])
        texts = []
        for _ in range(8):
            t = "".join(r.choices(letters, k=r.choice([0, 1, 3, 10, 30, 80])))
            at = r.randint(0, len(t))
            texts.append((t[:at] + edited(r, term, letters) + t[at:])[r.choice([0, 0, r.randint(0, 5)]) :])
        for text, got in zip(texts, Y.Windows(term, least).ratios(texts), strict=True):
            want = Y.best_window_ratio(term, text) if text else 0.0
            assert got == pytest.approx(want) if want >= least else np.isnan(got)
            reached += want >= least
    assert reached > 300


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", max_size=40), st.integers(1, 100))
def test_no_window_is_lost(term, text, least):
    want = Y.best_window_ratio(term, text) if text else 0.0
    got = Y.Windows(term, least).ratios([text])[0]
    assert got == pytest.approx(want) if want >= least - 1e-9 else np.isnan(got)


def test_few_windows_are_compared():
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(50)]
    texts[7] += " licenced under the apache license " + texts[8]
    windows = Y.Windows("licensed under the apache licence", 82.0)
    spans = windows.spans(texts)
    assert [k for k, _, _ in spans] == [7] and spans[0][2] - spans[0][1] < 100
    assert windows.ratios(texts)[7] > 82


def test_nulls_blanks_and_several_variants(spark):
    rows = [(1, "Yield of acid"), (2, None), (3, ""), (4, "the yeild"), (5, "unrelated"), (6, "ausbeuten")]
    units = spark.createDataFrame(rows, "id long, content string")
    got = {r.id: r.x for r in units.select("id", Y.reaching_similarity(["yield", "ausbeute"], 75.0)(F.lower("content")).alias("x")).collect()}
    assert got == {1: 100.0, 2: None, 3: None, 4: 80.0, 5: None, 6: 100.0}
    hits = S.scored(units.withColumns({"doc_id": F.col("id"), "page_no": F.lit(0), "sequence_no": F.lit(0)}), [S.Term("yield"), S.Term("acid")], "or", mode="fuzzy", fuzzy=75.0)
    want = {1: 100.0, 4: (80.0 + Y.best_window_ratio("acid", "the yeild")) / 2}
    assert {r.doc_id: r.score for r in hits.collect()} == pytest.approx(want)
