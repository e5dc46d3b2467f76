"""Periodic runs, source divergence and syncmer fingerprints against plain Python and on hand-made rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import agree
from pyspark.sql import functions as F

from quarryline.llm import divergence, periodic, queries, syncmers

# 11 periodic runs


def every_run(words):
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(12, 2 * p):
                out.setdefault((start, i - start + p), p)
            i += i == start
    return sorted((s, n, p) for (s, n), p in out.items())


def drawn(r):
    n, kinds = r.randint(0, 90), r.choice([1, 2, 2, 3, 5])
    words = [r.randrange(kinds) for _ in range(n)]
    if n and r.random() < 0.6:
        q, s = r.randint(1, 12), r.randrange(n)
        for i in range(s + q, min(n, s + r.randint(10, 60))):
            words[i] = words[i - q]
    return words


@pytest.mark.parametrize(("table", "few", "piece"), [(4096, 64, 1 << 16), (5, 0, 7), (5, 64, 3), (4096, 0, 9)])
def test_runs_equal_all_periods_tried(monkeypatch, table, few, piece):
    for name, value in (("TABLE_WORDS", table), ("FEW", few), ("PIECE", piece), ("_grid", [])):
        monkeypatch.setattr(periodic, name, value)
    r = random.Random(table + few + piece)
    for _ in range(500):
        words = drawn(r)
        assert periodic.runs(np.array(words, np.int32)) == every_run(words)


@pytest.mark.parametrize(
    ("words", "runs"),
    [
        ([0] * 100_000, [(0, 100_000, 1)]),
        ([0, 1] * 50_000, [(0, 100_000, 2)]),
        (([0] * 30_000 + [1]) * 3, [(0, 30_000, 1), (0, 90_003, 30_001), (30_001, 30_000, 1), (60_002, 30_000, 1)]),
        (list(range(50_000)) * 2 + [7] * 3, [(0, 100_000, 50_000)]),
        (list(range(100_000)), []),
        ([3] * 11, []),
        ([3] * 12, [(0, 12, 1)]),
        ([1, 2, 3, 4, 5, 6] * 2, [(0, 12, 6)]),
        ([9, 1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5, 6, 7, 1, 8], [(1, 15, 7)]),
    ],
)
def test_runs_of_long_and_short_texts(words, runs):
    assert periodic.runs(np.array(words, np.int32)) == runs


def test_words_after_the_first_period_go(spark):
    text = "x  a b\tc a b c a b c a b c y z z z z z z z z z z z z"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(rows).withColumn("list", periodic.listed(F.col("runs"))).withColumn("top", periodic.longest(F.col("runs"))).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 12, 3), (14, 12, 1)] and got[1].list == "1,12,3\n14,12,1\n"
    assert got[1].collapsed == "x a b c y z" and (got[1].top.start, got[1].top.length) == (1, 12)  # ties: smallest start
    assert got[2].collapsed is None and got[2].n_words == 0 and got[3].collapsed == "" and got[2].top is None and got[2].list == ""


def test_planted_texts_are_periodic(spark, data):
    got = {r.doc_id: r for r in queries._planted(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    old = dict(duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall())
    import zlib

    seen = 0
    for i, text in old.items():
        h, w = zlib.crc32(str(i).encode()), (text or "").encode().split()
        if h % 10 or not w:
            assert got[i].text == text
            continue
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert got[i].text.encode().split() == [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        seen += 1
    assert seen > 5


@pytest.mark.parametrize("text", ["", " \n\t", None, "one", "a b " * 40])
def test_drawn_ids_of_any_text(spark, tmp_path, text):
    """Ids drawn for planting may have texts without words."""
    rows = [(i, text) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("part-*")).rename(tmp_path / "documents.parquet")
    agree(spark, queries.op11_periodic_runs, queries.PERIODIC_SQL, str(tmp_path))


# 12 source divergence


def plain_audit(rows, least, top):
    """The audit by Python's own integers, from the definition."""
    from collections import Counter, defaultdict

    of, have, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        groups.add((lang, source))
        of[lang, source].update(terms)
        have[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in have[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        all_ = Counter()
        for s in sources:
            all_.update(of[lang, s])

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        ps, q = {s: p(of[lang, s]) for s in sources}, p(all_)
        for s in sources:
            pairs = sorted(((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - ps[s][t], t.encode(), t) for t in kept if of[lang, s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize(("terms", "groups", "held"), [(512, 128, 400_000), (3, 2, 10), (1, 1, 1)])
def test_audit_equals_the_definition(spark, monkeypatch, terms, groups, held):
    """Many blocks of terms and groups, and counts handed on after each slice, change nothing; ties are by UTF-8."""
    for name, value in (("BLOCK_TERMS", terms), ("BLOCK_GROUPS", groups), ("HELD", held), ("LEAST_DOCUMENTS", 3), ("TOP", 4)):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(7)
    words = ["Aa", "b", "ß", "É", "é", "中", "😀", "￮", "zz", "Q-q", "x1y", "rare"]
    rows = [(" ".join(r.choices(words, weights=range(1, 13), k=r.randint(0, 12))), r.choice(["en", "de", None, ""]), r.choice(["s0", "s0", "s0", "s1", "s2", None, "é"])) for _ in range(120)]
    rows += [(None, "en", "s9"), ("", "fr", "s0"), ("only", "fr", "s1"), (None, "xx", None), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    got = sorted(tuple(x) for x in divergence.audit(docs).collect())
    assert got == plain_audit(rows, 3, 4)


def test_large_counts_are_exact():
    n, total, kept = np.array([9 * 10**15, 12345678901234]), np.array([9 * 10**15 + 17]), 10**9
    assert divergence.shares(n, total, kept).tolist() == [1 + 10**9 * (int(c) + 5) // (int(total[0]) + 5 * kept) for c in n]


# 13 fingerprints


def mixed(*values):
    """XXH64 as Spark folds it over columns: each value seeds the next one."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def printed(text):
    """Number of tokens, and the place of each of the anchors of least hash."""
    tokens = re.findall("[0-9A-Za-z\x80-⿿]{1,24}|[^\x00-\x20]", (text or "").lower())
    h = [mixed(t) for t in tokens]
    if not h:
        return 0, {}
    if len(h) < 5:
        return len(h), {(mixed(" ".join(tokens)) % (1 << 64)) >> 28: 0}
    two = [mixed(a, b) for a, b in zip(h, h[1:])]
    four = [mixed(a, b) for a, b in zip(two, two[2:])]
    found = {}
    for i in range(len(h) - 4):
        inner = two[i : i + 4]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault((mixed(four[i], h[i + 4]) % (1 << 64)) >> 28, i)
    return len(h), dict(sorted(found.items())[: syncmers.KEPT])


def alike(a, b):
    (n, one), (m, other) = a, b
    union = sorted(set(one) | set(other))[: syncmers.KEPT]
    offsets = sorted(other[h] - one[h] for h in union if h in one and h in other)
    if not union:
        return 1.0
    if not offsets:
        return 0.0
    middle = offsets[len(offsets) // 2]
    return sum(abs(o - middle) <= 8 + max(n, m) // 8 for o in offsets) / len(union)


def shown(p):
    return f"{p[0]:x}:" + "".join(f"{(h << syncmers.PLACE_BITS) | at:016x}" for h, at in p[1].items())


def same_as_plain(got, texts):
    order = sorted(texts, reverse=True)
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        text, then = texts[i] or "", texts[following] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + then[:third]
        a, b, c = printed(text), printed(edited), printed(then)
        assert tuple(got[i]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), pytest.approx(alike(a, b)), pytest.approx(alike(a, c)))


def test_fingerprints_equal_plain_ones(spark, data):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in queries.op13_syncmers(spark, data).collect()}
    assert got.keys() == texts.keys()
    same_as_plain(got, texts)
    near = sorted(r.near_edited for r in got.values())
    assert 0.4 < near[len(near) // 2] < 0.6 and sum(r.near_next for r in got.values()) < 0.02 * len(got)


def test_fingerprints_of_odd_texts(spark):
    texts = {1: "a", 2: None, 3: "", 5: "a b c d", 8: "😀😀 日本語の文章です。 x" * 9, 9: "w " * 900, 13: "Z" * 100, 21: "one two three four five six seven", 34: "one two three four five six seven", 35: "\t\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_i", "_a", "_n", "own", "next", "_tokens")})
    got = {r.doc_id: r for r in syncmers.edited_likeness(docs.repartition(4)).collect()}
    same_as_plain(got, texts)
    assert got[34].near_next == 1.0 and got[34].fingerprint == got[21].fingerprint and got[2].fingerprint == got[3].fingerprint


def test_a_passage_has_its_anchors_anywhere(spark):
    r = random.Random(1)
    passage = " ".join(r.choices([f"w{i}" for i in range(500)], k=60))
    rows = spark.createDataFrame([(1, f"{passage} " + "left " * 7), (2, "other words before it " * 3 + passage)], "doc_id long, text string")
    one, two = ({x >> syncmers.PLACE_BITS for x in r.f.anchors} for r in syncmers.fingerprinted(rows, "text", "f").collect())
    known = {h for h in printed(passage)[1]}
    assert known <= one and known <= two and len(known) > 20


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x w v u"), (None, "n"), (None, None)]
    got = syncmers.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2
    same = [tuple(r) for r in got if r.doc_id == 1 and r.fingerprint == shown(printed(rows[0][1]))]
    assert len(same) == 2 and same[0] == same[1]
    alone = syncmers.edited_likeness(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    assert syncmers.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_source_divergence"])
def test_sql_of_odd_rows(spark, tmp_path, name):
    """Queries and their SQL agree on null and empty texts, repeated rows and a table without rows."""
    rows = [(1, "a " * 40, "en", "s"), (1, "a " * 40, "en", "s"), (None, "b c " * 30, "en", None), (2, None, None, "s"), (3, "", "", "s"), (30, " x y z" * 8, "en", "t")]
    for k, some in enumerate((rows, rows * 40, [])):
        folder = tmp_path / str(k)
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(folder / "out"))
        next((folder / "out").glob("part-*")).rename(folder / "documents.parquet")
        agree(spark, queries.queries()[name], queries.oracle_sql()[name], str(folder))
