"""Operators against brute force, round trips, held-out labels and the piece library."""

import re
import zlib
from functools import cache

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import agree
from pyspark.sql import functions as F

from quarryline.llm import hilbert, langid, neardup_vectors, phrases, pieces, pii, quality, queries, simhash, toxicity
from quarryline.operators.components import connected_components

SF01 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def documents(data):
    return duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' ORDER BY 1").fetchall()


def labelled(column):
    return duckdb.sql(f"SELECT d.doc_id, d.text, l.{column} FROM '{SF01}/documents.parquet' d JOIN '{SF01}/labels.parquet' l USING (doc_id) ORDER BY 1").fetchall()


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    agree(spark, queries.queries()[name], queries.oracle_sql()[name], data)


# 1 embeddings


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, 16))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 16)) * rng.choice([0.01, 0.1, 0.3], (n, 1))
    x[: n // 10] = centres[0] + rng.normal(size=(n // 10, 16)) * 0.05  # a dense group larger than a list
    return x.astype(np.float32), rng.integers(0, 2, n)


def test_vectors_against_brute_force(spark):
    x, label = clustered(600, 1)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(rows).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= neardup_vectors.THRESHOLD) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * link.sum()
    assert all(got[i].n_links <= n for i, n in enumerate(link.sum(axis=1)))


def test_links_and_components_of_dense_and_isolated_vectors_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "TILE", 64)
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    # Two groups of 40: cosines of about 0.999 inside and 0.985 between them, so that full lists of near ones hide the others.
    apart = np.cos(np.arccos(0.9851) / 2), np.sin(np.arccos(0.9851) / 2)
    groups = [apart[0] * basis[0] + side * apart[1] * basis[1] + rng.normal(size=(40, 64)) * 0.003 for side in (1, -1)]
    # Pairs just over and under the threshold, and vectors alone.
    ends = rng.normal(size=(150, 64))
    ends /= np.linalg.norm(ends, axis=1, keepdims=True)
    aside = rng.normal(size=(150, 64))
    aside -= (aside * ends).sum(axis=1, keepdims=True) * ends
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.where(np.arange(150) % 2, 0.9802, 0.9798)[:, None]
    x = np.concatenate([*groups, ends, cosine * ends + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= neardup_vectors.THRESHOLD) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    while (new := np.minimum(least, np.where(link, least[None], len(x)).min(axis=1))).tolist() != least.tolist():
        least = new
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in got} == {i: (int(link[i].sum()), int(c), i == c) for i, c in enumerate(least)}
    assert least[40] == 0 and link[:40, 40:80].any()


def exactly(spark, x, label):
    """Whether all four columns are those of brute force."""
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label, strict=True))]
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= neardup_vectors.THRESHOLD) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    while (new := np.minimum(least, np.where(link, least[None], len(x)).min(axis=1))).tolist() != least.tolist():
        least = new
    return {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in got} == {i: (int(link[i].sum()), int(c), bool(i == c)) for i, c in enumerate(least)}


@pytest.mark.parametrize("case", ["two dense groups", "clustered", "hub", "small buckets"])
def test_vectors_equal_brute_force_in_all_columns(spark, monkeypatch, case):
    rng = np.random.default_rng(3)
    if case == "two dense groups":  # all cosines across are about 0.985; every list is full of its own group
        basis, half = np.linalg.qr(rng.normal(size=(64, 64)))[0], np.arccos(0.985) / 2
        x = np.concatenate([np.cos(half) * basis[0] + side * np.sin(half) * basis[1] + rng.normal(size=(200, 64)) * 0.0015 for side in (1, -1)]).astype(np.float32)
        monkeypatch.setattr(neardup_vectors, "TILE", 128)
        assert exactly(spark, x, np.zeros(400, int))
    elif case == "hub":  # one vector links to 150 that do not link with each other
        basis = np.linalg.qr(rng.normal(size=(200, 200)))[0]
        spokes = np.cos(0.19) * basis[0] + np.sin(0.19) * basis[1:151]
        assert exactly(spark, np.concatenate([spokes, basis[:1], basis[160:]]).astype(np.float32), np.zeros(191, int))
    else:
        x, label = clustered(600, 1)
        if case == "small buckets":
            monkeypatch.setattr(neardup_vectors, "RUN", 32)
            monkeypatch.setattr(neardup_vectors, "TILE", 16)
            monkeypatch.setattr(neardup_vectors, "ATTEMPTS", 1)
        assert exactly(spark, x, label)


def test_lost_links_fail_the_job(spark, monkeypatch):
    x, label = clustered(200, 2)
    monkeypatch.setattr(neardup_vectors, "audit", lambda nodes, counts: 0.5)
    monkeypatch.setattr(neardup_vectors, "ATTEMPTS", 1)
    rows = spark.createDataFrame([(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="audited"):
        neardup_vectors.near_duplicates(rows)


def test_groups_of_a_key_are_whole_across_batches():
    import pyarrow as pa

    from quarryline.llm.common import keyed_groups

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4]
    for cut in range(1, 9):
        batches = pa.table({"k": keys}).to_batches(max_chunksize=cut)
        assert [t.column("k").to_pylist() for t in keyed_groups(iter(batches), "k", 9)] == [[1, 1], [2], [3] * 5, [4]]
        assert [len(t) for t in keyed_groups(iter(batches), "k", 3)] == [2, 1, 3, 2, 1]


def test_no_isolated_pair_is_lost(spark):
    rng = np.random.default_rng(11)
    ends, aside = rng.normal(size=(2, 8000, 64))
    ends /= np.linalg.norm(ends, axis=1, keepdims=True)
    aside -= (aside * ends).sum(axis=1, keepdims=True) * ends
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x = np.concatenate([ends, 0.9801 * ends + np.sqrt(1 - 0.9801**2) * aside]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = neardup_vectors.near_duplicates(vectors).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, 1, i % 8000) for i in range(16000)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(5, 5), (70, 3), (90, 91)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {70: 0, 90: 90, 91: 90}


# 3 personal data


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_feistel_is_a_bijection_without_fixed_points(n):
    f = pii.Feistel(b"k")
    out = [f.shift("t", n, x) for x in range(n)]
    assert sorted(out) == list(range(n)) and all(a != b for a, b in enumerate(out))
    assert [f.shift("t", n, y, -1) for y in out] == list(range(n))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("mail a.34@mail7.example.com,", ["email"]), ("4431070137110817 and 4431070137110818", ["card"]), ("+1 (017) 555-7713", ["phone"]), ("97.51.17.173 and 300.1.1.1", ["ip"]), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ["secret"]), ("2021-02-28 2021-02-30", ["date"]), ("123-45-6789 000-12-3456", ["ssn"]), ("DE89 3704 0044 0532 0130 00", ["iban"]), ("pi is 3.14, version 1.2, 12 apples", [])],
)
def test_pseudonyms(text, kinds):
    f = pii.Feistel(b"k")
    new, found = pii.replaced(text, lambda k, v: pii.pseudonym(k, v, f))
    assert found == kinds and (new != text) == bool(kinds)
    assert pii.replaced(new, lambda k, v: pii.pseudonym(k, v, f))[1] == kinds  # it still passes its check
    assert pii.replaced(new, lambda k, v: pii.pseudonym(k, v, f, -1))[0] == text


CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (f"{CARD} 12/26", [CARD]),
        (f"Ref 7 {CARD}", [CARD]),
        ("4111111111111111 123", ["4111111111111111"]),
        (f"2026 {CARD} 1111 123", [CARD]),
        (f"{CARD} 5500 0000 0000 0004", [CARD, "5500 0000 0000 0004"]),
        (f"2021-02-30 {CARD} 2021-02-28", [CARD, "2021-02-28"]),
        (f"{IBAN} EUR", [IBAN]),
        (f"AB12 {IBAN} BANK 12", [IBAN]),
        ("write to иван@example.com or ___@example.com", ["иван@example.com", "___@example.com"]),
    ],
)
def test_values_next_to_other_numbers(text, values):
    for key in (b"k", b"l", b"m", *(b"%d" % i for i in range(40))):
        f = pii.Feistel(key)
        new, found = pii.replaced(text, lambda k, v, f=f: pii.pseudonym(k, v, f))
        assert len(new) == len(text) and len(found) == len(values) and all(v not in new for v in values)
        rest, at = re.split("|".join(map(re.escape, values)), text), 0
        for part, value in zip(rest, [*values, ""], strict=True):  # what stands between the values stays
            assert new[at : at + len(part)] == part
            at += len(part) + len(value)
        assert pii.replaced(new, lambda k, v, f=f: pii.pseudonym(k, v, f, -1))[0] == text


def test_equal_values_stay_linked(spark):
    d = spark.createDataFrame([(1, "x 97.51.17.173"), (2, "97.51.17.173 y"), (3, "97.51.17.174")], "doc_id long, text string")
    got = [re.search(r"\d+\.\d+\.\d+\.\d+", r.text).group() for r in pii.pseudonymise(d).orderBy("doc_id").collect()]
    assert got[0] == got[1] != got[2]
    assert sorted(map(str, pii.reveal(pii.pseudonymise(d, b"s", kinds=None), b"s").collect())) == sorted(map(str, d.collect()))


# 4 sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.curve_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_follow_the_curve(spark, data):
    got = queries.op4_hilbert_shards(spark, data).toPandas().sort_values(["shard", "slot"])
    assert got.hilbert.is_monotonic_increasing and got.groupby("shard").size().between(5, 5).all()
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall())
    assert (got["size"] == [16 + len(text[i].encode()) for i in got.doc_id]).all()
    assert (got["text_crc32"] == [zlib.crc32(text[i].encode()) for i in got.doc_id]).all()


# 5, 6, 8 classifiers


def test_toxicity_held_out():
    rows = labelled("toxic")
    learn, test = ([r for r in rows if (crc(r[0]) % 5 == 0) == held] for held in (False, True))
    model = toxicity.train([r[1].encode() for r in learn], np.array([r[2] for r in learn]))
    said, y = np.array(toxicity.logits([r[1].encode() for r in test], model, {})), np.array([r[2] for r in test])
    assert ((said > 0) == y).mean() > 0.95 and (said[y == 0] > 0).mean() < 0.03
    hidden, plain = toxicity.Model.words(model, [b"idiott", b"stupidd", b"that", b"with"])[:2], toxicity.Model.words(model, [b"that", b"with"])
    assert min(hidden) > max(plain)


def test_quality_held_out():
    rows = labelled("quality")
    x, y, held = np.array([quality.text_statistics(r[1].encode()) for r in rows]), np.array([r[2] for r in rows]), np.array([crc(r[0]) % 3 == 1 for r in rows])
    own = [x[~held & (y == c)] for c in (0, 1)]
    model = quality.from_sums(np.array([len(o) for o in own]), np.array([o.sum(axis=0) for o in own]), np.array([o.T @ o for o in own]))
    assert ((model.log_ratio(x[held]) > 0) == y[held]).mean() > 0.98
    assert model.log_ratio(own[1].mean(axis=0)[None])[0] > 0


def test_quality_sums_match_a_direct_fit(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.statistics(docs), labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    x = np.array([quality.text_statistics(r.text.encode()) for r in rows if crc(r.doc_id) % 3 != 1 and r.quality == 1])
    assert np.allclose(model.means[1], x.mean(axis=0))


def test_language_held_out():
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF01}/documents.parquet' ORDER BY doc_id LIMIT 3000").fetchall()
    learn, test = ([r for r in rows if (crc(r[0]) % 5 == 0) == held] for held in (False, True))
    model = langid.train([r[1].encode() for r in learn[:1500]], [r[2] for r in learn[:1500]])
    p = langid.text_probabilities([r[1].encode() for r in test], model)
    assert np.mean([model.languages[k] == r[2] for k, r in zip(p.argmax(axis=1), test, strict=True)]) > 0.98


def test_compiled_network_equals_plain_convolution():
    model = langid.train([b"abc " * 200, "äöü ".encode() * 200], ["x", "y"])
    x = langid.windows(b"some abc text " * 40)
    pooled = [sum(t[j][x[:, j : langid.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) for t, w in zip(model.tables, langid.WIDTHS, strict=True)]
    want = langid._softmax(np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0) @ model.out + model.out_bias)
    assert np.allclose(model.probabilities(x), want, atol=1e-5)


# 7 repeated phrases


def shortened(rows):
    first, words = {}, [(i, t.encode().split() if t else []) for i, t in sorted(rows)]
    for i, w in words:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        yield i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()


def test_phrases_against_brute_force(spark, documents):
    made = [(10_000, "from " * 40), (10_001, "a b " + "from " * 30 + "c"), (10_002, " ".join(f"w{i}" for i in range(60))), (10_003, "x " + " ".join(f"w{i}" for i in range(20, 45)) + " y " + " ".join(f"w{i}" for i in range(5, 17)))]
    rows = [*documents, *made]
    got = phrases.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(shortened(rows))


def test_word_hashes_follow_words():
    texts = [b"one two  one", b"", b"two\tthree\x0bone ", b"   "]
    h, of = phrases.word_hashes(texts, phrases.Powers())
    assert of.tolist() == [0, 0, 0, 2, 2, 2] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


def halves(first, second, n):
    """Two words of 2**n letters, alternating as the parity of a place's bits, that a polynomial modulo 2**64 confuses."""
    return tuple("".join((a, b)[i.bit_count() % 2] for i in range(1 << n)) for a, b in ((first, second), (second, first)))


@pytest.mark.parametrize("n", [10, 11, 13])
def test_phrases_with_words_of_one_hash(spark, n):
    x, y = halves("a", "b", n)
    powers = phrases.Powers()
    h, _ = phrases.word_hashes([f"{x} {y}".encode()], powers)
    g = phrases.other_hashes([f"{x} {y} {x}".encode()])
    assert h[0] == h[1] and g[0] == g[2] != g[1]
    start = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{start} {x}"), (2, f"{start} {y}"), (3, f"{start} {y}")]
    got = phrases.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(shortened(rows))
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}


# 9 SimHash


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, documents):
    rows = [*documents, (9_000, documents[3][1] + " more"), (9_001, documents[3][1].upper()), (9_002, None)]
    got = {r.doc_id: r for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: print_of(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: (got[i].fingerprint, got[i].component_id) for i in ids} == {i: (f"{prints[i]:016x}", root(i)) for i in ids}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_near_pair_shares_a_triple_and_a_second_key(x, flips):
    y = x ^ sum(1 << b for b in flips)
    same = [p for p in range(8) if (x >> 8 * p & 255) == (y >> 8 * p & 255)]
    if len(flips) <= 3:
        hit = [t for t in simhash.TRIPLES if set(t) <= set(same)]
        assert hit and all(len([p for p in same if p not in t]) >= 2 for t in hit)
    assert simhash.near(np.array([x], np.uint64), np.array([y], np.uint64))[0] == (len(flips) <= 3)


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 63, n)) for b in base for n in rng.integers(0, 5, 60)})
    monkeypatch.setattr(simhash, "LIST_MOST", 10)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    near = np.bitwise_count(np.array(prints, np.uint64)[:, None] ^ np.array(prints, np.uint64)) <= 3
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None], len(prints)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert all(got.get(p, p) == prints[k] for p, k in zip(prints, label, strict=True))


# 10 pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_table(), True)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), np.int32).tolist()


def test_pieces_equal_the_library(codec, library, documents):
    texts = [t for _, t in documents] + [" " * k + "a" * j + " " * k for k in range(40) for j in range(3)]
    assert [ids(codec, t) for t in texts] == library.encode(texts, num_threads=1)
    assert [codec.decode(np.array(ids(codec, t), np.int32)) for t in texts] == texts


@cache
def both():
    return pieces.Codec(pieces.read_table(), True), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinst \n12éß梦\x00<>0x\U0001f600", max_size=60))
def test_pieces_equal_the_library_on_odd_texts(text):
    c, p = both()
    assert ids(c, text) == p.encode(text) and c.decode(np.array(ids(c, text), np.int32)) == text


def test_units_end_where_no_piece_goes_on(codec, library):
    """A word is remembered once, whatever follows it, and the library's ids do not change."""
    c = pieces.Codec(pieces.read_table(), True)
    ends = ["", ".", ",", "!!", ".\n", "\n\n", "&&&", ")", "7", "\U0001f600", "...", "▁▁"]
    texts = [" ".join(w + e for w in ("ciónmenteuega", "etxFe", "größe")) + e for e in ends] + [e + "one" + e + "two " + e for e in ends[1:]]
    assert [ids(c, t) for t in texts] == library.encode(texts, num_threads=1)
    words = [u for u in c.units if any(x.isalpha() for x in u)]
    assert {u.strip("▁") for u in words} == {"ciónmenteuega", "etxFe", "größe", "one", "two"}
    assert "".join(pieces.kinds(["▁ab", "bc", "xx", "..", ".)", "q"])) == "abc).x"


def test_characters_alone_relax_last():
    """Pieces of one character compete by score in a unigram model, and are what remains in a BPE model."""
    table = [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -1.0, 0), ("a", -1.0, 0), ("b", -1.0, 0), ("ab", -3.0, 0), ("ba", -1.5, 0)]
    assert ids(pieces.Codec(table, False), "ab") == [1, 2, 3] and ids(pieces.Codec(table, False), "ba?b") == [1, 5, 0, 3]
    assert ids(pieces.Codec(table, True), "ab") == [1, 4] and ids(pieces.Codec(table, True), "aba?") == [1, 2, 5, 0]


def test_unigram_path_is_the_best_of_all():
    table = [("<unk>", 0.0, pieces.UNKNOWN), ("▁a", -2.0, 0), ("b", -1.5, 0), ("▁ab", -4.0, 0), ("bc", -2.5, 0), ("c", -3.0, 0), ("abc", -1.0, 0), ("▁", -0.5, 0)]
    c = pieces.Codec(table, False)
    scores = {p: s for p, s, k in table if k == 0}

    def best(text):
        if not text:
            return 0.0
        return max([scores[p] + best(text[len(p) :]) for p in scores if text.startswith(p)] + [c.unknown_score + best(text[1:])])

    for text in ("abc", "ab", "cab", "zabcz", "abcabc"):
        got = ids(c, text)
        assert sum(table[i][1] if i else c.unknown_score for i in got) == pytest.approx(best("▁" + text))


def test_driver_columns(spark, data):
    want = {"op1": {"vec_id", "n_links", "component_id", "kept"}, "op4": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op5": {"doc_id", "held_out", "score", "predicted"}, "op6": {"doc_id", "held_out", "score", "predicted"}, "op7": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op8": {"doc_id", "held_out", "lang_pred", "score"}, "op9": {"doc_id", "fingerprint", "component_id"}}
    for name, q in queries.queries().items():
        if name.split("_")[0] in want:
            got = q(spark, data)
            assert want[name.split("_")[0]] <= set(got.columns)
            assert got.count() == spark.read.parquet(f"{data}/{'embeddings' if name.startswith('op1_') else 'documents'}.parquet").count()


def test_pipeline_keeps_what_each_stage_should(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    planted = spark.createDataFrame([(10**6, bench, "en", "s", len(bench)), (10**6 + 1, docs.filter("doc_id = 0").first()["text"], "en", "s", 1)], docs.schema)
    every = docs.unionByName(planted)
    distinct = corpus_pipeline.distinct(spark, every, data)
    assert distinct.filter(F.col("doc_id") == 10**6 + 1).count() == 0
    clean = corpus_pipeline.uncontaminated(spark, every, data)
    assert clean.filter(F.col("doc_id") == 10**6).count() == 0
    assert corpus_pipeline.run(spark, data).filter("exact is null or not exact").count() == 0
