"""Registered queries and the pipeline against plain Python over the whole smallest tables, and finds against planted ones."""

import random
import re
import time
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from test_results import crc, print_of, shortened

from quarryline.llm import hilbert, langid, pieces, pii, quality, queries, toxicity


@pytest.fixture(scope="module")
def docs(data):
    return {r[0]: r for r in duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{data}/documents.parquet' ORDER BY 1").fetchall()}


@pytest.fixture(scope="module")
def labels(data):
    return duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{data}/labels.parquet' ORDER BY 1").fetchall()


# 3 personal data


def card(draw):
    body = [draw.choice("456")] + [draw.choice("0123456789") for _ in range(14)]
    number = "".join(body)
    return number + next(c for c in "0123456789" if pii.luhn(number + c))


PLANTED = {
    "email": lambda d: f"{d.choice(['ann', 'иван', 'li.wei', 'x_1'])}{d.randint(0, 99)}@{d.choice(['mail', 'a-b.host'])}.example.{d.choice(['com', 'org'])}",
    "card": card,
    "ssn": lambda d: f"{d.randint(100, 665)}-{d.randint(10, 99)}-{d.randint(1000, 9999)}",
    "ip": lambda d: ".".join(str(d.randint(0, 255)) for _ in range(4)),
    "date": lambda d: f"{d.randint(1900, 2099)}-{d.randint(1, 12):02d}-{d.randint(1, 28):02d}",
    "phone": lambda d: d.choice([f"+1 ({d.randint(200, 999)}) 555-{d.randint(1000, 9999)}", f"{d.randint(200, 999)}-{d.randint(200, 999)}-{d.randint(1000, 9999)}"]),
    "iban": lambda d: (lambda b: f"DE{98 - pii.mod97('DE00' + b):02d}{b}")("".join(d.choice("0123456789") for _ in range(18))),
    "secret": lambda d: d.choice(['"{}"', "api_key = {}"]).format("".join(d.choice("0123456789abcdef") for _ in range(40))),
}
NOISE = ["the river", "version 1.2", "pi is 3.14", "12 apples", "no. 7", "300.1.1.1", "2021-02-30", "000-12-3456", "4431070137110818", "@home", "a@b", "x" * 80, "日本語テキスト"]


def test_all_that_is_planted_is_found_and_nothing_else():
    draw = random.Random(5)
    f = pii.Feistel(b"key")
    for _ in range(400):
        parts, kinds, values = [], [], []
        for _ in range(draw.randint(1, 8)):
            if draw.random() < 0.5:
                kind = draw.choice(sorted(PLANTED))
                value = PLANTED[kind](draw)
                parts.append(value)
                kinds.append(kind)
                values.append(re.search("[0-9a-f]{40}", value).group() if kind == "secret" else value)
            else:
                parts.append(draw.choice(NOISE))
        text = " ; ".join(parts)
        new, found = pii.replaced(text, lambda k, v: pii.pseudonym(k, v, f))
        assert found == kinds and ("ip" in kinds or len(new) == len(text)) and all(v not in new for v in values)
        assert [a for a, p in zip(new.split(" ; "), parts, strict=True) if p in NOISE] == [p for p in parts if p in NOISE]
        assert pii.replaced(new, lambda k, v: pii.pseudonym(k, v, f, -1))[0] == text


@pytest.mark.parametrize("text", ["1" + "a" * 1_000_000, "中1" * 500_000, "aB3+" * 250_000, "a@" * 500_000, "1" * 1_000_000, "x" * 1_000_000 + "@example.com", "0a" * 500_000])
def test_long_runs_take_linear_time(text):
    f = pii.Feistel(b"key")
    began = time.perf_counter()
    new, kinds = pii.replaced(text, lambda k, v: pii.pseudonym(k, v, f))
    assert time.perf_counter() - began < 15 and len(new) == len(text)
    assert (kinds == ["email"]) == text.endswith(".com")


def test_long_keys_with_a_common_start_differ():
    one, two = (pii.pseudonym("ssn", "123-45-6789", pii.Feistel(b"k" * 64 + end)) for end in (b"a", b"b"))
    assert one != two


def test_hosts_stay_linked():
    f = pii.Feistel(b"key")
    a, b, c = (pii.pseudonym("email", v, f).partition("@") for v in ("ann@mail.example.com", "bob@mail.example.com", "ann@mail.example.org"))
    assert a[2] == b[2] != "mail.example.com" and a[0] == c[0] != "ann" and a[2].endswith(".com") and c[2].endswith(".org")


def test_no_simple_find_is_left(spark, data, docs):
    date = re.compile(r"(?<![\d./-])\d{4}-\d\d-\d\d(?![\d/-]|\.\d)")
    email = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
    ip = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)")
    got = {r.doc_id: r for r in queries.op3_pii(spark, data).collect()}
    found = 0
    for i, row in docs.items():
        old = {m.group() for p in (email, ip, date) for m in p.finditer(row[1] or "") if p is not ip or max(map(int, m.group().split("."))) < 256}
        old = {v for v in old if not date.fullmatch(v) or pii._date(v)}
        found += len(old)
        assert not [v for v in old if v in got[i].text] and (got[i].n_found > 0 or got[i].text == row[1])
    assert found > 0


# 4 sharding


def test_shards_equal_a_plain_computation(spark, data, docs):
    rows, cells, top = list(docs.values()), 1 << hilbert.BITS, (1 << hilbert.BITS) - 1
    place = np.zeros((len(rows), 4), np.int64)
    for c, at in enumerate((3, 2, 4, 0)):
        values = [r[at] for r in rows]
        known = sorted(v for v in values if v is not None)
        if isinstance(known[0], str):
            distinct = sorted(set(known))
            bounds = distinct[:: max(1, -(-len(distinct) // (cells - 1)))]
        else:
            bounds = sorted({known[int(np.ceil(k / cells * len(known))) - 1] for k in range(1, cells)})
        place[:, c] = [0 if v is None else min(top, sum(b <= v for b in bounds)) for v in values]
    index = hilbert.curve_index(place)
    order = sorted(range(len(rows)), key=lambda i: (index[i], zlib.crc32(rows[i][1].encode()), rows[i][0]))
    want = {rows[i][0]: (n // 5, n % 5, int(index[i])) for n, i in enumerate(order)}  # 200 rows over 40 shards
    assert {r.doc_id: (r.shard, r.slot, r.hilbert) for r in queries.op4_hilbert_shards(spark, data).collect()} == want


# 5, 6, 8 classifiers


def plain_toxicity(docs, labels):
    learn = sorted((i, y) for i, _, y in labels if y in (0, 1) and crc(i) % 5 and i in docs)
    model = toxicity.train([docs[i][1].encode() for i, _ in learn], np.array([y for _, y in learn]))
    z = toxicity.logits([r[1].encode() for r in docs.values()], model, {})
    return dict(zip(docs, 1 / (1 + np.exp(-np.array(z))), strict=True))


def test_toxicity_equals_a_plain_fit(spark, data, docs, labels):
    want = plain_toxicity(docs, labels)
    for r in queries.op5_toxicity(spark, data).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-3) and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 5 == 0)


def test_quality_equals_a_plain_fit(spark, data, docs, labels):
    x = {i: np.array(quality.text_statistics(r[1].encode())) for i, r in docs.items()}
    own = [np.array([x[i] for i, y, _ in labels if y == c and crc(i) % 3 != 1 and i in x]) for c in (0, 1)]
    model = quality.from_sums(np.array([len(o) for o in own]), np.array([o.sum(axis=0) for o in own]), np.array([o.T @ o for o in own]))
    want = dict(zip(x, 1 / (1 + np.exp(-np.clip(model.log_ratio(np.stack(list(x.values()))) / quality.TEMPERATURE, -500, 500))), strict=True))
    for r in queries.op6_quality(spark, data).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 3 == 1)


def test_language_equals_a_plain_fit(spark, data, docs):
    signed = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w, 42)).astype(np.int64))
    x, langs = [], []
    for lang in sorted({r[2] for r in docs.values() if r[2]}):
        cut = {w.tobytes() for i, r in docs.items() if r[2] == lang and crc(i) % 5 for w in langid.windows(r[1].encode())}
        drawn = sorted(cut, key=lambda w: (signed(w), w))[: langid.WINDOWS_EACH]
        x += drawn
        langs += [lang] * len(drawn)
    model = langid.fitted(np.frombuffer(b"".join(x), np.uint8).reshape(-1, langid.WINDOW), langs)
    p = dict(zip(docs, langid.text_probabilities([r[1].encode() for r in docs.values()], model), strict=True))
    for r in queries.op8_language(spark, data).collect():
        assert r.held_out == (crc(r.doc_id) % 5 == 0)
        if re.search(r"[^\W\d_]", docs[r.doc_id][1]):
            assert r.lang_pred == model.languages[int(p[r.doc_id].argmax())] and r.score == pytest.approx(p[r.doc_id].max(), abs=1e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


# 7, 10 and the pipeline


def test_repeated_phrases_query_equals_brute_force(spark, data, docs):
    import hashlib

    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in shortened([(i, r[1]) for i, r in docs.items()])}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_repeated_phrases(spark, data).collect()} == want


def test_long_passages_are_cut_into_overlapping_patterns(spark, monkeypatch):
    from quarryline.llm import phrases

    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, "a " + " ".join(words) + " b"), (3, " ".join(words[::-1]))]
    monkeypatch.setattr(phrases, "PASSAGE", 100)
    monkeypatch.setattr(phrases, "VOCABULARY", 500)
    got = {r.doc_id: (r.n_removed, r.kept) for r in phrases.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == 0 and got[2] == (3000, "a b") and got[3][0] == 0


def test_pieces_query_equals_the_library(spark, data, docs):
    p = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r for r in queries.op10_pieces(spark, data).collect()}
    assert all(got[i].ids == p.encode(r[1]) and got[i].exact for i, r in docs.items())


def test_long_units_are_not_remembered():
    c = pieces.Codec(pieces.read_table(), True)
    p = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = "abcdefgh" * 50
    assert np.frombuffer(c.encode(text), np.int32).tolist() == p.encode(text) and not c.units


def test_pipeline_equals_plain_python(spark, data, docs, labels):
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for (t,) in duckdb.sql(f"SELECT text FROM '{data}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + min(13, len(w))]) for w in items for k in range(len(w) - min(13, len(w)) + 1) if w}
    lengths = {len(w) for w in windows}

    def contaminated(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        hit = np.zeros(len(w), bool)
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = True
        return hit.sum() > 0 and 20 * hit.sum() >= len(w)

    civil = [i for i, s in plain_toxicity(docs, labels).items() if s < 0.5]
    prints, parent = {i: print_of(docs[i][1]) for i in civil}, {i: i for i in civil}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(civil):
        for j in civil[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    f = pii.Feistel(pii.DEMO_KEY)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {}
    for i in civil:
        if root(i) == i and not contaminated(docs[i][1]):
            want[i] = library.encode(pii.replaced(docs[i][1], lambda k, v: pii.pseudonym(k, v, f))[0])
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, data).collect()} == want
