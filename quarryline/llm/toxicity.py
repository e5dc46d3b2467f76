"""Toxicity from subword bags: averaged n-gram embeddings and a linear softmax, trained jointly in numpy.

A word (ASCII case folded, outer punctuation cut) is its bag of hashed character n-grams of 3 to 5 bytes, word marks
included, so a misspelling unseen in training still shares most of its vectors with the word it hides. A word's vector is
the mean of its n-grams', a text's vector the mean of its words' (a word counts once more for each doubling of its
occurrences) shrunk towards zero as if ``PRIOR_WORDS`` words without a leaning were there too, and softmax of a linear layer
over it gives the classes. Embeddings and layer are fitted together by Adam on the cross entropy, classes weighted equally.

Learning uses, of each class, at most ``TRAIN_EACH`` labelled texts of the training folds (crc32 of the id modulo 5 not 0),
those of least hash of the id. Their words are counted on the executors; the driver gets the words that ``LEAST_TEXTS`` of
them share, the ``VOCABULARY`` most spread ones at most, and each text's counts of these: documented bounds on what it holds.
Scoring covers every text, all its words: as the layer is linear, a word's vector reduces to one number, its logit,
remembered by each worker in a bounded memo, and the text's score is the logistic of the mean logit plus the bias. Only
the text enters a score.

Null and empty texts have no words and score the bias alone. Null ids are not learned from and are not held out. With no
labelled row of both classes that share words with others every text scores 0.5 less a hair (predicted 0). Repeated rows repeat; an id
counts once for each label it has, with its least text. Other columns are ignored by ``score`` and kept by ``keep_civil``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, free_name, slices, utf8

TRAIN_EACH, VOCABULARY = 2000, 100_000
FOLDS, HELD_OUT = 5, 0
BUCKETS = 1 << 15
#: Words of fewer training texts are left out of training: they cannot tell a class from a text.
LEAST_TEXTS = 3
#: A mean is taken as if so many words without a leaning were there too, so that a few words decide nothing.
PRIOR_WORDS = 100
DIMS = 4
SIZES = (3, 4, 5)
STEPS = 150
RATE = 1.0
#: Added to the root of Adam's second moment: n-grams of few texts, whose gradients are smaller, hardly move.
EPS = 1e-4
#: Share by which every step shrinks the embeddings: what a few texts taught fades unless others repeat it.
SHRINK = 0.03
SEED = 5
PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
#: Words, none longer than so many bytes, that a worker remembers.
WORD_MEMO, MEMO_BYTES = 200_000, 64


def words(text: bytes | None) -> dict[bytes, int]:
    """The words of a text and how much each counts: once, and once more for each doubling."""
    out: dict[bytes, int] = {}
    for x, n in Counter((text or b"").lower().split()).items():
        if w := x.strip(PUNCTUATION):
            out[w] = out.get(w, 0) + n
    return {w: n.bit_length() for w, n in out.items()}


def gram_bags(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of many words and the index of the word each belongs to, all by array operations."""
    marked = [(b"<" + w + b">").ljust(min(SIZES), b">") for w in distinct]
    whole = np.frombuffer(b"".join(marked), np.uint8)
    word_of = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    buckets, owners = [], []
    for n in SIZES:
        if len(whole) < n:
            continue
        ends = len(whole) - n + 1
        h = np.full(ends, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ whole[k : ends + k]) * np.uint32(0x01000193)  # FNV-1a, many at once
        inside = word_of[:ends] == word_of[n - 1 :]
        h = h[inside]
        buckets.append((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))
        owners.append(word_of[:ends][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    gram_logit: np.ndarray  # of each bucket: its vector times the difference of the layer's columns
    bias: float

    def words(self, distinct: list[bytes]) -> list[float]:
        """The logit of each word, the mean of its n-grams'."""
        g, of = gram_bags(distinct)
        return (np.bincount(of, self.gram_logit[g], len(distinct)) / np.bincount(of, minlength=len(distinct))).tolist()


def _sum_runs(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums, dimension by dimension, of the (non-empty) runs of x's columns that begin at starts."""
    return np.stack([np.add.reduceat(row, starts) for row in x])


def train(texts: list[bytes | None], labels: np.ndarray) -> Model:
    """Fit on texts that sit in the driver's memory."""
    each = [words(t) for t in texts]
    spread = Counter(w for c in each for w in c)
    index = sorted(w for w, n in spread.items() if n >= LEAST_TEXTS)
    at = {w: i for i, w in enumerate(index)}
    bags = [np.array([(at[w], n) for w, n in c.items() if w in at], dtype=np.int64).reshape(-1, 2) for c in each]
    return fitted(index, bags, np.array([sum(c.values()) for c in each]), labels)


def fitted(index: list[bytes], bags: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> Model:
    """Fit on each text's words, as rows of their place in the index and how much they count, and what all its words count."""
    used = [i for i, bag in enumerate(bags) if len(bag)]
    if len(set(labels[used].tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -1e-6)
    bags, sizes, y = [bags[i] for i in used], sizes[used], labels[used].astype(int)
    g, word_of = gram_bags(index)
    order = np.argsort(word_of, kind="stable")
    g, word_of = g[order], word_of[order]
    n_grams = np.bincount(word_of)
    g_start, g_share = np.cumsum([0, *n_grams])[:-1], (1 / n_grams)[word_of].astype(np.float32)
    (w, counts), w_start = np.concatenate(bags).T, np.cumsum([0, *map(len, bags)])[:-1]
    doc_of = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    w_share = (counts / (sizes + PRIOR_WORDS)[doc_of]).astype(np.float32)
    weight = (len(y) / (2 * np.bincount(y, minlength=2)))[y].astype(np.float32)
    weight /= weight.sum()

    rng = np.random.default_rng(SEED)  # a dimension to a row
    p = [rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32).T.copy(), rng.normal(0, 0.1, (DIMS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def transposed(to: np.ndarray, of: np.ndarray, share: np.ndarray, n: int):
        """The function from columns x to the sums of x[of] * share by to."""
        order = np.argsort(to, kind="stable")
        keys, starts = np.unique(to[order], return_index=True)
        of, share = of[order], share[order]

        def apply(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), n), np.float32)
            out[:, keys] = _sum_runs(x[:, of] * share, starts)
            return out

        return apply

    to_words, to_grams = transposed(w, doc_of, w_share, len(index)), transposed(g, word_of, g_share, BUCKETS)
    for step in range(1, STEPS + 1):
        vectors = _sum_runs(p[0][:, g] * g_share, g_start)
        docs = _sum_runs(vectors[:, w] * w_share, w_start)
        logits = docs.T @ p[1] + p[2]
        soft = np.exp(logits - logits.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        d = soft.copy()
        d[np.arange(len(y)), y] -= 1
        d *= weight[:, None]
        grad = [to_grams(to_words(p[1] @ d.T)), docs @ d, d.sum(axis=0)]
        for i in range(3):
            m[i] = 0.9 * m[i] + 0.1 * grad[i]
            v[i] = 0.999 * v[i] + 0.001 * grad[i] ** 2
            if i == 0:
                p[0] *= 1 - SHRINK
            p[i] -= RATE * (1 - step / (STEPS + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + EPS)
    return Model((p[0].T @ (p[1][:, 1] - p[1][:, 0])).astype(np.float32), float(p[2][1] - p[2][0]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, each: int, folds: int, held_out: int) -> DataFrame:
    """_id, _label and text of at most so many labelled rows of each class outside the held-out fold, those of least id hash."""
    known = labels.filter(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != held_out)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
    chosen = known.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).drop("_n")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # twice so many rows of two numbers
    return found.groupBy("_id", "_label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> Model:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [words(t) for t in utf8(batch.column("text"))]
            sizes = [len(c) for c in found]
            rows = pa.array(np.repeat(np.arange(len(found)), sizes))
            columns = {"_id": batch.column("_id").take(rows), "_label": batch.column("_label").take(rows), "word": pa.array([w for c in found for w in c], pa.binary()), "n": pa.array([n for c in found for n in c.values()], pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = training_rows(docs, labels, "toxic", each, FOLDS, HELD_OUT)
    counted = checkpointed(rows.mapInArrow(work, f"_id {dict(docs.dtypes)['doc_id']}, _label int, word binary, n int"))
    spread = counted.groupBy("word").agg(F.count("*").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS).orderBy(F.desc("texts"), "word").limit(VOCABULARY)
    index = sorted(spread.select("word").toArrow().column("word").to_pylist())
    known = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(index, pa.binary()), "at": pa.array(range(len(index)), pa.int64())}))
    bag = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.col("n").cast("long").alias("n")))))
    texts = counted.join(known, "word", "left").groupBy("_id", "_label").agg(bag.alias("bag"), F.sum("n").alias("size")).orderBy("_id", "_label").select("_label", "bag", "size").toArrow()
    bag, ends = texts.column("bag").combine_chunks(), [0]
    if len(bag):
        ends = bag.offsets.to_numpy().tolist()
    pairs = np.stack([bag.values.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1).astype(np.int64)
    bags = [pairs[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fitted(index, bags, texts.column("size").to_numpy(), texts.column("_label").to_numpy())


def logits(texts: list[bytes | None], model: Model, known: dict[bytes, float]) -> list[float]:
    """The logit of each text; known remembers words from one call to the next and is emptied when large."""
    each = [words(t) for t in texts]
    if len(known) > WORD_MEMO:
        known.clear()
    new = list({w for c in each for w in c if w not in known})
    rare = dict(zip(new, model.words(new), strict=True)) if new else {}
    known.update((w, x) for w, x in rare.items() if len(w) <= MEMO_BYTES)
    return [model.bias + sum([(known[w] if w in known else rare[w]) * n for w, n in c.items()]) / (sum(c.values()) + PRIOR_WORDS) for c in each]


def score(docs: DataFrame, model: Model, out: str = "toxic_score") -> DataFrame:
    """docs' columns and a score (0 to 1) of every whole text, in place of a column of that name."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[bytes, float] = {}
        for batch in slices(batches):
            x = [1 / (1 + exp(-max(-700.0, min(700.0, z)))) for z in logits(utf8(batch.column("text")), model, known)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(x, pa.float64())], [*kept, out])

    kinds = dict(docs.dtypes)
    return docs.select([f"`{c}`" for c in dict.fromkeys([*kept, "text"])]).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{out}` double"]))


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below 0.5, with their columns."""
    name = free_name(docs, "toxic_score")
    return score(docs, model, name).filter(F.col(name) < 0.5).select([f"`{c}`" for c in docs.columns])
