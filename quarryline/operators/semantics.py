"""Meaning of texts for terms: cosines of weighted character n-grams, blended with those of a latent space of words.

Character n-grams of 2 to 5 lie within a word with a blank on either side; words are of two letters or more, singly and in
pairs. A weight is the count times ln((1 + N) / (1 + n)) + 1, rows have unit length, and of each kind the most frequent
``FEATURES`` are kept. The latent space is that of the largest singular values of the word matrix.

A ``Space`` holds what is fitted: the features of both kinds with their weights and the right singular vectors, features by
components, a size that is fixed by the feature and not by the corpus. ``fit`` finds it, ``Space.save`` and ``load`` keep it, and
``scores`` is one pass over the texts that shuffles nothing. A space may be fitted on a corpus once and used for many
searches, or, as ``semantic_scores`` does, on the texts and the terms of one search together.

Singular vectors come from subspace iteration: a pass multiplies the sparse rows of its task with a block of
``components + EXTRA`` vectors and back, tasks' products are added in two steps by blocks of features, and the driver
orthogonalises the sum, until the leading components stand still. Where the block is as wide as the rows or the features are
many, that is after the first pass.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import checkpointed, spread

#: Sizes of n-grams, features, components, shares of the two cosines.
SIZES, FEATURES, COMPONENTS, BY_CHARS, BY_WORDS = (2, 5), 30_000, 128, 0.45, 0.55
#: Vectors beyond the components, passes at most, and how little the components' energy may still grow.
EXTRA, PASSES, STILL = 16, 6, 1e-9
#: Features of a product that is added at once; grams that a task counts, or words it remembers, before it lets them go.
BLOCK, HELD = 1024, 300_000
#: Letters of texts that are looked at together, and different letters of which five fit a number.
TOGETHER, LETTERS = 1 << 19, 1 << 12
#: Grams that are handed on at once.
SENT = 50_000
#: Bytes of features that a task of a product has at least.
TASK = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = re.compile(r"\b\w\w+\b")


def pieces(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, some of them at a time; a null text counts as an empty one."""
    out, size = [], 0
    for text in texts:
        out.append(text or "")
        size += len(out[-1])
        if size > TOGETHER:
            yield out
            out, size = [], 0
    if out:
        yield out


class Words(dict):
    """The numbers of words, in the order in which they are met; for characters also each word's grams, one word after the other.

    Grams are numbered as they are met, or by known, which leaves the others out.
    """

    def __init__(self, kind: str, known: dict[str, int] | None = None):
        super().__init__()
        self.kind, self.known, self.grams = kind, known, {}
        self.begin, self.size, self.flat, self.filled = [], [], np.zeros(1024, np.int32), 0
        self.told = None  # what a side knows of the words so far

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        return k

    def forget(self) -> None:
        """Lets the words go if they are many; of characters, grams keep their numbers."""
        if len(self) > HELD or self.filled > 8 * HELD:
            self.clear()
            self.begin, self.size, self.filled, self.told = [], [], 0, None

    def _number(self, gram: str) -> int:
        return self.grams.setdefault(gram, len(self.grams)) if self.known is None else self.known.get(gram, -1)

    def learn(self, words: list[str]) -> None:
        """The grams of words that are new, all at once: up to five letters fit a number where there are few different ones."""
        text = "".join(f" {w} " for w in words)
        letters, at = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        if len(letters) > LETTERS and len(words) > 1:
            self.learn(words[: len(words) // 2])
            self.learn(words[len(words) // 2 :])
            return
        size = np.array([len(w) + 2 for w in words], np.int64)
        start = np.cumsum(size) - size
        every = [np.maximum(size - n + 1, 0) for n in range(SIZES[0], SIZES[1] + 1)]
        count = sum(every)
        to = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for n, mine in zip(range(SIZES[0], SIZES[1] + 1), every, strict=True):
            of = np.repeat(np.arange(len(words)), mine)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(mine) - mine, mine)
            begin = start[of] + inner
            if len(letters) > LETTERS:
                found = np.array([self._number(text[i : i + n]) for i in begin.tolist()], np.int64)
            else:
                code = np.zeros(len(begin), np.int64)
                for i in range(n):
                    code = code * LETTERS + at[begin + i]
                _, first, which = np.unique(code, return_index=True, return_inverse=True)
                found = np.array([self._number(text[i : i + n]) for i in begin[first].tolist()], np.int64)[which]
            out[to[of] + inner] = found
            to = to + mine
        kept = out >= 0
        ends = np.r_[0, np.cumsum(kept)][np.cumsum(count)]
        self.begin += (self.filled + np.r_[0, ends[:-1]]).tolist()
        self.size += np.diff(ends, prepend=0).tolist()
        out = out[kept]
        if self.filled + len(out) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(self.filled + len(out), np.int32)]
        self.flat[self.filled : self.filled + len(out)] = out
        self.filled += len(out)
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words of the texts by number, and where each text's end."""
        split = [t.lower().split() if self.kind == "char" else WORD.findall(t.lower()) for t in texts]
        ends = np.cumsum([len(x) for x in split])
        every = list(chain.from_iterable(split))
        if self.kind == "char" and (new := [w for w in dict.fromkeys(every) if w not in self]):
            self.learn(new)
        return np.fromiter(map(self.__getitem__, every), np.int64, len(every)), ends

    def char_grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All grams of the texts' words by number, and where each text's end."""
        at, ends = self.numbers(texts)
        size = np.array(self.size, np.int64)[at]
        last = np.cumsum(size)
        out = self.flat[np.repeat(np.array(self.begin, np.int64)[at] - last + size, size) + np.arange(int(last[-1]) if len(last) else 0)]
        return out, np.r_[0, last][ends]

    def word_grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words of the texts as -1 - number and all pairs of neighbours as a number of both, and where each text's end."""
        at, ends = self.numbers(texts)
        begin = np.r_[0, ends[:-1]]
        inner = np.ones(len(at), bool)
        inner[begin[begin < ends]] = False  # a text's first word has none before it
        second = np.nonzero(inner)[0]
        # Pairs stand behind the words of their text.
        pairs = np.maximum(ends - begin - 1, 0)
        both = ends + np.cumsum(pairs)
        of = np.repeat(np.arange(len(texts)), ends - begin)
        out = np.empty(len(at) + len(second), np.int64)
        shift = np.r_[0, np.cumsum(pairs)[:-1]]
        out[np.arange(len(at)) + shift[of]] = -1 - at
        out[ends[of[second]] + shift[of[second]] + second - begin[of[second]] - 1] = at[second - 1] << 32 | at[second]
        return out, both


def tallied(grams: np.ndarray, ends: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text that has grams its number, its different grams and how often it has each; place has room for every gram."""
    count = np.arange(int(np.diff(ends, prepend=0).max(initial=0)))
    begin = 0
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            mine = grams[begin:end]
            place[mine] = count[: end - begin]  # one of equal grams is the last to write its place
            which = place[mine]
            first = which == count[: end - begin]
            yield k, mine[first], np.bincount(which, minlength=end - begin)[first]
        begin = end


class Tally:
    """How often grams occur and how many texts have them, until they are handed on."""

    def __init__(self, kind: str):
        self.kind, self.words = kind, Words(kind)
        self.every, self.having = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by number of the character gram or the word
        self.pairs = [np.zeros((3, 0), np.int64)]  # pairs of words: both, how often, in how many texts

    def __len__(self) -> int:
        return len(self.words.grams if self.kind == "char" else self.words) + sum(p.shape[1] for p in self.pairs)

    def add(self, texts: list[str]) -> None:
        if self.kind == "char":
            self.words.forget()
        grams, ends = self.words.char_grams(texts) if self.kind == "char" else self.words.word_grams(texts)
        known = len(self.words.grams if self.kind == "char" else self.words)
        more = np.zeros(max(0, known - len(self.every)), np.int64)
        self.every, self.having = np.r_[self.every, more], np.r_[self.having, more]
        if self.kind == "word":
            pairs, at = np.unique(grams[grams >= 0], return_inverse=True)
            grams[grams >= 0] = known + at
            grams[grams < 0] = -1 - grams[grams < 0]
        else:
            pairs = np.zeros(0, np.int64)
        every, having = np.bincount(grams, minlength=known + len(pairs)), np.zeros(known + len(pairs), np.int64)
        for _, found, _ in tallied(grams, ends, np.zeros(len(every), np.int64)):
            having[found] += 1
        self.every += every[:known]
        self.having += having[:known]
        if len(pairs):
            self.pairs.append(np.stack([pairs, every[known:], having[known:]]))
        if len(self) > HELD and len(self.pairs) > 1:
            rows = np.concatenate(self.pairs, axis=1)
            keys, at = np.unique(rows[0], return_inverse=True)
            self.pairs = [np.stack([keys, *(np.bincount(at, x, len(keys)).astype(np.int64) for x in rows[1:])])]

    def emitted(self) -> Iterator[pa.RecordBatch]:
        names = list(self.words.grams if self.kind == "char" else self.words)
        pairs = np.concatenate(self.pairs, axis=1)
        for k in range(0, len(names) + pairs.shape[1], SENT):
            one, two = slice(k, k + SENT), slice(max(0, k - len(names)), max(0, k + SENT - len(names)))
            grams = names[one] + [f"{names[a]} {names[b]}" for a, b in zip((pairs[0, two] >> 32).tolist(), (pairs[0, two] & (1 << 32) - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.r_[self.every[one], pairs[1, two]]), pa.array(np.r_[self.having[one], pairs[2, two]])], ["gram", "n", "df"])


def features(texts: DataFrame, kind: str, most: int = FEATURES) -> dict[str, int]:
    """The most frequent grams of texts(text), of equally frequent ones the first, with the number of texts that have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(kind)
        for batch in batches:
            for part in pieces(batch.column(0).to_pylist()):
                tally.add(part)
                if len(tally) > HELD:
                    yield from tally.emitted()
                    tally = Tally(kind)
        yield from tally.emitted()

    counted = texts.select("text").mapInArrow(work, "gram string, n long, df long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    with cleaned(texts.sparkSession):
        rows = counted.orderBy(F.desc("n"), "gram").limit(most).collect()  # a bounded number of features
    return {r["gram"]: r["df"] for r in sorted(rows, key=lambda r: r["gram"])}


def _weights(at: np.ndarray, n: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts times idf, in rows of unit length."""
    w, sizes = n * idf[at], np.diff(ends, prepend=0)
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(ends)), sizes), w * w, len(ends)))
    return w / np.repeat(np.maximum(length, 1e-300), sizes)


@dataclass
class Side:
    """The features of one kind: their numbers and inverse document frequencies."""

    kind: str
    number: dict[str, int]
    idf: np.ndarray

    def counts(self, texts: list[str], words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' different features and how often each occurs, text after text, and where each ends; words are kept between calls."""
        words = self.words() if words is None else words
        if self.kind == "char":
            grams, ends = words.char_grams(texts)
        else:
            grams, ends = words.word_grams(texts)
            grams = self._known(grams, words)
            kept = grams >= 0
            grams, ends = grams[kept], np.r_[0, np.cumsum(kept)][ends]
        at, n, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for k, found, times in tallied(grams, ends, np.zeros(len(self.number), np.int64)):
            at.append(found)
            n.append(times)
            sizes[k] = len(found)
        return np.concatenate(at), np.concatenate(n), np.cumsum(sizes)

    def matrix(self, texts: list[str], words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with the weights of unit rows."""
        at, n, ends = self.counts(texts, words)
        return at, _weights(at, n, ends, self.idf), ends

    def words(self) -> Words:
        """To be kept by a task."""
        return Words(self.kind, self.number)

    def _known(self, grams: np.ndarray, words: Words) -> np.ndarray:
        """Feature numbers of word_grams, -1 for others."""
        single, keys, to = words.told or (np.zeros(0, np.int64), None, None)
        new = list(islice(words, len(single), None))
        if new or keys is None:
            single = np.r_[single, np.array([self.number.get(w, -1) for w in new], np.int64)]
            if keys is None or not self.paired.isdisjoint(new):
                pairs = sorted((words[a] << 32 | words[b], k) for (a, b), k in self.pairs.items() if a in words and b in words)
                keys, to = np.array([-1, *(p for p, _ in pairs)], np.int64), np.array([-1, *(k for _, k in pairs)], np.int64)
            words.told = single, keys, to
        found = np.searchsorted(keys, grams, side="right") - 1
        out = np.where(keys[found] == grams, to[found], -1)
        return np.where(grams < 0, single[np.maximum(-1 - grams, 0)] if len(single) else -1, out)

    @functools.cached_property
    def pairs(self) -> dict[tuple[str, str], int]:
        return {tuple(g.split(" ")): k for g, k in self.number.items() if " " in g}

    @functools.cached_property
    def paired(self) -> set[str]:
        return set(chain.from_iterable(self.pairs))

    def rows(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Feature numbers and weights of each text's unit row."""
        at, w, ends = self.matrix(texts)
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            yield at[a:b], w[a:b]

    def products(self, texts: list[str], right: np.ndarray, words: Words | None = None) -> np.ndarray:
        """Each text's row times right (features by columns)."""
        return multiplied(*self.matrix(texts, words), right)


def multiplied(at: np.ndarray, w: np.ndarray, ends: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sparse rows times right."""
    out, begin = np.zeros((len(ends), right.shape[1])), 0
    held = np.empty((int(np.diff(ends, prepend=0).max(initial=0)), right.shape[1]))
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            mine = np.take(right, at[begin:end], axis=0, out=held[: end - begin], mode="clip")
            np.dot(w[begin:end], mine, out=out[k])
        begin = end
    return out


def side(texts: DataFrame, kind: str, total: int, most: int = FEATURES) -> Side:
    found = features(texts, kind, most)
    idf = np.log((1.0 + total) / (1.0 + np.array(list(found.values()), float))) + 1
    return Side(kind, {g: k for k, g in enumerate(found)}, idf)


def _multiplied(rows: DataFrame, idf: np.ndarray, vectors: np.ndarray, tasks: int) -> np.ndarray:
    """A' A V over rows(at, n, ends) of many texts each, the counts of A: tasks' products, added by blocks of features.

    A task's product is as large as V, so there are no more tasks than are asked for; many are added in two steps. What they shuffle
    goes when it is added, not when the driver happens to collect its garbage.
    """
    spark, width = rows.sparkSession, vectors.shape[1]
    shared = spark.sparkContext.broadcast((idf, vectors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, v = shared.value
        out, held = np.zeros_like(v), np.empty((64, v.shape[1]))
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                at, n, ends = (np.frombuffer(x.as_buffer(), np.int32) for x in row)
                at, w, begin = at.astype(np.int64), _weights(at, n, ends, idf), 0
                for end in ends.tolist():
                    a, b, begin = begin, end, end
                    if b - a > len(held):
                        held = np.empty((2 * (b - a), v.shape[1]))
                    if b > a:
                        mine = np.take(v, at[a:b], axis=0, out=held[: b - a], mode="clip")
                        out[at[a:b]] += np.multiply(w[a:b, None], w[a:b] @ mine, out=mine)  # a row's features differ, so they are added to at once
        task = TaskContext.get().partitionId() % 64
        for k in range(0, len(out), BLOCK):
            if out[k : k + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([out[k : k + BLOCK].tobytes()], pa.binary())], ["block", "task", "sum"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in batches:
            key = (batch.column("block")[0], batch.column("task")[0]) if key is None else key
            for cell in batch.column("sum"):
                part = np.frombuffer(cell.as_py())
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "task", "sum"])

    schema = "block int, task int, sum binary"
    sums = rows.coalesce(tasks).mapInArrow(work, schema)
    if tasks > 64:
        sums = sums.groupBy("block", "task").applyInArrow(added, schema)
    sums = sums.groupBy("block").applyInArrow(added, schema)
    out = np.zeros_like(vectors)
    with cleaned(spark):
        found = sums.select("block", "sum").toArrow()  # features by vectors, whatever the number of texts
    for block, cell in zip(found.column("block").to_pylist(), found.column("sum"), strict=True):
        part = np.frombuffer(cell.as_buffer()).reshape(-1, width)
        out[block : block + len(part)] = part
    shared.destroy()
    return out


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled by actions inside is deleted when they end; no frame of theirs is used again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def right_vectors(rows: DataFrame, idf: np.ndarray, components: int, seed: int = 42) -> np.ndarray:
    """The right singular vectors (features by components) of the largest singular values of the sparse rows(at, n, ends)."""
    n = len(idf)
    width = min(n, components + EXTRA)
    size = rows.agg(F.sum(F.length("at"))).first()[0] or 0
    tasks = max(1, min(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism, size // TASK))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    energy = 0.0
    for _ in range(PASSES):
        product = _multiplied(rows, idf, basis, tasks)
        values, turn = np.linalg.eigh(basis.T @ product)
        now = float(values[::-1][:components].sum())
        vectors = (basis @ turn)[:, ::-1][:, :components]
        basis = np.linalg.qr(product @ turn[:, ::-1])[0]
        if now - energy <= STILL * now:
            break
        energy = now
    return vectors


@dataclass
class Space:
    """Fitted features and the latent space; vectors is None where the words span fewer than two components."""

    char: Side
    word: Side
    vectors: np.ndarray | None

    def placed(self, texts: list[str], words: Words | None = None) -> np.ndarray | None:
        return None if self.vectors is None else self.word.products(texts, self.vectors, words)

    def save(self, spark: SparkSession, folder: str) -> None:
        """As Parquet: a row for each feature."""
        rows = [(s.kind, g, k, float(s.idf[k]), None if s.kind == "char" or self.vectors is None else self.vectors[k].tolist()) for s in (self.char, self.word) for g, k in s.number.items()]
        spark.createDataFrame(rows, "kind string, gram string, number int, idf double, vector array<double>").repartition(8, "kind", "number").write.mode("overwrite").parquet(os.path.join(folder, "features"))

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Space:
        rows = spark.read.parquet(os.path.join(folder, "features")).orderBy("kind", "number").toArrow().to_pylist()
        sides = [Side(k, {r["gram"]: r["number"] for r in rows if r["kind"] == k}, np.array([r["idf"] for r in rows if r["kind"] == k])) for k in ("char", "word")]
        vectors = [r["vector"] for r in rows if r["kind"] == "word"]
        return Space(*sides, np.array(vectors) if vectors and vectors[0] is not None else None)


def fit(texts: DataFrame, components: int = COMPONENTS, most: int = FEATURES) -> Space:
    """The space of texts(text); a null text counts as an empty one."""
    spark, texts = texts.sparkSession, spread(texts.select("text"))
    total = texts.count()
    char, word = side(texts, "char", total, most), side(texts, "word", total, most)
    n = len(word.number)
    k = min(components, total - 1, n - 1)
    if k < 2:
        return Space(char, word, None)
    shared = spark.sparkContext.broadcast(word)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        words = side.words()
        for batch in batches:
            for part in pieces(batch.column(0).to_pylist()):
                words.forget()
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in side.counts(part, words)], ["at", "n", "ends"])

    rows = checkpointed(texts.select("text").mapInArrow(work, "at binary, n binary, ends binary"))
    return Space(char, word, right_vectors(rows, word.idf, k))


def meant(units: DataFrame, text: str, terms: list[str], space: Space, out: str = "scores") -> DataFrame:
    """units with a score for each term by the meaning of a text column: one pass, nothing is shuffled or joined."""
    char = np.zeros((len(space.char.number), len(terms)))
    for j, (at, w) in enumerate(space.char.rows(terms)):
        char[at, j] = w
    asked = space.placed(terms)
    shared = units.sparkSession.sparkContext.broadcast((space, char, asked))

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-12)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, char, asked = shared.value
        by_char, by_word = space.char.words(), space.word.words()
        for batch in batches:
            begin = 0
            for part in pieces(batch.column(text).to_pylist()):
                by_char.forget()
                by_word.forget()
                at, w, ends = space.char.matrix(part, by_char)
                of = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
                found = np.stack([np.bincount(of, w * char[at, j], len(part)) for j in range(len(terms))], axis=1)
                if asked is not None:
                    found = BY_CHARS * found + BY_WORDS * np.maximum(0.0, unit(space.placed(part, by_word)) @ unit(asked).T)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(terms)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(part)).columns, column], [*batch.schema.names, out])
                begin += len(part)

    return spread(units).mapInArrow(work, StructType([*units.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def scores(units: DataFrame, terms: list[str], space: Space) -> DataFrame:
    """id and scores, one for each term, of every unit(id, text)."""
    return meant(units.select("id", "text"), "text", terms, space).drop("text")


def fit_with(units: DataFrame, text: str, terms: list[str], components: int = COMPONENTS, most: int = FEATURES) -> Space:
    """The space of the units' texts and the terms together."""
    asked = units.sparkSession.createDataFrame([(t,) for t in terms], "text string").coalesce(1)
    return fit(spread(units.select(F.col(text).alias("text"))).unionByName(asked), components, most)  # else the terms' partitions pass for the units'


def semantic_scores(units: DataFrame, terms: list[str], components: int = COMPONENTS, most: int = FEATURES) -> DataFrame:
    """The same by the space of the units and the terms together."""
    return scores(units, terms, fit_with(units, "text", terms, components, most))
