"""Language identification by a byte convolutional network, trained in numpy.

A text (ASCII case folded) is cut into windows of ``WINDOW`` bytes that overlap by the widest filter less one, so every byte
n-gram of the whole text is seen; the last window is padded with zero bytes. Filters of 2, 3 and 4 bytes run over one-hot
bytes, each filter's maximum over the window passes a ReLU, and a softmax over them gives the window's languages. A
text's probabilities are the mean of its windows', weighted by their bytes.

A filter over one-hot bytes is a table look-up per byte, and max pooling sends the gradient to one position per filter,
which makes training (Adam on cross entropy) cheap. For scoring the tables are joined into one by byte pair: each
position costs one row gather and a few additions, over batches of windows of fixed size.

Learning uses texts with a known language outside the held-out fold (crc32 of the id modulo 5 not 0): of each language at
most ``TEXTS_EACH`` rows, those of least id hash, and of all unlike windows of these at most ``WINDOWS_EACH``, drawn by hash, so
that rare languages and long texts have their share. Texts are cut on the executors; only the drawn windows reach the
driver. These are bounds on training only. Scoring covers every byte of every text. Only the text enters a prediction.

``und`` with score 0: a null text, a text without a letter, and every text if there was nothing to learn from. Rows
without id are predicted but not learned from; repeated rows repeat (an id is learned from once for each language); of equal probabilities the first language in
alphabetical order wins. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, sized, slices, utf8

FOLDS, HELD_OUT = 5, 0
TEXTS_EACH, WINDOWS_EACH = 600, 2500
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 8
#: Windows that are scored at once.
BLOCK = 256
STEP = WINDOW - max(WIDTHS) + 1


def windows(text: bytes) -> np.ndarray:
    """(k, WINDOW) bytes that cover the whole text."""
    text = text.lower()
    k = max(1, -(-(len(text) - (WINDOW - STEP)) // STEP))
    padded = np.zeros((k - 1) * STEP + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (k, WINDOW), (STEP, 1))


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    out: np.ndarray  # (widths * FILTERS, languages)
    out_bias: np.ndarray
    pairs: np.ndarray | None = field(default=None, repr=False)

    def compiled(self) -> np.ndarray:
        """By byte pair (65536 rows): what the pair adds to the filters of each width that start there."""
        if self.pairs is None:
            two, three, four = self.tables
            first, second = np.divmod(np.arange(65536), 256)
            self.pairs = np.concatenate([two[0][first] + two[1][second], three[0][first] + three[1][second], three[2][second], four[0][first] + four[1][second], four[2][first] + four[3][second]], axis=1)
        return self.pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the languages, for each window."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        rows, n = np.take(self.compiled(), pair, axis=0), FILTERS
        pooled = np.concatenate(
            [
                rows[:, :, :n].max(axis=1),
                (rows[:, :-1, n : 2 * n] + rows[:, 1:, 2 * n : 3 * n]).max(axis=1),
                (rows[:, :-2, 3 * n : 4 * n] + rows[:, 2:, 4 * n :]).max(axis=1),
            ],
            axis=1,
        )
        return _softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str]) -> Model:
    """Fit on all windows of texts that sit in the driver's memory."""
    each = [windows(t) for t in texts]
    return fitted(np.concatenate(each), np.repeat(langs, [len(w) for w in each]).tolist())


def fitted(x: np.ndarray, langs: list[str]) -> Model:
    """Fit on windows and their languages."""
    names = sorted(set(langs))
    y = np.array([names.index(lang) for lang in langs])
    rng = np.random.default_rng(SEED)
    p = [*(rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS), np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            bx, best, pooled = x[rows], [], []
            for t, w in zip(p, WIDTHS, strict=False):
                conv = sum(t[j][bx[:, j : WINDOW - w + 1 + j]] for j in range(w))
                where = conv.argmax(axis=1)  # (batch, filters)
                best.append(where)
                pooled.append(np.take_along_axis(conv, where[:, None], axis=1)[:, 0])
            h = np.concatenate(pooled, axis=1) + p[3]
            on = np.maximum(h, 0)
            d = _softmax(on @ p[4] + p[5])
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            dh = (d @ p[4].T) * (h > 0)
            grad = [np.zeros_like(a) for a in p[:3]] + [dh.sum(axis=0), on.T @ d, d.sum(axis=0)]
            f = np.arange(FILTERS)[None]
            for i, w in enumerate(WIDTHS):
                part = dh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(grad[i][j], (np.take_along_axis(bx, best[i] + j, axis=1), np.broadcast_to(f, part.shape)), part)
            step += 1
            for a, g, am, av in zip(p, grad, m, v, strict=True):
                am *= 0.9
                am += 0.1 * g
                av *= 0.999
                av += 0.001 * g * g
                a -= RATE * (am / (1 - 0.9**step)) / (np.sqrt(av / (1 - 0.999**step)) + 1e-8)
    return Model(names, p[:3], p[3], p[4], p[5])


def fit(docs: DataFrame, texts_each: int = TEXTS_EACH, windows_each: int = WINDOWS_EACH) -> Model | None:
    """A model from docs' own languages; None without any."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("_lang"), "text")
    of_lang = Window.partitionBy("_lang")
    first = known.select("_id", "_lang").distinct().withColumn("_n", F.row_number().over(of_lang.orderBy(F.xxhash64("_id"), "_id"))).filter(F.col("_n") <= texts_each)
    chosen = sized(checkpointed(first.drop("_n")))
    rows = known.join(chosen, ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for lang, text in zip(batch.column("_lang").to_pylist(), utf8(batch.column("text")), strict=True):
                w = windows(text)
                for at in range(0, len(w), BLOCK):
                    part = [x.tobytes() for x in w[at : at + BLOCK]]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary())], ["_lang", "w"])

    cut = rows.select("_lang", "text").mapInArrow(work, "_lang string, w binary")
    drawn = cut.distinct().withColumn("_n", F.row_number().over(of_lang.orderBy(F.xxhash64("w"), "w"))).filter(F.col("_n") <= windows_each).orderBy("_lang", "_n").toArrow()
    if not drawn.num_rows:
        return None
    x = np.frombuffer(b"".join(drawn.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return fitted(x, drawn.column("_lang").to_pylist())


def text_probabilities(texts: list[bytes], model: Model) -> np.ndarray:
    """The mean of each text's windows, weighted by their bytes, a bounded block of windows at a time."""
    out = np.zeros((len(texts), len(model.languages)))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if held:
            p = model.probabilities(np.concatenate([x for _, x, _ in held])) * np.concatenate([n for _, _, n in held])[:, None]
            np.add.at(out, np.repeat([i for i, _, _ in held], [len(x) for _, x, _ in held]), p)
            held.clear()

    for i, t in enumerate(texts):
        x = windows(t)
        n = np.minimum(WINDOW, np.maximum(1, len(t) - STEP * np.arange(len(x))))
        for at in range(0, len(x), BLOCK):
            held.append((i, x[at : at + BLOCK], n[at : at + BLOCK]))
            if sum(len(h[1]) for h in held) >= BLOCK:
                flush()
    flush()
    return out / out.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' columns with lang_pred and lang_score of every whole text."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "_lettered")]
    und = docs.select([f"`{c}`" for c in kept])
    if model is None:
        return und.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts, lettered = utf8(batch.column("text")), batch.column("_lettered").to_pylist()
            at = [i for i, yes in enumerate(lettered) if yes]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if at:
                p = text_probabilities([texts[i] for i in at], model)
                score[at] = p.max(axis=1)
                for i, k in zip(at, p.argmax(axis=1), strict=True):
                    pred[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred), pa.array(score)], [*kept, "lang_pred", "lang_score"])

    kinds = dict(docs.dtypes)
    marked = und.withColumn("_lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "lang_pred string, lang_score double"]))
