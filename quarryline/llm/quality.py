"""Quality by a regularised quadratic discriminant over transformed document statistics.

``statistics`` turns every whole text into a few numbers (lengths, shares of kinds of characters, repetition, line
shape), each put on a scale on which it is roughly normal (logs of counts, logs of shares plus a small floor). For each
class Spark sums the numbers and their products over all labelled rows of the training folds (crc32 of the id modulo 3 not
1); no text and no row reaches the driver, only these sums, whose number is fixed. Class covariances are shrunk towards
the pooled covariance and its diagonal, and the score is the logistic of the difference of the two log densities,
Mahalanobis distances taken with Cholesky factors computed once. Equal priors: the label's frequency does not enter.

Null and empty texts are texts without words. Null labels, labels other than 0 and 1 and rows without id are not learned
from; with fewer than two rows of either class every score is just below 0.5. Repeated rows repeat; a label table with
several rows for an id counts each. Only the text enters a score. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, slices, utf8

FOLDS, HELD_OUT = 3, 1
#: Weights of the pooled covariance and of its diagonal in each class covariance.
TO_POOLED, TO_DIAGONAL = 0.5, 0.2
FLOOR = 1e-3
#: The statistics are not independent; their log ratio is divided by this for a score that is less sure.
TEMPERATURE = 4.0
NAMES = ("words", "word_bytes", "word_spread", "distinct", "top_word", "bars", "symbols", "shouts", "upper", "digits", "stops", "commas", "line_words", "distinct_lines", "short_words", "beyond_ascii", "rare_words", "line_ends")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS = b"#$%&*+=<>@^_~\\/{}[]"


def text_statistics(text: bytes | None) -> list[float]:
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)

    def share(chars: bytes) -> float:
        return float(np.log(FLOOR + (size - len(text.translate(None, chars)) if text else 0) / size))

    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return [
        float(np.log1p(len(words))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.log(FLOOR + len(counts) / n)),
        float(np.log(FLOOR + max(counts.values(), default=0) / n)),
        share(b"|"),
        share(SYMBOLS),
        share(b"!"),
        share(UPPER),
        share(DIGITS),
        share(b"."),
        share(b",;:"),
        float(np.log1p(len(words) / max(1, len(lines)))),
        float(np.log(FLOOR + len(set(lines)) / max(1, len(lines)))),
        float(np.log(FLOOR + (lengths <= 3).sum() / n)),
        float(np.log(FLOOR + sum(not w.isascii() for w in counts) / n)),
        float(np.log(FLOOR + sum(c == 1 for c in counts.values()) / n)),
        float(np.log(FLOOR + ends / max(1, len(lines)))),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([text_statistics(t) for t in utf8(batch.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


@dataclass
class Model:
    means: np.ndarray  # (2, d)
    factors: np.ndarray  # (2, d, d): inverses of the covariances' Cholesky factors
    log_dets: np.ndarray

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, for each row."""
        dens = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return dens[1] - dens[0]


def from_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> Model | None:
    """From each class's row count, sums (2, d) and sums of products (2, d, d)."""
    if n.min() < 2:
        return None
    means = s / n[:, None]
    scatter = ss - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    diagonal = np.diag(np.diag(pooled) + 1e-6)
    cov = (1 - TO_POOLED - TO_DIAGONAL) * scatter / n[:, None, None] + TO_POOLED * pooled + TO_DIAGONAL * diagonal
    lower = np.linalg.cholesky(cov + 1e-9 * np.eye(s.shape[1]))
    return Model(means, np.linalg.inv(lower), 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1))


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    known = labels.filter(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    rows = stats.join(known, F.col("doc_id") == F.col("_id"))
    one = F.concat(F.array(F.lit(1.0)), "x")
    products = rows.select("label", F.posexplode(F.flatten(F.transform(one, lambda a: F.transform(one, lambda b: a * b)))).alias("k", "v"))
    sums = products.groupBy("label", "k").agg(F.sum("v").alias("v")).collect()  # 2 * (d + 1) ** 2 numbers
    d = len(NAMES)
    table = np.zeros((2, (d + 1) ** 2))
    for r in sums:
        table[r["label"], r["k"]] = r["v"]
    table = table.reshape(2, d + 1, d + 1)
    return from_sums(table[:, 0, 0], table[:, 0, 1:], table[:, 1:, 1:])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and quality_score (0 to 1) of every row of docs."""
    stats = checkpointed(statistics(docs))
    model = fit(stats, labels)
    if model is None:
        return stats.select("doc_id", F.lit(0.5 - 1e-6).alias("quality_score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def logistic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            z = shared.value.log_ratio(np.stack(x.to_list())) if len(x) else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z / TEMPERATURE, -500, 500))))

    return stats.select("doc_id", logistic("x").alias("quality_score"))
