"""Periodic runs: stretches of words that repeat with a period, found by probing a harmonic grid.

Words lie between ASCII white space. A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``LEAST`` words and two periods long, that no neighbouring word extends keeping period q.

A run of period p and length 2p or more has p consecutive places i with word[i] = word[i + p], and so one at a multiple of
p: it is enough to test word[jp] = word[(j + 1)p] for every p and j, n log n probes in a text of n words. Short texts take
their probes from one table ordered by the later word, of which a text needs a prefix; long ones take strided slices, by
period up to the square root of n and by j beyond it. The places that pass are compared with ``NEAR`` neighbours on both
sides all at once; where many are still open, sums over whole stretches reject those that cannot reach a period's length;
the rest grow chunk by chunk, each chunk twice as long, comparing the words themselves. Probes are left out where a run is
already known: within a stretch of the same period, and where both words lie within one run whose period divides p, because
the maximal stretch of period p is then that run itself. A stretch that has several periods keeps the smallest: two periods
of a stretch of twice the larger one have their greatest common divisor as a period, so they share its bounds.

A document is one row of one task from start to end: nothing is shuffled, collected or broadcast, and a text costs
memory for itself and its words.

A null text has no words, no runs and a null ``collapsed``; an empty one an empty ``collapsed``. Null ids, repeated ids and
repeated rows each get their row; of equal texts all results are equal. Extra columns are ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

LEAST = 12
NEAR = 8
#: Texts of up to so many words take their probes from one table of about 9 probes a word.
TABLE_WORDS = 4096
FIRST_CHUNK = 64
#: Probes of a long text that are worked on at once.
PIECE = 1 << 16
#: So few probes are extended at once, more go through the sums first.
FEW = 64

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_grid: list[np.ndarray] = []


def _table() -> list[np.ndarray]:
    """Earlier word and period of every probe, ordered by the later word; made once in a Python worker."""
    if not _grid:
        periods = [np.full((TABLE_WORDS - 1) // p, p, np.int32) for p in range(1, TABLE_WORDS)]
        later = np.concatenate([np.arange(1, len(x) + 1, dtype=np.int32) * x for x in periods])
        period = np.concatenate(periods)
        order = np.argsort(later, kind="stable")
        _grid.extend((later[order] - period[order], period[order], later[order]))
    return _grid


def probes(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The probes (place, period) whose two words are equal, in pieces; small periods come first."""
    n = len(ids)
    if n <= TABLE_WORDS:
        at, period, later = _table()
        most = np.searchsorted(later, n)
        at, period = at[:most], period[:most]
        hit = np.nonzero((ids[at] == ids[at + period]) & (period <= n // 2))[0]
        hit = hit[np.lexsort((at[hit], period[hit]))]
        yield at[hit].astype(np.int64), period[hit].astype(np.int64)
        return
    root = isqrt(n)
    for p in range(1, root + 1):
        for begin in range(0, n - p, p * PIECE):
            j = begin // p + np.nonzero(ids[begin : min(n - p, begin + p * PIECE) : p] == ids[begin + p : begin + p + p * PIECE : p])[0]
            yield j * p, np.full(len(j), p, np.int64)
    for j in range((n - 1) // (root + 1)):
        last = min(n // 2, (n - 1) // (j + 1))
        for first in range(root + 1, last + 1, PIECE):
            stop = min(last + 1, first + PIECE)
            earlier = ids[j * first : j * (stop - 1) + 1 : j] if j else ids[0]
            p = np.nonzero(earlier == ids[(j + 1) * first : (j + 1) * (stop - 1) + 1 : j + 1])[0] + first
            yield j * p, p


class _Text:
    """A sequence of word numbers with what is known of its runs."""

    def __init__(self, ids: np.ndarray, least: int):
        self.ids, self.least, n = ids, least, len(ids)
        pad = -1 - np.arange(2 * NEAR, dtype=ids.dtype)  # differs from all words and within itself
        self.padded = np.concatenate([pad[:NEAR], ids, pad[NEAR:]])
        # Over each place the run found that ends last, and the one of smallest period: where it ends, its period.
        self.known = [(np.zeros(n, np.int64), np.full(n, n, np.int64)) for _ in range(2)]
        self.found: dict[tuple[int, int], int] = {}
        self.sums: np.ndarray | None = None

    def news(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Which probes no known run explains."""
        return ~np.logical_or.reduce([(at + period < end[at]) & (period % q[at] == 0) for end, q in self.known])

    def near(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Which probes may be within long enough a run, as far as NEAR neighbours on both sides tell."""
        step = np.arange(1, NEAR + 1)
        right, left, gap = at[:, None] + NEAR + step, at[:, None] + NEAR - step, period[:, None]
        right = self.padded[right] != self.padded[np.minimum(right + gap, len(self.padded) - 1)]
        left = self.padded[left] != self.padded[left + gap]
        ends = right.any(axis=1), left.any(axis=1)
        equal = 1 + np.where(ends[0], right.argmax(axis=1), NEAR) + np.where(ends[1], left.argmax(axis=1), NEAR)
        return ~ends[0] | ~ends[1] | (equal >= np.maximum(self.least - period, period))

    def far(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """The same by sums over whole stretches, which are equal for equal words: it never rejects a run."""
        n = len(self.ids)
        if self.sums is None:
            with np.errstate(over="ignore"):
                draw = np.random.default_rng(11)
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, draw.integers(1, 1 << 62) * 2 + 1, np.uint64)], dtype=np.uint64)
                weights = draw.integers(0, 1 << 63, int(self.ids.max()) + 1, dtype=np.uint64)
                self.sums = np.r_[np.uint64(0), np.cumsum(weights[self.ids] * self.powers[:-1], dtype=np.uint64)]

        def same(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return (self.sums[stop] - self.sums[start]) * self.powers[period] == self.sums[stop + period] - self.sums[start + period]

        right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 1 << max(self.least, int(period.max())).bit_length()
        while step:
            go = np.minimum(right + step, n - period - at)
            right = np.where(same(at, at + go), go, right)
            go = np.minimum(left + step, at)
            left = np.where(same(at - go, at), go, left)
            step >>= 1
        return right + left >= np.maximum(self.least - period, period)

    def grow(self, i: int, p: int) -> int:
        """Extends the probe to the whole stretch of period p, notes it if it is long enough, and returns where it ends."""
        ids = self.ids
        end = i + _agreeing(ids[i : len(ids) - p], ids[i + p :])
        start = i - _agreeing(ids[:i][::-1], ids[p : i + p][::-1])
        length = end - start + p
        if length >= max(self.least, 2 * p):
            self.found[start, length] = min(p, self.found.get((start, length), p))
            stretch = slice(start, start + length)
            for (ends, periods), better in zip(self.known, (self.known[0][0][stretch] < start + length, self.known[1][1][stretch] > p), strict=True):
                ends[stretch][better] = start + length
                periods[stretch][better] = p
        return end


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start a and b agree, compared in growing chunks."""
    n, at, chunk = min(len(a), len(b)), 0, FIRST_CHUNK
    while at < n:
        same = a[at : min(n, at + chunk)] == b[at : min(n, at + chunk)]
        if not same.all():
            return at + int(same.argmin())
        at, chunk = at + chunk, 2 * chunk
    return n


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    if len(ids) < max(2, least):
        return []
    text = _Text(ids, least)
    for at, period in probes(ids):
        for check in (text.news, text.near, text.far):
            if len(at) and (check != text.far or len(at) > FEW):
                keep = check(at, period)
                at, period = at[keep], period[keep]
        now, done = 0, 0
        for i, p in zip(at.tolist(), period.tolist(), strict=True):
            if p != now:
                now, done = p, 0
            if i >= done and not any(i + p < end[i] and p % q[i] == 0 for end, q in text.known):
                done = text.grow(i, p)
    return sorted((s, length, p) for (s, length), p in text.found.items())


def numbers(words: list[bytes]) -> np.ndarray:
    """Each word's number by first appearance in its text."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.nonzero(np.cumsum(gone[:-1]) == 0)[0].tolist()])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            counts, all_runs, short = [], [], []
            for t in utf8(batch.column(1)):
                words = (t or b"").split()
                found = runs(numbers(words))
                counts.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                short.append(None if t is None else collapsed(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(_RUN)), pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", text).mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(found: Column) -> Column:
    """The run of greatest length, of equal ones the one of smallest start, then period; null without runs."""
    return F.try_element_at(F.array_sort(F.transform(found, lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(1))


def listed(found: Column) -> Column:
    """Every run's start,length,period and a line feed, in order."""
    return F.array_join(F.transform(found, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
