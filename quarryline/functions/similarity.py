"""String similarities that Spark lacks, as Arrow-batched pandas functions over pairs of columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits per step of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        match = state & where.get(c, 0)
        state = ((state + match) | (state - match)) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times the share of characters that insertions and deletions leave alone; two empty strings are alike."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_window_ratio(a: str, b: str) -> float:
    """indel_ratio of the shorter string with the best window of its length, or less at the ends, of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    if short in long:
        return 100.0
    n, letters, best = len(short), set(short), 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        if window[0] in letters or window[-1] in letters:
            best = max(best, indel_ratio(short, window))
    return best


#: Cells of one step of best_window_ratios, over all pairs of a block.
STEP_CELLS = 1 << 14


def _codes(texts: list[str], pad: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), pad, np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def _window_ratios(shorts: list[str], longs: list[str], edges: list[tuple[bool, bool]] | None = None) -> list[float]:
    """best_window_ratio of pairs, the subsequences of all windows by one combing of strands through the pair's grid.

    edges says of each pair whether the shorter windows at the longer string's start and end count; by default both do.
    """
    a, b = _codes(shorts, -1)[:, ::-1], _codes(longs, -2)
    m, n = a.shape[1], b.shape[1]
    kind = np.int16 if m + n < 1 << 15 else np.int32
    h, v = (np.tile(np.arange(k, k + size, dtype=kind), (len(shorts), 1)) for k, size in ((0, m), (m, n)))
    for d in range(m + n - 1):  # diagonals; a runs backwards, so both sides of a step are slices
        p, q = max(0, m - 1 - d), min(m, m + n - 1 - d)
        j, k = p + d - m + 1, q + d - m + 1
        x, y = h[:, p:q], v[:, j:k]
        turn = (a[:, p:q] == b[:, j:k]) | (x > y)
        h[:, p:q], v[:, j:k] = np.where(turn, y, x), np.where(turn, x, y)
    out = []
    for row, short, long, (first, last) in zip(v.astype(np.int64) - m, shorts, longs, edges or [(True, True)] * len(shorts), strict=True):
        size, length = len(short), len(long)
        start = row[:length]  # where the strand that ends under each letter began; before 0: at the side
        end = np.full(length, n)
        end[start[start >= 0]] = np.nonzero(start >= 0)[0]
        # Letters left out of a window: strands that begin and end in it.
        heads = np.arange(1, length + 1) - np.cumsum(start >= 0)
        tails = np.arange(length, 0, -1) - np.cumsum((end < length)[::-1])[::-1]
        i = np.arange(length - size)
        whole = heads[size - 1] + np.r_[0, np.cumsum((end[i] < i + size).astype(int) - (start[i + size] > i))]
        edge = size + np.arange(1, size)
        every = [200.0 * whole / (2 * size), *([200.0 * heads[: size - 1] / edge] if first else []), *([200.0 * tails[length - size + 1 :] / edge[::-1]] if last else [])]
        out.append(float(np.concatenate(every).max()))
    return out


def best_window_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """best_window_ratio of each pair of whole texts, many pairs of like lengths at a time."""
    out = [0.0] * len(pairs)
    todo = []
    for i, (a, b) in enumerate(pairs):
        short, long = sorted((a, b), key=len)
        if short in long:
            out[i] = best_window_ratio(short, long)
        elif short:
            todo.append((len(short), len(long), i, short, long))
    todo.sort()
    at = 0
    while at < len(todo):
        block = todo[at : at + max(1, STEP_CELLS // todo[at][0])]
        at += len(block)
        for t, ratio in zip(block, _window_ratios([t[3] for t in block], [t[4] for t in block]), strict=True):
            out[t[2]] = ratio
    return out


#: Sizes of the grams that windows are counted by.
GRAMS = (2, 3)
#: Letters of texts that are searched at once.
SEARCHED = 1 << 20


class Windows:
    """The windows of texts that can reach a ratio with a term, found by counting grams of the term at their places.

    A window of m letters whose ratio with a term of n is at least ``least`` has a common subsequence of L >= least (n + m) / 200
    letters. So n - L letters of the term are left out, each of which breaks at most q of its n - q + 1 grams, and m - L letters
    of the window stand between, each of which breaks at most q - 1. The other grams of the term stand in the window, at
    places of their own: it has at least n - q + 1 - q (n - L) - (q - 1)(m - L) places with a gram of the term. Windows
    with fewer are left out, for every gram size; no window that reaches the ratio is.
    """

    def __init__(self, term: str, least: float):
        self.term, self.least, n = term, least, len(term)
        letters = sorted(set(term))
        self.place = np.zeros(0x110000, np.int64)
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        self.grams = []  # size, which codes are grams of the term, least count by length of window
        for q in (1, *(q for q in GRAMS if self.base**q < 1 << 24)):
            known = np.zeros(self.base**q, bool)
            known[self._codes(self.place[[ord(c) for c in term]], q)[: max(0, n - q + 1)]] = True
            self.grams.append((q, known, np.array([self.bound(n, m, q) for m in range(n + 1)])))

    def common(self, n: int, m: int) -> int:
        """The least common subsequence that reaches the ratio."""
        return int(np.ceil(self.least * (n + m) / 200 - 1e-9))

    def bound(self, n: int, m: int, q: int) -> int:
        """The least number of grams of a string of n letters in one of m; more than there can be where m is too short."""
        common = self.common(n, m)
        return n + 1 if common > m else n - q + 1 - q * (n - common) - (q - 1) * (m - common)

    def _codes(self, places: np.ndarray, q: int) -> np.ndarray:
        """By start the code of the q letters there; 0 stands for all letters that the term does not have, and after the end."""
        out = np.zeros(len(places), np.int64)
        for k in range(q):
            out = out * self.base + (places if not k else np.r_[places[k:], np.zeros(min(k, len(places)), np.int64)])
        return out

    def spans(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, start, end) of the stretches that hold all windows that can reach the ratio, whole texts where they are shorter than the term."""
        n, lengths = len(self.term), np.array([len(t) for t in texts])
        start = np.cumsum(lengths + 1) - lengths - 1  # a letter that is none between the texts
        places = self.place[np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        of = np.repeat(np.arange(len(texts)), lengths + 1)[: len(places)]
        room = (start + lengths)[of] - np.arange(len(places))
        whole = room >= n
        head, tail, small = lengths >= n, lengths >= n, lengths < n
        heads, tails = {}, {}
        for q, known, bound in self.grams:
            sums = np.r_[0, np.cumsum(known[self._codes(places, q)])]

            def count(begin: np.ndarray, m: int | np.ndarray, q: int = q, sums: np.ndarray = sums) -> np.ndarray:
                return sums[begin + np.maximum(m - q + 1, 0)] - sums[begin]

            at = np.nonzero(whole)[0]
            whole[at[count(at, n) < bound[n]]] = False
            for m in range(1, n):
                if self.common(n, m) <= m:
                    heads[m] = heads.get(m, head) & (count(start, np.minimum(m, lengths)) >= bound[m])
                    tails[m] = tails.get(m, tail) & (count(np.maximum(start, start + lengths - m), np.minimum(m, lengths)) >= bound[m])
            # A text shorter than the term is the one that lies in a window of it.
            least = np.array([min((self.bound(k, m, q) for m in range(1, k + 1)), default=0) for k in range(n)] or [0])
            small &= count(start, lengths) >= least[np.minimum(lengths, len(least) - 1)]
        out = [(int(k), 0, int(lengths[k])) for k in np.nonzero(small & (lengths > 0))[0]]
        # Windows of a text that overlap are one stretch; windows at the ends are those of the first and last letters.
        edge = [start[hit] for hit in heads.values()] + [(start + lengths - n)[hit] for hit in tails.values()]
        begin = np.unique(np.concatenate([np.nonzero(whole)[0], *edge]).astype(np.int64))
        if len(begin):
            cut = np.nonzero((np.diff(begin) > n) | (np.diff(of[begin]) > 0))[0]
            for a, b in zip(begin[np.r_[0, cut + 1]].tolist(), begin[np.r_[cut, len(begin) - 1]].tolist(), strict=True):
                k = int(of[a])
                out.append((k, a - int(start[k]), b + n - int(start[k])))
        return out

    def ratios(self, texts: list[str]) -> np.ndarray:
        """best_window_ratio of the term with each text where it is at least least, else not a number."""
        best = np.full(len(texts), np.nan)
        if not self.term:
            return best
        todo, n = [], len(self.term)
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < SEARCHED:
                size += len(texts[end])
                end += 1
            for k, a, b in self.spans(texts[at:end]):
                text = texts[at + k]
                if len(text) < n:
                    todo.append((len(text), n, at + k, text, self.term, (True, True)))
                elif self.term in text[a:b]:
                    best[at + k] = 100.0
                else:
                    todo.append((n, b - a, at + k, self.term, text[a:b], (a == 0, b == len(text))))
            at = end
        todo = sorted(t for t in todo if not best[t[2]] == 100.0)
        at = 0
        while at < len(todo):
            block = todo[at : at + max(1, STEP_CELLS // todo[at][0])]
            at += len(block)
            found = _window_ratios([t[3] for t in block], [t[4] for t in block], [t[5] for t in block])
            for t, ratio in zip(block, found, strict=True):
                if ratio >= self.least:
                    best[t[2]] = np.fmax(best[t[2]], ratio)
        return best


def reaching_similarity(variants: list[str], least: float):
    """A function of a column: the best partial_similarity of the variants where it is at least ``least``, else null."""

    @F.pandas_udf(DoubleType())
    def reach(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        out = np.full(len(texts), np.nan)
        some = list(texts[known])
        for v in variants:
            out[known] = np.fmax(out[known], Windows(v, least).ratios(some))
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return reach


def token_set_ratio(a: str, b: str) -> float:
    """Best indel_ratio among the common tokens and the common tokens with either rest; 100 if one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base, left, right = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    found = [indel_ratio(left, right)]
    return max([*found, indel_ratio(base, left), indel_ratio(base, right)] if both else found)


def _paired(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = best_window_ratios(list(zip(a[known], b[known], strict=True)))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _paired(token_set_ratio, a, b)


@F.pandas_udf(DoubleType())
def matcher_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _paired(lambda x, y: SequenceMatcher(None, x, y).ratio(), a, b)
