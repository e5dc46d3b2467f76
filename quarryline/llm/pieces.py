"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

``encode`` adds the piece ids of every whole text, ``decode`` turns ids back into text. The piece table (its size is
the vocabulary's, a constant) is read on the driver and broadcast, so executors need no vocabulary file.

Text becomes one dummy space plus the text, spaces written as U+2581, as the identity normaliser of the model does.
Pieces hold that mark only at their front, and no piece joins two characters of different kinds (those that pieces
link by standing side by side in them: letters, punctuation, a digit alone), so the text falls apart exactly into units
``mark* kind*``; a unit's ids depend on nothing else and are kept in a bounded per-worker memo. A vocabulary with marks
elsewhere makes the whole text one unit.

For each position the automaton reports every piece of two characters or more that ends there, by its output links, and
each relaxes the best score of the prefix, last the character alone. In a unigram model any path counts and the best sum of scores wins (of equal sums the longest last
piece). In a BPE model (``bpe=True``) a piece relaxes a prefix only if it and the piece before it are what merging would
leave of their joined text, so the path is that of the merge algorithm; merging has one result, so only one
piece can relax each prefix, and the others need no look. A character that no piece covers becomes its UTF-8 byte pieces, or the
unknown id in a vocabulary without them.

Null texts have null ids; an empty text has none. Repeated rows each get their ids; a table without rows gives none.
Other columns, whatever their names, are kept, except that the output column is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct units, none longer than so many characters, and piece pairs that a worker remembers in each of two generations.
MEMO, MEMO_CHARS, PAIR_MEMO = 200_000, 64, 400_000
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)
#: A character without a piece scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0


def read_table(model_file: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    p = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def kind(i: int) -> int:
        return UNKNOWN if p.is_unknown(i) else CONTROL if p.is_control(i) else BYTE if p.is_byte(i) else NORMAL

    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


def kinds(pieces: Iterable[str]) -> list[str]:
    """The characters but the mark that pieces link by holding them side by side, the largest set first."""
    of: dict[str, set[str]] = {}
    for a, b in {pair for p in pieces for pair in pairwise(p) if MARK not in pair}:
        one, two = sorted((of.setdefault(a, {a}), of.setdefault(b, {b})), key=len)
        if one is not two:
            two |= one
            of.update(dict.fromkeys(one, two))
    return sorted(("".join(sorted(x)) for x in {id(x): x for x in of.values()}.values()), key=len, reverse=True)


class Memo(dict):
    """A dict that computes what it lacks. When full it keeps one older generation, from which used entries return."""

    def __init__(self, make, most: int = MEMO, too_long=lambda key: False):
        super().__init__()
        self.make, self.most, self.too_long, self.older = make, most, too_long, {}

    def __missing__(self, key):
        if self.too_long(key):
            return self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Codec:
    """Encoder and decoder of one piece table; memory is the table's, the automaton's and two bounded memos'."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool):
        self.bpe = bpe
        self.ids = {p: (i, s) for i, (p, s, k) in enumerate(pieces) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"" for p, _, k in pieces]
        self.unknown_score = min((s for _, s in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        split = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.unit = re.compile("".join([f"{MARK}*(?:", *(f"[{re.escape(x)}]+|" for x in kinds(self.ids)), f"[^{MARK}])|{MARK}+"]) if split else "(?s:.+)")
        self.names = [p for p, _, _ in pieces]
        #: Pieces that merging makes of their own characters; only those occur in a BPE text.
        self.whole = [k == NORMAL and self.merged(p) == [p] for p, _, k in pieces] if bpe else []
        self.apart = Memo(self._stay_apart, PAIR_MEMO)
        self.scores = [s for _, s, _ in pieces]
        self.lengths = [len(p) for p, _, _ in pieces]
        self.single = Memo(lambda char: self.ids.get(char, (-1, self.unknown_score)))
        self.automaton = ahocorasick.Automaton()
        for p, (i, _) in self.ids.items():
            if len(p) > 1 and (not bpe or self.whole[i]):
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.units = Memo(lambda u: pack(self.path(u)), too_long=lambda u: len(u) > MEMO_CHARS)

    def merged(self, text: str) -> list[str]:
        """What merging the best pair again and again (of equal ones the first) leaves of a short text."""
        none = (-1, float("-inf"))
        parts = list(text)
        gains = [self.ids.get(a + b, none)[1] for a, b in pairwise(parts)]
        while gains and (best := max(gains)) > none[1]:
            k = gains.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gains[k]
            for j in range(max(0, k - 1), min(k + 1, len(gains))):
                gains[j] = self.ids.get(parts[j] + parts[j + 1], none)[1]
        return parts

    def _stay_apart(self, pair: int) -> bool:
        """Whether merging the joined text of two pieces leaves the two."""
        one, two = self.names[pair // len(self.names)], self.names[pair % len(self.names)]
        return self.merged(one + two) == [one, two]

    def _unknown(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def path(self, unit: str) -> list[int]:
        """Viterbi: by end, the best score of the prefix and its last piece (-1: its last character has none)."""
        apart, count, scores, lengths, bpe, single = self.apart, len(self.names), self.scores, self.lengths, self.bpe, self.single
        last_id, score = [-1] * (len(unit) + 1), [0.0] + [float("-inf")] * len(unit)
        settled = 0
        for last, i in chain(self.automaton.iter(unit), ((len(unit), -1),)):
            while settled < last:  # all longer pieces up to here are seen: the character alone is what remains to relax
                alone, one = single[unit[settled]]
                settled += 1
                if last_id[settled] < 0 or not bpe and alone >= 0 and score[settled - 1] + one > score[settled]:
                    score[settled], last_id[settled] = score[settled - 1] + one, alone
            if i >= 0 and not (bpe and last_id[last + 1] >= 0):
                begin = last + 1 - lengths[i]
                found = score[begin] + scores[i]
                if found > score[last + 1] and (not bpe or (before := last_id[begin]) < 0 or apart[before * count + i]):
                    score[last + 1], last_id[last + 1] = found, i
        ids: list[int] = []
        end = len(unit)
        while end:
            i = last_id[end]
            if i >= 0:
                ids.append(i)
                end -= lengths[i]
            else:
                ids += self._unknown(unit[end - 1])[::-1]
                end -= 1
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        return b"".join(map(self.units.__getitem__, self.unit.findall(MARK + text.replace(" ", MARK)))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        whole = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return whole.removeprefix(b" ").decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(shared, bpe: bool) -> Codec:
    """One codec per Python worker and broadcast."""
    if shared.value[0] not in _codecs:
        _codecs.clear()
        _codecs[shared.value[0]] = Codec(shared.value[1], bpe)
    return _codecs[shared.value[0]]


def _shared(df: DataFrame, model_file: str, bpe: bool):
    pieces = read_table(model_file)
    return df.sparkSession.sparkContext.broadcast((hash((tuple(pieces), bpe)), pieces))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model_file: str = MODEL, bpe: bool = True) -> DataFrame:
    """docs with the piece ids of each text as array<int>."""
    shared, kept = _shared(docs, model_file, bpe), [c for c in docs.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _codec(shared, bpe)
        for batch in slices(batches):
            ids = [None if t is None else of.encode(t) for t in batch.column(text).to_pylist()]
            offsets = np.cumsum([0, *(len(x or b"") // 4 for x in ids)])
            mask = pa.array([x is None for x in ids])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.int32)), mask=mask)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], [*kept, out])

    kinds = dict(docs.dtypes)
    return docs.select([f"`{c}`" for c in dict.fromkeys([*kept, text])]).mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{out}` array<int>"]))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", model_file: str = MODEL) -> DataFrame:
    """docs with the text of each id list; ids outside the vocabulary fail the job rather than pass unseen."""
    shared, kept = _shared(docs, model_file, True), [c for c in docs.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _codec(shared, True)
        for batch in slices(batches):
            column = batch.column(ids)
            texts = [of.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{out}` string"]))


def round_trip(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """Per document its ids, and whether decoding them gives the text again.

    ``exact`` is null for a null text; it is false only where a text itself holds U+2581, which decodes as a space.
    """
    both = decode(encode(docs, model_file=model_file), model_file=model_file)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("exact"))
