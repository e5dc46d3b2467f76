"""Repeated phrases: confirm recurring passages, compile sharded Aho-Corasick automata, stream documents through them.

Words lie between ASCII white space and are compared unchanged. A window is ``WINDOW`` consecutive words of a document; a
word is removed if a window over it has a word sequence that also starts in a document with a smaller doc_id.

1. Seeds. Of the ``SEED`` -word runs inside a window the one with the least hash stands for it, the same one wherever the
   window occurs; documents share such seeds among neighbouring windows, so about one word in five gives one. Seeds that
   two documents have are the only ones whose windows can recur. They are kept as a bitmap of ``SEED_SHARE`` bits a seed,
   between bounds: a false hit costs a few shuffled rows, never a result, and beyond the upper bound the next step
   shuffles more windows, not fewer.
2. Windows with such a seed are sorted by two hashes of 64 and 32 bits, made of two independent hashes of each word, so
   that windows that meet are equal; of equal ones the least (doc_id, position) is the source, and every window of a larger
   doc_id learns it. Their rows are streamed, never gathered, however many they are.
3. Neighbouring windows of a document with neighbouring sources join to passages. Each passage is cut from its source
   document once, whatever the number of shards of documents that repeat it; a document from which many passages are cut
   is dealt over several tasks.
4. Each shard compiles the automata of its passages (words as single characters, at most ``VOCABULARY`` different words
   in one automaton and ``PASSAGE`` words in one pattern; longer passages overlap) and streams its documents through them:
   every occurrence of a passage from a smaller doc_id is removed. The match compares the words themselves.
   Documents without a passage (known by bitmaps of ids, sized alike) are passed through without a shuffle.

Shards grow in number with the input and hold documents and the passages these repeat, so their memory is bounded by
their own text. Null texts have no words; documents without id are kept whole and are no source; rows that share an id
are one document whose rows do not shorten each other. Ids must cast to long. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions, sized, slices, utf8

WINDOW = 13
SEED = 5
#: Bits of a bitmap for each value it holds, and bounds on the logarithm of their number (128 MB).
SEED_SHARE, FEWEST_BITS, MOST_BITS = 16, 20, 30
#: Different words of an automaton, and words of a pattern; together fewer than there are characters.
VOCABULARY, PASSAGE = 1_000_000, 50_000
#: Passages that one task cuts from a document, at least.
CUTS_EACH = 256
#: Texts that are hashed at once: each byte of them takes about a hundred bytes of arrays.
HASHED_ROWS = 128
SHARDS_EACH = 4
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP, OTHER_STEP = np.uint64(0xD1B54A32D192ED03), np.uint64(0xAEF17502108EF2D9)


class Powers:
    """BASE ** i and its inverse modulo 2**64, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 19)
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each word starts and ends in them."""
    whole = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    white = WHITE[whole]
    return whole, np.nonzero(white[:-1] & ~white[1:])[0] + 1, np.nonzero(~white[:-1] & white[1:])[0] + 1


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the index of its text: a polynomial over the bytes, by prefix sums.

    Long words made of alternating halves can share it, as modulo 2**64 any such polynomial allows.
    """
    whole, start, end = words_of(texts)
    up, down = powers.upto(len(whole))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((whole.astype(np.uint64) + np.uint64(1)) * up)])
    hashes = mixed((sums[end] - sums[start]) * down[start])
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(begins, start, side="right") - 1


def other_hashes(texts: list[bytes]) -> np.ndarray:
    """An independent hash of every word: the sum of its mixed pairs of byte and place."""
    whole, start, end = words_of(texts)
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    firsts = np.cumsum(lengths) - lengths
    place = (np.arange(lengths.sum()) - np.repeat(firsts, lengths)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed((place << np.uint64(8)) + whole[~WHITE[whole]] + OTHER_STEP), firsts))


def runs_of(h: np.ndarray, n: int, step: np.uint64 = STEP) -> np.ndarray:
    """By start, the hash of n neighbouring words."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * step + h[k : len(h) - n + 1 + k]
    return mixed(out)


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """By start, the least of n neighbours."""
    k = 1
    while 2 * k <= n:
        x, k = np.minimum(x[: len(x) - k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def seeds_and_windows(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, ...]:
    """For every window: the index of its text, its position there, its seed and its two hashes."""
    h, of = word_hashes(texts, powers)
    if len(h) < WINDOW:
        return (*(np.zeros(0, np.int64) for _ in range(2)), *(np.zeros(0, np.uint64) for _ in range(2)), np.zeros(0, np.uint32))
    seed = least_of(runs_of(h, SEED), WINDOW - SEED + 1)
    inside = np.nonzero(of[: len(seed)] == of[WINDOW - 1 :])[0]
    first = np.searchsorted(of, np.arange(len(texts)))
    return of[inside], inside - first[of[inside]], seed[inside], runs_of(h, WINDOW)[inside], (runs_of(other_hashes(texts), WINDOW, OTHER_STEP)[inside] >> np.uint64(32)).astype(np.uint32)


def seeds(docs: DataFrame) -> DataFrame:
    """h: the distinct seeds of every document (row)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, HASHED_ROWS):
            of, _, seed, *_ = seeds_and_windows([t or b"" for t in utf8(batch.column("text"))], powers)
            if len(of):
                changed = np.r_[True, (seed[1:] != seed[:-1]) | (of[1:] != of[:-1])]
                of, seed = of[changed], seed[changed]
                order = np.lexsort((seed, of))
                of, seed = of[order], seed[order]
                seed = seed[np.r_[True, (seed[1:] != seed[:-1]) | (of[1:] != of[:-1])]]
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64))], ["h"])

    return docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(work, "h long")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits, as many as the rows ask for within the bounds, those of the top bits of h set; the driver gets no more than these."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (SEED_SHARE * hashes.count()).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    cells = hashes.select(F.shiftrightunsigned(place, 6).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def recurring_windows(docs: DataFrame) -> DataFrame:
    """doc, pos, src_doc, src_pos, alone: each window whose sequence starts in a smaller doc_id, and its first place.

    A window that a document repeats has one row, marked alone: it becomes a passage of its own, which the automaton
    finds wherever the document has it, so a line repeated in many documents shuffles a row for each document only.
    """
    spark = docs.sparkSession
    recurring = checkpointed(seeds(docs).groupBy("h").count().filter(F.col("count") > 1).select("h"))
    shared = spark.sparkContext.broadcast(bitmap(recurring))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), shared.value
        for batch in slices(batches, HASHED_ROWS):
            of, pos, seed, window, other = seeds_and_windows([t or b"" for t in utf8(batch.column("text"))], powers)
            keep = np.nonzero(in_bitmap(bits, seed))[0]
            if len(keep):
                keep = keep[np.lexsort((pos[keep], other[keep], window[keep], of[keep]))]
                again = (window[keep][1:] == window[keep][:-1]) & (other[keep][1:] == other[keep][:-1]) & (of[keep][1:] == of[keep][:-1])
                alone = np.r_[again, False] | np.r_[False, again]
                first = ~np.r_[False, again]
                at, ids = keep[first], batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(window[at].view(np.int64)), pa.array(other[at].view(np.int32)), pa.array(ids[of[at]], pa.int64()), pa.array(pos[at].astype(np.int32)), pa.array(alone[first])], ["h", "g", "doc", "pos", "alone"])

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_doc, last_pos = None, -1, -1
        for batch in batches:
            h, g, doc, pos, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "doc", "pos", "alone"))
            if not len(h):
                continue
            begins = np.r_[(h[0], g[0]) != last, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            at = np.maximum.accumulate(np.where(begins, np.arange(len(h)), -1))
            src_doc, src_pos = np.where(at >= 0, doc[at], last_doc), np.where(at >= 0, pos[at], last_pos)
            last, last_doc, last_pos = (h[-1], g[-1]), src_doc[-1], src_pos[-1]
            later = doc > src_doc
            if later.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[later], t) for x, t in ((doc, pa.int64()), (pos, pa.int32()), (src_doc, pa.int64()), (src_pos, pa.int32()), (alone, pa.bool_()))], ["doc", "pos", "src_doc", "src_pos", "alone"])

    found = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(candidates, "h long, g int, doc long, pos int, alone boolean")
    ordered = found.repartition(partitions(spark), "h", "g").sortWithinPartitions("h", "g", "doc", "pos")
    return ordered.mapInArrow(sources, "doc long, pos int, src_doc long, src_pos int, alone boolean")


def passages(windows: DataFrame, shards: int) -> DataFrame:
    """shard, src_doc, src_pos, words: runs of windows whose places and sources both go on, once a shard; and doc."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, doc, pos, src_doc, src_pos, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "doc", "pos", "src_doc", "src_pos", "alone"))
            if not len(doc):
                continue
            goes_on = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (src_doc[1:] == src_doc[:-1]) & (src_pos[1:] == src_pos[:-1] + 1) & ~alone[1:] & ~alone[:-1]
            start = np.r_[0, np.nonzero(~goes_on)[0] + 1]
            words = np.diff(np.r_[start, len(doc)]) + WINDOW - 1
            yield pa.RecordBatch.from_arrays([pa.array(shard[start]), pa.array(doc[start]), pa.array(src_doc[start]), pa.array(src_pos[start]), pa.array(words.astype(np.int32))], ["shard", "doc", "src_doc", "src_pos", "words"])

    placed = windows.withColumn("shard", shard_of(shards, "doc"))
    ordered = placed.repartition(partitions(windows.sparkSession), "shard").sortWithinPartitions("shard", "doc", "pos")
    return ordered.mapInArrow(join, "shard int, doc long, src_doc long, src_pos int, words int")


def shard_of(shards: int, *key):
    return F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int")


def automata(patterns: dict[tuple[bytes, ...], int], vocabulary: int = VOCABULARY) -> Iterator[tuple[dict[bytes, str], ahocorasick.Automaton]]:
    """Automata over patterns (word sequences and their sources), each with the characters of its words."""
    names: dict[bytes, str] = {}
    automaton = ahocorasick.Automaton()
    for words, source in patterns.items():
        if len(names) + len(words) > vocabulary and names:
            automaton.make_automaton()
            yield names, automaton
            names, automaton = {}, ahocorasick.Automaton()
        for w in words:
            if w not in names:
                k = len(names) + 1
                names[w] = chr(k if k < 0xD800 else k + 0x800)  # not a surrogate
        automaton.add_word("".join([names[w] for w in words]), (len(words), source))
    if names:
        automaton.make_automaton()
        yield names, automaton


def removed(words: list[bytes], doc: int, compiled: list) -> np.ndarray:
    """Which words lie in an occurrence of a passage from a smaller doc_id."""
    depth = np.zeros(len(words) + 1, np.int64)
    for names, automaton in compiled:
        get = names.get
        for end, (n, source) in automaton.iter("".join([get(w, "\0") for w in words])):
            if source < doc:
                depth[end + 1 - n] += 1
                depth[end + 1] -= 1
    return np.cumsum(depth[:-1]) > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space; null for a null text) of every row."""
    spark, longest, vocabulary = docs.sparkSession, PASSAGE, VOCABULARY
    shards = max(partitions(spark), SHARDS_EACH * docs.select("text").rdd.getNumPartitions())
    found = checkpointed(passages(recurring_windows(docs), shards))
    targets = bitmap(found.select(F.xxhash64("doc").alias("h")).distinct())
    origins = bitmap(found.select(F.xxhash64("src_doc").alias("h")).distinct())
    shared = spark.sparkContext.broadcast((targets, origins))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text")

    def chosen(which: int, inside: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value[which]
            for batch in batches:
                hit = in_bitmap(bits, batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)) & np.array(batch.column("id").is_valid())
                part = batch.filter(pa.array(hit == inside)).select(["id", "text"])
                if part.num_rows:
                    yield part

        return keyed.mapInArrow(work, "id long, text string")

    def cut(source_docs: pa.Table, spans: pa.Table) -> pa.Table:
        wanted: dict[int, list] = {}
        for to, src, pos, n in zip(*(spans.column(c).to_pylist() for c in ("shards", "src_doc", "src_pos", "words")), strict=True):
            wanted.setdefault(src, []).append((to, pos, n))
        out: list[tuple] = []
        for i, t in zip(source_docs.column("id").to_pylist(), utf8(source_docs.column("text").combine_chunks()), strict=True):
            if i in wanted:
                words = (t or b"").split()
                out += [(to, i, b" ".join(words[pos : pos + n])) for to, pos, n in wanted[i]]
        return pa.table({"shards": pa.array([o[0] for o in out], pa.list_(pa.int32())), "src_doc": pa.array([o[1] for o in out], pa.int64()), "passage": pa.array([o[2] for o in out], pa.binary()).cast(pa.string())})

    def stream(shard_docs: pa.Table, shard_passages: pa.Table) -> pa.Table:
        least: dict[tuple[bytes, ...], int] = {}
        for src, passage in zip(shard_passages.column("src_doc").to_pylist(), utf8(shard_passages.column("passage").combine_chunks()), strict=True):
            whole = tuple(passage.split(b" "))
            for begin in range(0, len(whole) - WINDOW + 1, longest - WINDOW + 1):
                words = whole[begin : begin + longest]
                least[words] = min(src, least.get(words, src))
        compiled = list(automata(least, vocabulary))
        rows = []
        for i, t in zip(shard_docs.column("id").to_pylist(), utf8(shard_docs.column("text").combine_chunks()), strict=True):
            words = (t or b"").split()
            gone = removed(words, i, compiled) if len(words) >= WINDOW else np.zeros(len(words), bool)
            rows.append((i, len(words), int(gone.sum()), None if t is None else b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
        return result(rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for i, t in zip(batch.column("id").to_pylist(), utf8(batch.column("text")), strict=True):
                words = (t or b"").split()
                rows.append((i, len(words), 0, None if t is None else b" ".join(words)))
            yield result(rows).to_batches()[0]

    def result(rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        i, n, gone, kept = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
        return pa.table({"doc_id": i, "n_words": n, "n_removed": gone, "kept": kept.cast(pa.string())})

    schema = "doc_id long, n_words long, n_removed long, kept string"
    # A passage is cut once, whatever the number of shards that want it (a list of so many small numbers at most). The copies
    # of a document for its parts together hold at most sixteen words for each of its passages, or the document once.
    spans = found.groupBy("src_doc", "src_pos", "words").agg(F.collect_set("shard").alias("shards"))
    each = F.greatest(F.lit(CUTS_EACH), F.max(F.col("src_pos") + F.col("words")) / 16)
    dealt = sized(checkpointed(spans.groupBy("src_doc").agg(F.ceil(F.count("*") / each).cast("int").alias("parts")).filter("parts > 1")))
    parts = F.coalesce("parts", F.lit(1))
    spans = spans.join(dealt, "src_doc", "left").withColumn("at", shard_of(shards, "src_doc", F.pmod(F.xxhash64("src_pos", "words"), parts).cast("int"))).drop("parts")
    sources = chosen(1, True).join(dealt.withColumnRenamed("src_doc", "id"), "id", "left").select("id", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("id", "text", shard_of(shards, "id", "part").alias("at"))
    pieces = sources.groupBy("at").cogroup(spans.groupBy("at")).applyInArrow(cut, "shards array<int>, src_doc long, passage string").select(F.explode("shards").alias("shard"), "src_doc", "passage")
    repeating = chosen(0, True).withColumn("shard", shard_of(shards, "id"))
    shortened = repeating.groupBy("shard").cogroup(pieces.groupBy("shard")).applyInArrow(stream, schema)
    return shortened.union(chosen(0, False).mapInArrow(whole, schema))
