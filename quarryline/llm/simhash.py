"""SimHash near-duplicates through a byte-position inverted index with count filtering.

``fingerprints``: A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats (a text of one or two
words is one shingle), XXH64 with seed 42; a bit is set if over half the shingles set it. No words (null or empty
text): fingerprint zero, which links like any other.

``links``: two fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so at least 5 bytes agree
at their positions. A posting list for a single byte would hold 1/256 of all rows and pair quadratically, so the index
keys are byte positions taken three at a time: of the two halves of the word one holds at least 3 of the 5 agreeing
bytes, hence the 4 + 4 triples within a half reach every pair. Within a posting list the agreeing bytes of each pair
are tallied, pairs with 5 or more are kept and their bits counted. A list with over ``LIST_MOST`` fingerprints is keyed
anew by two more agreeing bytes (10 ways, again without loss); such a list can hold at most 2**24 distinct
fingerprints, whose neighbours are looked up by flipping bits of the 3 open bytes, in time linear in its length.

A posting list yields only the edges of a spanning forest, so a dense group never becomes all its pairs. Fingerprints
are distinct before they are indexed: copies cost one row. Components are then found over all lists.

Null ids: such rows have fingerprints and components (the least known id, null if the group has none) and
``representatives`` never drops them. Rows that repeat an id are one document: one of them stays. No rows give none;
extra columns are ignored by ``components`` and kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import checkpointed, partitions, slices, utf8

WORDS = 3
SEED = 42
MOST_BITS = 3
MATCHES = 8 - MOST_BITS
LIST_MOST = 4096
#: Lists this short are compared by vector shifts over many lists at once.
SHORT = 16
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
MASKS = np.array([sum(1 << b for b in bits) for k in range(1, MOST_BITS + 1) for bits in combinations(range(24), k)], dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", text).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _key(name: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(name).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def postings(distinct: DataFrame) -> DataFrame:
    """(key, fp): the inverted index over distinct fingerprints, long lists keyed anew."""
    first = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), _key(i + 1, t).alias("key")) for i, t in enumerate(TRIPLES)))).alias("e")).select("e.t", "e.key", "fp")
    long_lists = first.groupBy("key").count().filter(F.col("count") > LIST_MOST).select("key", F.lit(True).alias("long"))
    marked = first.join(long_lists, "key", "left")
    again = F.array()
    for i, t in reversed(list(enumerate(TRIPLES))):
        pairs = list(combinations([p for p in range(8) if p not in t], 2))
        again = F.when(F.col("t") == i, F.array(*(_key(len(TRIPLES) + 1 + 10 * i + k, t + pair) for k, pair in enumerate(pairs)))).otherwise(again.cast("array<bigint>"))
    return marked.select(F.explode(F.when(F.col("long"), again).otherwise(F.array("key"))).alias("key"), "fp")


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where x and y (uint64, alike in shape) agree in enough bytes and differ in few enough bits."""
    differ = x ^ y
    tally = (differ.reshape(-1, 1).view(np.uint8) == 0).sum(axis=1)
    out = tally >= MATCHES
    out[out] = np.bitwise_count(differ.ravel()[out]) <= MOST_BITS
    return out.reshape(differ.shape)


def _pairs(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of near fingerprints of one list, in blocks of bounded size."""
    if len(x) <= LIST_MOST:
        step = max(1, 400_000 // len(x))
        for at in range(0, len(x), step):
            i, j = np.nonzero(near(*np.broadcast_arrays(x[at : at + step, None], x[None, :])))
            keep = i + at < j
            yield i[keep] + at, j[keep]
        return
    # All share 5 bytes; the others are brought to the low 24 bits.
    open_bytes = [b for b in range(8) if len(np.unique((x >> np.uint64(8 * b)) & np.uint64(255))) > 1]
    low = sum(((x >> np.uint64(8 * b)) & np.uint64(255)) << np.uint64(8 * k) for k, b in enumerate(open_bytes))
    order = np.argsort(low)
    low = low[order]
    for mask in MASKS:
        at = np.minimum(np.searchsorted(low, low ^ mask), len(low) - 1)
        i = np.nonzero((low[at] == low ^ mask) & (low < low ^ mask))[0]
        yield order[i], order[at[i]]


def forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) of the near-components of one list."""
    label = np.arange(len(x))
    for i, j in _pairs(x):
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    member = np.nonzero(label != np.arange(len(x)))[0]
    return x[member], x[label[member]]


def list_edges(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of whole posting lists, given sorted by key."""
    start = np.r_[0, np.nonzero(np.diff(keys))[0] + 1]
    length = np.diff(np.r_[start, len(keys)])
    out = [forest(x[s : s + n]) for s, n in zip(start[length > SHORT], length[length > SHORT], strict=True)]
    out.append((x[:0], x[:0]))
    short = np.repeat(length <= SHORT, length)
    for d in range(1, min(SHORT, int(length.max()))):
        i = np.nonzero((keys[:-d] == keys[d:]) & short[:-d])[0]
        i = i[near(x[i], x[i + d])]
        out.append((x[i], x[i + d]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): edges that connect all near fingerprints, a spanning forest for each posting list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the last key, which may go on

        def edges(keys: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            a, b = list_edges(keys, x)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        for batch in batches:
            keys, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(keys):
                continue
            x = x.view(np.uint64)
            if held and held[0][0][-1] == keys[-1]:
                held.append((keys, x))
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            whole = [*held, (keys[:cut], x[:cut])]
            keys, x, held = np.concatenate([k for k, _ in whole]), np.concatenate([v for _, v in whole]), [(keys[cut:], x[cut:])]
            if len(keys):
                yield edges(keys, x)
        if held:
            yield edges(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))

    spread = postings(distinct).repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return spread.mapInArrow(work, "u long, v long")


def components(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = checkpointed(fingerprints(docs, text))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = connected_components(links(classes.select("fp")))
    of_class = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of_class.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the least id, with all its columns; rows without an id all stay."""
    kept = components(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    joined = docs.alias("d").join(checkpointed(kept).alias("k"), F.col("d.doc_id") == F.col("k.doc_id"), "left")
    once = joined.filter(F.col("d.doc_id").isNull() | (F.col("k.rows") == 1)).select("d.*")
    return once.union(joined.filter(F.col("k.rows") > 1).select("d.*").dropDuplicates(["doc_id"]))
