"""Benchmark decontamination with DataFrame functions only.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A benchmark item's windows are its runs of
13 words, or the whole item if it has fewer (an item without words has none). Windows of documents are hashed inside
their row: arrays of hashes of 1, 2, 4 and 8 neighbouring words are built by pairwise ``zip_with``, and a window of any
length combines at most three of them. A hash passes if its bit is set in a bitmap of the benchmark's hashes, a literal of
bounded size; the few windows that pass are exploded with their words and joined with the benchmark windows on hash
and words, so every hit is verified. The windows are broadcast only if their counted number and that of the items they
list are within ``BROADCAST_WINDOWS``; a larger set is joined by shuffle. One row per document and passing window is shuffled, never
its text.

Nulls: a null text has no words; null ids are ids like others on the document side, and an item without id marks words
but is not listed. Rows equal in id and text each get the (same) result row; equal ids with different texts are judged
apart. An empty benchmark contaminates nothing; no documents give no rows. Extra columns are ignored by
``contamination`` and kept by ``clean``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated if one word in so many, or more, is hit.
SHARE = 20
BROADCAST_WINDOWS = 200_000
#: 64-bit cells of the bitmap: about 256 bits a window, between these bounds.
FEWEST_CELLS, MOST_CELLS = 1 << 8, 1 << 16


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _pairwise(a: Column, b: Column, n: Column) -> Column:
    """Hashes of a's and b's neighbours; both are cut to n elements."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.xxhash64(x, y))


def _hashed(df: DataFrame, longest: int) -> DataFrame:
    """df(words) with _h1, _h2, ...: hashes of 1, 2, 4, ... neighbouring words by start, up to the longest needed."""
    df = df.withColumn("_h1", F.transform("words", lambda w: F.xxhash64(w)))
    k = 1
    while 2 * k <= longest:
        n = F.greatest(F.size(f"_h{k}") - k, F.lit(0))
        df = df.withColumn(f"_h{2 * k}", _pairwise(F.col(f"_h{k}"), F.slice(f"_h{k}", F.lit(1 + k), n), n))
        k *= 2
    return df


def _window_hash(length: int) -> Column:
    """By start, the hash of each run of so many words."""
    n = F.greatest(F.size("words") - (length - 1), F.lit(0))
    out, at = None, 0
    for k in (8, 4, 2, 1):
        if at + k <= length:
            part = F.slice(f"_h{k}", F.lit(1 + at), n)
            out = part if out is None else _pairwise(out, part, n)
            at += k
    return out


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, gram (its words), length and items (sorted ids as strings) of every distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    single = items.select("item", F.explode(grams).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hashed = _hashed(single, window)
    by_length = F.lit(None).cast("bigint")
    for k in range(1, window + 1):
        by_length = F.when(F.size("words") == k, F.get(_window_hash(k), F.lit(0))).otherwise(by_length)
    return hashed.select(by_length.alias("hash"), F.col("words").alias("gram"), F.size("words").alias("length"), "items")


def _bitmap(windows: DataFrame, cells: int) -> Column:
    """An array literal of the set bits: the top bits of a hash name the cell, its lowest six the bit."""
    bits = cells.bit_length() - 1
    cell = F.shiftrightunsigned("hash", 64 - bits).cast("int")
    marks = windows.groupBy(cell.alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("hash").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    table = ["0"] * cells
    for m in marks:
        table[m["cell"]] = str(m["bits"])
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def _window(length: int):
    """From a start in a row, the window there."""
    return lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.get(f"_w{length}", i).alias("hash"), F.slice("words", i + 1, F.lit(length)).alias("gram"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (sorted array of start, length) and items of every row of docs."""
    windows = benchmark_windows(benchmark, window)
    found = windows.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items")).collect()  # a row a length
    lengths, listed = {r["length"]: r["n"] for r in found}, sum(r["items"] for r in found)
    total = sum(lengths.values())
    cells = FEWEST_CELLS
    while cells < MOST_CELLS and cells * 64 < 256 * total:
        cells *= 2
    bits = cells.bit_length() - 1
    bitmap = _bitmap(windows, cells)

    rows = docs.select("doc_id", F.xxhash64("text").alias("_a"), F.crc32(F.col("text").cast("binary")).alias("_b"), words(F.col("text")).alias("words"))
    rows = _hashed(rows, max(lengths, default=1))
    arrays = [F.array().cast("array<struct<start:int,length:int,hash:bigint,gram:array<string>>>")]
    for k in sorted(lengths):
        rows = rows.withColumn(f"_w{k}", _window_hash(k))
        here = F.array_compact(F.transform(f"_w{k}", lambda h, i: F.when(F.call_function("bit_get", F.get(bitmap, F.shiftrightunsigned(h, 64 - bits).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1, i)))
        arrays.append(F.transform(here, _window(k)))
    passing = rows.select("doc_id", "_a", "_b", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(F.concat(*arrays)).alias("_n", "w"))
    # A row without a passing window still stands for its document; its key is its own so that no join key is hot.
    passing = passing.withColumn("_hash", F.coalesce("w.hash", F.xxhash64("doc_id", "_a"))).withColumn("_gram", F.coalesce("w.gram", F.array().cast("array<string>")))
    side = windows.select(F.col("hash").alias("_hash"), F.col("gram").alias("_gram"), "items")
    side = F.broadcast(side) if max(total, listed) <= BROADCAST_WINDOWS else side
    joined = passing.join(side, ["_hash", "_gram"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("w.start", "w.length"))
    grouped = joined.groupBy("doc_id", "_a", "_b").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum((F.coalesce("_n", F.lit(0)) == 0).cast("int")).alias("_rows"),
    )
    return grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_copy", "_rows")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated of every row of docs; _a and _b tell its text."""
    hits = occurrences(docs, benchmark, window)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(done: Column, h: Column) -> Column:
        end = h["start"] + h["length"]
        return F.struct(F.greatest(done["end"], end).alias("end"), (done["n"] + F.greatest(F.lit(0), end - F.greatest(done["end"], h["start"]))).cast("long").alias("n"))

    counted = hits.withColumn("n_hit", F.aggregate("hits", start, cover)["n"])
    return counted.select("doc_id", "_a", "_b", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "hits", ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, window).filter("contaminated").select("doc_id", "_a", "_b").distinct().alias("bad")
    same = F.col("d.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64("d.text") == F.col("bad._a")) & F.crc32(F.col("d.text").cast("binary")).eqNullSafe(F.col("bad._b"))
    return docs.alias("d").join(bad, same, "left_anti")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, win, len(win) AS l FROM (SELECT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WINDOW} THEN [w] ELSE list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: w[i:i + {WINDOW - 1}]) END) AS win FROM b)),
dw AS (SELECT rid, p, l, w[p:p + l - 1] AS win FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT rid, p, dw.l, item FROM dw JOIN bw USING (win)),
c AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.s, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND {SHARE} * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
