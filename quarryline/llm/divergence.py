"""Source divergence audit: how a source's smoothed term shares differ from those of its language's other sources.

Terms are runs of A-Z (lower-cased), a-z and characters beyond ASCII. Each language keeps the V terms that at least
``LEAST_DOCUMENTS`` of its documents have. A group is a (language, source) that occurs, with or without terms. A group of N
occurrences of kept terms gives a term with count c the share p = 1 + floor(SCALE * (c + 5) / (N + 5 V)); so does the
language over all its documents. Two rows of results: ``pair``, for each other source of the language the sum over all
kept terms of the difference of the shares; ``term``, the ``TOP`` terms that a group has and gives a larger share than the
language does, by the excess.

1. Tasks count terms of whole texts, by group, and the documents of each term; what a task holds at once is bounded by
   ``HELD`` terms, so a hot source is counted by many tasks and arrives as a few sums. Partial counts are shuffled once, by
   language and term; there they are summed by source, the rare terms fall out, and what is kept is written.
2. Kept terms are dealt by hash to blocks of about ``BLOCK_TERMS``, groups in order of their source to blocks of
   ``BLOCK_GROUPS``. A tile is a term block with two group blocks: two dense int64 matrices of bounded size, whatever the
   number of terms and sources. A tile also gets one row for each of its groups, so that groups without its terms count.
3. A tile takes the differences of all its pairs by broadcasting, sums them to a partial pair matrix, and keeps for each
   group its best ``TOP`` terms. Partial matrices are summed by pair; the tiles' heaps are merged by group, at most
   ``TOP`` rows of a tile, cut again before they are shuffled.

Arithmetic is exact: shares are divided in three steps of a thousand, which holds counts to 9e15.

Null text, language and source are read as ''. Ids play no part; repeated rows count each time. A language without kept
terms has pairs of value 0 and no term rows, one with a single source no pairs. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, sized, slices, utf8

LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP = 50
#: Terms of a tile, about; sources in one block of groups.
BLOCK_TERMS = 512
BLOCK_GROUPS = 128
#: Different terms that a task holds before it hands them on.
HELD = 100_000

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or b"").translate(_LETTERS).split()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), overall and documents (of the language) of kept terms; of each group also one row with a null term."""
    names = ["lang", "source", "term", "n", "documents"]

    def emitted(held: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (of, by), (n, documents) in held.items():
            for begin in range(0, len(n), 50_000):
                some = list(n)[begin : begin + 50_000]
                columns = [[of] * len(some), [by] * len(some), some]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()).cast(pa.string()) for c in columns), pa.array([n[t] for t in some], pa.int64()), pa.array([documents[t] for t in some], pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array([of]).cast(pa.string()), pa.array([by]).cast(pa.string()), pa.nulls(1, pa.string()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0
        for batch in slices(batches, 64):
            for t, of, by in zip(utf8(batch.column(0)), utf8(batch.column(1)), utf8(batch.column(2)), strict=True):
                n, documents = held.setdefault((of or b"", by or b""), (Counter(), Counter()))
                before, found = len(n), terms(t)
                n.update(found)
                documents.update(set(found))
                size += len(n) - before
            if size > HELD:
                yield from emitted(held)
                held, size = {}, 0
        yield from emitted(held)

    # A single shuffle, by language and term, serves the sums of a group's term, those of the term, and the filter.
    spark = docs.sparkSession
    partial = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")).mapInArrow(work, "lang string, source string, term string, n long, documents long")
    summed = partial.repartition(partitions(spark), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    summed = summed.withColumns({"overall": F.sum("n").over(of_term), "documents": F.sum("documents").over(of_term)})
    return summed.filter((F.col("documents") >= LEAST_DOCUMENTS) | F.col("term").isNull())


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)) in 64 bits."""
    rest, below = n + PRIOR, total + PRIOR * kept
    whole = np.zeros(np.broadcast(rest, below).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // below
        rest = rest % below
    return 1 + whole


def tile(key: tuple[pa.Scalar, ...], rows: pa.Table, block_groups: int, top: int) -> pa.Table:
    """Of a tile's rows the partial pair matrix as rows (g, h, null, value) and each group's best terms (g, null, term, value).

    A row with a term has its count in a group and in all; one without names a group, its total and the block's number of terms.
    Terms of the block that none of the tile's groups has differ by the shares of a count of 0.
    """
    lang, _, left, right = (k.as_py() for k in key)
    g, n = rows.column("g").to_numpy(), rows.column("n").to_numpy()
    term, overall = rows.column("term").combine_chunks(), rows.column("overall").to_numpy()
    named = term.is_null().to_numpy(zero_copy_only=False)
    kept, language = rows.column("kept")[0].as_py(), rows.column("language")[0].as_py()
    of_block = overall[named].max(initial=0)
    columns = term.filter(pa.array(~named)).dictionary_encode()
    at, words = columns.indices.to_numpy(), columns.dictionary
    values = {k: [] for k in ("g", "h", "term", "value")}

    groups, totals = g[named], n[named]
    order = np.argsort(groups)
    groups, totals = groups[order], totals[order]
    matrix = np.zeros((len(groups), len(words)), np.int64)
    matrix[np.searchsorted(groups, g[~named]), at] = n[~named]
    p = shares(matrix, totals[:, None], kept) if len(words) else matrix
    absent, none = of_block - len(words), shares(np.zeros(len(groups), np.int64), totals, kept) if kept else np.zeros(len(groups), np.int64)
    blocks = groups // block_groups
    one, two = np.nonzero(blocks == left)[0], np.nonzero(blocks == right)[0]
    for i in one.tolist():
        other = two[groups[two] > groups[i]]
        values["g"].append(np.full(len(other), groups[i]))
        values["h"].append(groups[other])
        values["value"].append(np.abs(p[i][None, :] - p[other]).sum(axis=1) + absent * np.abs(none[i] - none[other]))
        values["term"].append(np.full(len(other), None, object))
    if left == right and len(words):
        in_all = np.zeros(len(words), np.int64)
        in_all[at] = overall[~named]
        excess = p - shares(in_all, np.int64(language), kept)[None, :]
        excess[matrix == 0] = 0
        spelled = np.array(words.to_pylist(), object)
        place = np.empty(len(words), np.int64)
        place[np.argsort(np.array(words.cast(pa.binary()).to_pylist(), object))] = np.arange(len(words))
        for i in one.tolist():
            best = np.lexsort((place, -excess[i]))[:top]
            best = best[excess[i][best] > 0]
            values["g"].append(np.full(len(best), groups[i]))
            values["h"].append(np.full(len(best), -1))
            values["value"].append(excess[i][best])
            values["term"].append(spelled[best])
    g, h, value, word = (np.concatenate(values[k]) if values[k] else np.array([], np.int64) for k in ("g", "h", "value", "term"))
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g, pa.int64()), "h": pa.array(h, pa.int64()), "term": pa.array(word.tolist(), pa.string()), "value": pa.array(value, pa.int64())})


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= most) if most else ranked
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _block(group: Column) -> Column:
    return F.floor(group / BLOCK_GROUPS)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of every group."""
    counted = checkpointed(counts(docs, text, lang, source))
    occurring = counted.filter("term is not null").drop("documents")

    # One row a group: its number within the language, its total, and the language's terms and total.
    terms_of = occurring.groupBy("lang", "term").agg(F.first("overall").alias("overall"))
    languages = terms_of.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("overall").alias("language"))
    totals = occurring.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "kept", "language"])
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = checkpointed(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK_TERMS))).withColumn("sides", _block(F.max("g").over(Window.partitionBy("lang")))))

    # A row goes to the tiles of its block of terms with every other block of groups; a group's own row to all blocks of terms.
    numbers = groups.select("lang", "source", "g", "kept", "language", "blocks", "sides")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    cells = occurring.join(sized(numbers), ["lang", "source"]).withColumn("block", block)
    dealt = terms_of.join(sized(groups.select("lang", "blocks").distinct()), "lang").groupBy("lang", block).agg(F.count("*").alias("overall"))
    names = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "g", "kept", "language", "blocks", "sides", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    names = names.join(dealt, ["lang", "block"], "left").fillna(0, ["overall"])
    both = cells.unionByName(names).withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), "sides")))
    tiles = both.withColumn("left", F.least("side", _block(F.col("g")))).withColumn("right", F.greatest("side", _block(F.col("g"))))
    sizes = BLOCK_GROUPS, TOP
    sums = tiles.select("lang", "block", "left", "right", "g", "term", "n", "overall", "kept", "language").groupBy("lang", "block", "left", "right").applyInArrow(lambda key, rows: tile(key, rows, *sizes), "lang string, g long, h long, term string, value long")
    sums = checkpointed(sums)

    half = sums.filter("h >= 0").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pairs = half.union(half.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    place = sized(groups.select("lang", "g", "source"))
    pairs = pairs.join(place, ["lang", "g"]).join(sized(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))), ["lang", "h"]).select("lang", "source", "item", "value")
    best = sums.filter("h < 0").join(place, ["lang", "g"]).select("lang", "source", F.col("term").alias("item"), "value")
    return _ranked(pairs, "pair").union(_ranked(best, "term", TOP))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR}) // (s.n + {PRIOR} * l.v) AS p, 1 + {SCALE}::HUGEINT * (k.n + {PRIOR}) // (l.n + {PRIOR} * l.v) AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= {TOP}
"""
