"""Evidence search over text blocks.

A query is a short list of terms with aliases, so it is part of the expression: every unit of text is scored in its own
row, without a join with the terms. Scopes wider than a block first gather a unit's text, in order.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import partial_similarity, reaching_similarity
from ..functions.text import strip
from ..session import checkpointed, spread
from . import ordering

MOST_TERMS = 30
#: Rows of three numbers that are broadcast at most.
MOST_GRAMS = 500_000


@dataclass(frozen=True)
class Term:
    text: str
    aliases: tuple[str, ...] = ()

    @property
    def variants(self) -> list[str]:
        return [v for x in (self.text, *self.aliases) if (v := x.strip().lower())]


def blocks(docs: DataFrame, pattern: str = r"\n", page_blocks: int = 5) -> DataFrame:
    """doc_id, page_no, sequence_no, content of each non-blank part of a text; numbers count the blank ones too."""
    # Stripped before they are exploded, so that content is a column: conditions on it do not repeat the stripping.
    parts = docs.select("doc_id", F.posexplode(F.transform(F.split("text", pattern), strip)).alias("sequence_no", "content")).filter("content != ''")
    return parts.select("doc_id", F.floor(F.col("sequence_no") / page_blocks).cast("int").alias("page_no"), "sequence_no", "content")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Blocks between blank lines, and after an ideographic full stop."""
    return blocks(docs, r"\n\s*\n|(?<=。)\s*")


def with_neighbours(units: DataFrame, within: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("page_no", "sequence_no")) -> DataFrame:
    """units with the previous and next content inside a document (or page)."""
    w = Window.partitionBy(*within).orderBy(*order)
    return units.withColumns({"previous": F.lag("content").over(w), "next": F.lead("content").over(w)})


def term_score(text: Column, term: Term, mode: str = "exact", fuzzy: float = 82.0, semantic: Column | None = None, semantic_least: float = 0.18, near: Column | None = None) -> Column:
    """struct(term, matched, score): a contained variant scores 100; fuzzy modes take the best window of each variant.

    near is that window's ratio if it is known already.
    """
    lowered = F.lower(text)
    contained = functools.reduce(operator.or_, (lowered.contains(v) for v in term.variants), F.lit(False))
    if near is None:
        near = F.greatest(F.lit(0.0), *(partial_similarity(F.lit(v), lowered) for v in term.variants)) if mode in ("fuzzy", "hybrid") else F.lit(0.0)
    meaning = F.coalesce(semantic, F.lit(0.0)) if semantic is not None else F.lit(0.0)
    if mode == "semantic":
        matched, score = meaning >= semantic_least, meaning * 100
    elif mode == "hybrid":
        matched = contained | (meaning >= semantic_least) | (near >= fuzzy)
        score = F.when(contained, 100.0).when(meaning >= semantic_least, F.greatest(near, meaning * 100)).otherwise(near)
    else:
        matched, score = contained | (near >= fuzzy if mode == "fuzzy" else F.lit(False)), F.when(contained, 100.0).otherwise(near)
    return F.struct(F.lit(term.text).alias("term"), matched.alias("matched"), score.cast("double").alias("score"))


def may_match(text: Column, term: Term, mode: str = "exact", fuzzy: float = 82.0, semantic: Column | None = None, semantic_least: float = 0.18) -> Column:
    """Whether term_score can match, without any similarity: a window shares no more letters with a variant than the text does."""
    lowered, tests = F.lower(text), []
    for v in term.variants:
        held = sum((F.when(lowered.contains(c), v.count(c)).otherwise(0) for c in sorted(set(v))), F.lit(0))
        near = (F.char_length(lowered) < len(v)) | (held * 200.0 >= fuzzy * (held + len(v)))
        tests.append(near if mode in ("fuzzy", "hybrid") else lowered.contains(v))
    if semantic is not None and mode in ("semantic", "hybrid"):
        tests.append(F.coalesce(semantic >= semantic_least, F.lit(False)))
    return functools.reduce(operator.or_, tests, F.lit(False)) if mode != "semantic" else F.lit(True)


def scored(units: DataFrame, terms: list[Term], logic: str = "and", **how) -> DataFrame:
    """The units that match all (and) or any (or) of the terms, with matches and the mean score of all terms."""
    if not 0 < len(terms) <= MOST_TERMS:
        raise ValueError(f"1 to {MOST_TERMS} terms are allowed")
    each = how.pop("semantic", None)  # a column for one term, or the name of an array with a score for each
    semantic = [F.col(each)[i] if isinstance(each, str) else each for i in range(len(terms))]
    may = [F.coalesce(may_match(F.col("content"), t, semantic=m, **how), F.lit(False)) for t, m in zip(terms, semantic, strict=True)]
    units = units.filter(functools.reduce(operator.and_ if logic == "and" else operator.or_, may))
    test = F.forall if logic == "and" else F.exists
    nears, added = [None] * len(terms), []

    def matches() -> Column:
        return F.array(*(term_score(F.col("content"), t, semantic=m, near=n, **how) for t, m, n in zip(terms, semantic, nears, strict=True)))

    if how.get("mode") in ("fuzzy", "hybrid"):
        # Which windows can match is told by their grams, and only those are compared; then what matches too few terms goes.
        text, added = F.lower("content"), [f"_near{i}" for i in range(len(terms))]
        units = spread(units).withColumns({n: reaching_similarity(t.variants, how.get("fuzzy", 82.0))(text) for n, t in zip(added, terms, strict=True)})
        nears = [F.coalesce(n, F.lit(0.0)) for n in added]
        units = units.filter(test(matches(), lambda m: m["matched"]))
        if logic == "or" or how["mode"] == "hybrid":  # a hit's terms may be below the threshold: they score by all windows
            open_ = [F.when(F.col(n).isNull() & ~functools.reduce(operator.or_, (text.contains(v) for v in t.variants), F.lit(False)), text) for n, t in zip(added, terms, strict=True)]
            nears = [F.coalesce(n, F.greatest(F.lit(0.0), *(partial_similarity(F.lit(v), o) for v in t.variants))) for n, o, t in zip(added, open_, terms, strict=True)]
    kept = units.withColumn("matches", matches()).filter(test("matches", lambda m: m["matched"])).drop(*added)
    return kept.withColumn("score", F.aggregate("matches", F.lit(0.0), lambda s, m: s + m["score"]) / len(terms))


SCOPES = {"block": ("doc_id", "page_no", "sequence_no"), "page": ("doc_id", "page_no"), "document": ("doc_id",)}


def gathered(units: DataFrame, scope: str) -> DataFrame:
    """One row per page or document: its blocks' contents in order, a line each; page_no and sequence_no are the first's."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "sequence_no", "content")))
    lines = units.groupBy(*SCOPES[scope]).agg(rows.alias("rows"))
    first = F.col("rows")[0]
    return lines.select("doc_id", first["page_no"].alias("page_no"), first["sequence_no"].alias("sequence_no"), F.array_join(F.transform("rows", lambda r: r["content"]), "\n").alias("content"))


def best_blocks(units: DataFrame, hits: DataFrame, terms: list[Term], scope: str) -> DataFrame:
    """hits of pages or documents with the block of each that is most like a term (of equal ones the first) in place of the unit.

    Only the blocks of units that are hits are compared.
    """
    key = list(SCOPES[scope])
    near = units.join(hits.select(*key).distinct(), key, "left_semi")
    likeness = F.greatest(F.lit(0.0), *(F.when(F.lower("content").contains(t.text.lower()), 100.0).otherwise(partial_similarity(F.lit(t.text.lower()), F.lower("content"))) for t in terms))
    rank = F.struct(F.negative(likeness).alias("r"), "page_no", "sequence_no")
    best = near.groupBy(*key).agg(F.min_by(F.struct("page_no", "sequence_no", "content"), rank).alias("best"))
    rest = [c for c in hits.columns if c not in ("page_no", "sequence_no", "content", *key)]
    return hits.select(*key, *rest).join(best, key).select("doc_id", F.col("best.page_no").alias("page_no"), F.col("best.sequence_no").alias("sequence_no"), F.col("best.content").alias("content"), *rest)


def with_context(hits: DataFrame, units: DataFrame) -> DataFrame:
    """hits with the previous and next block of their document; only documents with hits are sorted."""
    near = with_neighbours(units.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    key = list(SCOPES["block"])
    return hits.join(near.select(*key, "previous", "next"), key, "left")


def numbered(hits: DataFrame, out: str = "result_no") -> DataFrame:
    """hits numbered from 1 in corpus order."""
    return ordering.numbered(hits, ["doc_id", "page_no", "sequence_no"], out, 1)


def search(units: DataFrame, terms: list[Term], logic: str = "and", scope: str = "block", **how) -> DataFrame:
    """Hits numbered in corpus order, with their best block, its page and the blocks before and after it in the document.

    A hit of a page or document is judged by all of its text and stands with its best block.
    """
    if scope == "block":
        hits = checkpointed(scored(units, terms, logic, **how))
    else:
        hits = checkpointed(scored(gathered(units, scope), terms, logic, **how))
        hits = checkpointed(best_blocks(units, hits, terms, scope))
    return numbered(with_context(hits, units))


def reviewed(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """hits with is_included and review_status: included and pending, or as decisions(result_no, is_included, review_status) say.

    What is not included leaves term discovery and restricted extractions.
    """
    said = decisions.select("result_no", F.col("is_included").alias("_in"), F.col("review_status").alias("_status"))
    return hits.join(said, "result_no", "left").withColumns({"is_included": F.coalesce("_in", F.lit(True)), "review_status": F.coalesce("_status", F.lit("pending"))}).drop("_in", "_status")


def matched_terms(matches: Column) -> Column:
    """Names of the matched terms, of all terms if none matched, without repeats, joined."""
    hit = F.filter(matches, lambda m: m["matched"])
    return F.array_join(F.array_distinct(F.transform(F.when(F.size(hit) > 0, hit).otherwise(matches), lambda m: m["term"])), "、")


def _gram_counts(texts: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its different n-grams, as numbers, and their counts."""
    for t in texts:
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        k = max(0, len(codes) - n + 1)
        grams = np.zeros(k, np.int64)
        for i in range(n):
            grams = grams << 21 | codes[i : i + k]
        yield np.unique(grams, return_counts=True)


def gram_tfidf(texts: DataFrame, query: str, n: int = 3) -> DataFrame:
    """id and cosine of each text(id, text) with a query: character n-grams, idf ln((1 + N) / (1 + df)) + 1, unit length.

    The query is one more text of the corpus. Only texts that share a gram are returned. Grams are counted inside their text (up
    to three letters fit a number), so that what is summed by gram is a row for each text and gram, once for each task; the
    frequencies are broadcast if they are few, and a text's sums are complete in its task.
    """
    if n > 3:
        raise ValueError("grams of at most 3 letters")
    spark, kind = texts.sparkSession, dict(texts.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                found = list(_gram_counts(part.column("text").to_pylist(), n))
                at = np.repeat(np.arange(part.num_rows), [len(g) for g, _ in found])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(np.concatenate([g for g, _ in found])), pa.array(np.concatenate([c for _, c in found]))], ["id", "gram", "tf"])

    tf = texts.filter(F.col("text").isNotNull()).select("id", F.lower("text").alias("text")).mapInArrow(work, f"id {kind}, gram long, tf long")
    (grams, counts), total = next(_gram_counts([query.lower()], n)), texts.count() + 1
    own = spark.createDataFrame(list(zip(grams.tolist(), counts.tolist(), strict=True)), "gram long, qf long")  # the grams of one query
    df = checkpointed(tf.groupBy("gram").agg(F.count("*").alias("df")))
    idf = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.coalesce("df", F.lit(0)) + F.when(F.col("qf").isNotNull(), 1).otherwise(0))) + 1
    known = df.join(F.broadcast(own), "gram", "left").select("gram", idf.alias("idf"), (F.coalesce("qf", F.lit(0)) * idf).alias("qw"))
    asked = own.join(df, "gram", "left").select((F.col("qf") * idf).alias("qw"))
    length = (asked.agg(F.sum(F.col("qw") * F.col("qw"))).first()[0] or 0.0) ** 0.5
    known = F.broadcast(known) if df.count() <= MOST_GRAMS else known
    w = F.col("tf") * F.col("idf")
    sums = tf.join(known, "gram").groupBy("id").agg(F.sum(w * F.col("qw")).alias("dot"), F.sqrt(F.sum(w * w)).alias("len"))
    return sums.filter("dot > 0").select("id", (F.col("dot") / (F.col("len") * F.lit(length))).alias("cosine"))
