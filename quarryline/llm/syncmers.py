"""Document fingerprints from closed syncmers, with DataFrame functions only.

Tokens are runs of digits, letters and other characters below U+3000 (of 24 characters at most, A-Z lower-cased), and every
other character but spaces and controls alone, so that scripts without spaces have tokens too. A k-mer is ``K`` tokens, its
inner substrings are the runs of ``S`` tokens in it. It is an anchor, a closed syncmer, if the least hash of an inner
substring stands at its first or last one: that depends on the k-mer alone, not on what is around it, so a passage has
the same anchors wherever it stands, and of ``K - S`` k-mers in a row at least one is an anchor. A text of fewer than ``K``
tokens has one anchor, all its tokens.

A fingerprint is the number of tokens and the ``KEPT`` anchors of least hash, each packed as 36 bits of hash and 26 bits of
its first place (greater places count as the greatest). As text it is the number and the packed anchors in hexadecimal.

``likeness`` takes the anchors of least hash in the union of two fingerprints, at most ``KEPT``, and the share of them that
match: that both have, at places whose difference is the median difference of the shared ones give or take ``SLACK`` tokens
and one part in ``BAND`` of the longer text. Of texts with up to ``KEPT`` anchors that is an exact count, of longer ones an
unbiased estimate with a deviation of at most 1 / (2 sqrt(KEPT)). Equal texts have likeness 1, texts without tokens too.

``edited_likeness`` compares each document with the next one, by descending id and then by the text's hash (null ids last,
the first follows the last), and with itself after the next one's beginning has replaced its last third. Ids and lengths
alone are sorted, by range; the places between ranges are joined by a row for each range. Texts are shuffled once, by id,
for both joins, and beginnings once more. No join key is hot: a row of ids has one follower.

A null text counts as empty. Rows are joined by 64 bits of hash of the id and 64 of the text. Rows that repeat id and text
count once in the order and each get the result; rows of one id with different texts follow each other. A single document is its own next. No rows give none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions

TOKEN = r"[0-9A-Za-z\x{80}-\x{2FFF}]{1,24}|[^\x00-\x20]"
K, S = 5, 2
KEPT = 64
SLACK, BAND = 8, 8
#: With 36 bits of hash and one for the side of a comparison they fit 63 bits.
PLACE_BITS = 26


def _packed(digest: Column, place: Column) -> Column:
    """36 bits of a hash above 26 of a place: never negative."""
    return F.shiftleft(F.shiftrightunsigned(digest, 64 - 36), PLACE_BITS).bitwiseOR(F.least(place.cast("long"), F.lit((1 << PLACE_BITS) - 1)))


def _hash_of(packed: Column, bits: int = PLACE_BITS) -> Column:
    return F.shiftright(packed, bits)


def _neighbours(a: str, b: str, gap: int) -> Column:
    """Hashes of each element of a with the element of b that stands gap places later, as far as both reach."""
    n = F.greatest(F.least(F.size(a), F.size(b) - gap), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + gap), n), lambda x, y: F.xxhash64(x, y))


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column: a struct of n, the number of tokens, and anchors, sorted packed longs."""
    keep = df.columns
    df = df.withColumn("_tokens", F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))
    df = df.withColumn("_h1", F.transform("_tokens", lambda t: F.xxhash64(t)))
    df = df.withColumn("_h2", _neighbours("_h1", "_h1", 1)).withColumn("_h4", _neighbours("_h2", "_h2", 2)).withColumn("_h5", _neighbours("_h4", "_h1", 4))
    inner = [lambda i, j=j: F.get("_h2", i + j) for j in range(K - S + 1)]

    def anchor(digest: Column, i: Column) -> Column:
        edge, middle = F.least(inner[0](i), inner[-1](i)), F.least(*(f(i) for f in inner[1:-1]))
        return F.when(edge <= middle, _packed(digest, i))

    short = F.when(F.size("_h1") > 0, F.array(_packed(F.xxhash64(F.array_join("_tokens", " ")), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_sorted", F.when(F.size("_h5") > 0, F.sort_array(F.array_compact(F.transform("_h5", anchor)))).otherwise(short))
    first = F.filter("_sorted", lambda x, i: (i == 0) | (_hash_of(x) != _hash_of(F.get("_sorted", i - 1))))
    return df.select(*[f"`{c}`" for c in keep], F.struct(F.size("_h1").alias("n"), F.slice(first, F.lit(1), F.lit(KEPT)).alias("anchors")).alias(out))


def as_text(fingerprint: str) -> Column:
    digits = F.transform(F.col(f"{fingerprint}.anchors"), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat_ws(":", F.hex(f"{fingerprint}.n"), F.array_join(digits, "")))


def with_likeness(df: DataFrame, one: str, other: str, out: str) -> DataFrame:
    """df with the likeness, 0 to 1, of two of its fingerprint columns in one more column."""
    keep = df.columns
    sides = F.concat(F.transform(f"{one}.anchors", lambda x: F.shiftleft(x, 1)), F.transform(f"{other}.anchors", lambda x: F.shiftleft(x, 1) + 1))
    df = df.withColumn("_both", F.sort_array(sides))
    # Of one hash there are at most two, one of each side, next to each other.
    new = lambda x, i: (i == 0) | (_hash_of(x, PLACE_BITS + 1) != _hash_of(F.get("_both", i - 1), PLACE_BITS + 1))
    df = df.withColumn("_least", F.slice(F.filter("_both", new), F.lit(1), F.lit(KEPT)))
    last = _hash_of(F.try_element_at("_least", F.lit(-1)), PLACE_BITS + 1)

    def place(x: Column) -> Column:
        return F.shiftright(x, 1).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def offset(x: Column, i: Column) -> Column:
        before = F.get("_both", i - 1)
        forward = F.when(x.bitwiseAND(F.lit(1)) == 1, place(x) - place(before)).otherwise(place(before) - place(x))
        return F.when(~new(x, i) & (_hash_of(x, PLACE_BITS + 1) <= last), forward)

    df = df.withColumn("_offsets", F.sort_array(F.array_compact(F.transform("_both", offset))))
    median = F.try_element_at("_offsets", F.floor(F.size("_offsets") / 2).cast("int") + 1)
    reach = SLACK + F.floor(F.greatest(f"{one}.n", f"{other}.n") / BAND)
    matching = F.size(F.filter("_offsets", lambda o: F.abs(o - median) <= reach))
    share = F.when(F.size("_least") > 0, matching / F.size("_least")).otherwise(F.lit(1.0))
    return df.select(*[f"`{c}`" for c in keep], share.cast("double").alias(out))


def followers(ids: DataFrame) -> DataFrame:
    """ids(doc_id, _i, _a, ...), distinct, with next_i and next_a: the row after each by descending id, then hash."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("_a")]
    ranged = checkpointed(ids.repartitionByRange(partitions(ids.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(*order)
    here = F.struct(F.col("_i").alias("i"), F.col("_a").alias("a"))
    placed = ranged.withColumn("_next", F.lead(here).over(within)).withColumn("_at", F.row_number().over(within))
    # One row for each range: the first of the next range, of the first range after the last.
    ends = placed.filter("_at = 1").select("_range", here.alias("_first"))
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_range", F.coalesce(F.lead("_first").over(Window.orderBy("_range")), F.first("_first").over(whole)).alias("_first"))
    following = F.coalesce("_next", "_first")
    return placed.join(F.broadcast(ends), "_range").select(*ids.columns, following["i"].alias("next_i"), following["a"].alias("next_a"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumns({"_i": F.xxhash64("doc_id"), "_a": F.xxhash64("text")})
    order = followers(texts.select("doc_id", "_i", "_a", F.length("text").alias("_n")).distinct())
    # Texts are never broadcast, however small their files; both joins read one shuffle of the same columns. Fingerprints come
    # after it, as they would make it larger, and plans with lambda functions are not found equal.
    known = texts.select("text", "_i", "_a").repartition(partitions(docs.sparkSession), "_i", "_a")
    begun = order.join(known.withColumnsRenamed({"text": "_text", "_i": "next_i", "_a": "next_a"}).hint("merge"), ["next_i", "next_a"])
    begun = fingerprinted(begun.select("doc_id", "_i", "_a", "_n", "_text"), "_text", "next")
    begun = begun.select("doc_id", "_i", "_a", F.substring("_text", F.lit(1), F.floor(F.col("_n") / 3).cast("int")).alias("_begin"), "next").dropDuplicates(["_i", "_a"])

    both = known.join(begun.hint("merge"), ["_i", "_a"])
    n = F.length("text")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "text", "next", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("_begin")).alias("_edited"))
    both = fingerprinted(both, "text", "own").drop("text")
    both = fingerprinted(both, "_edited", "edited")
    both = with_likeness(with_likeness(both, "own", "edited", "near_edited"), "own", "next", "near_next")
    return both.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("edited").alias("edited_fingerprint"), "near_edited", "near_next")
