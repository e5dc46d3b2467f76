"""Terminology: token counts, top terms, synonym clusters, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import token_similarity
from ..functions.text import normalised, strip, tokens
from ..session import checkpointed
from .components import connected_components


def token_counts(units: DataFrame) -> DataFrame:
    """token, n and where it is first seen, over units(doc_id, sequence_no, content)."""
    each = units.select("doc_id", "sequence_no", F.posexplode(tokens(F.col("content"))).alias("pos", "token"))
    return each.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sequence_no", "pos")).alias("first"))


def hit_texts(hits: DataFrame) -> DataFrame:
    """doc_id, sequence_no, content of the included hits of a search, each with the blocks before and after it.

    Hits that are neighbours share text, which counts for each.
    """
    text = F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("previous", "content", "next")))
    return hits.filter("is_included").select("doc_id", "sequence_no", text.alias("content"))


def discover(units: DataFrame, most: int = 500, least: int = 2) -> DataFrame:
    """The most frequent tokens (of equal ones the first seen), then those of at least so many occurrences; confidence."""
    top = token_counts(units).orderBy(F.desc("n"), "first").limit(most)
    return top.filter(F.col("n") >= least).select("token", "n", F.least(F.lit(0.99), F.lit(0.5) + F.col("n") / 20).alias("confidence"))


def occurrences(units: DataFrame, most: int = 20) -> DataFrame:
    """The first so many occurrences of each token in corpus order.

    Each document keeps its first so many before the shuffle by token, so a token of every text stays small.
    """
    each = units.select("doc_id", "sequence_no", F.posexplode(tokens(F.col("content"))).alias("pos", "token"))
    own = Window.partitionBy("doc_id", "token").orderBy("sequence_no", "pos")
    few = each.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= most).drop("_n")
    every = Window.partitionBy("token").orderBy("doc_id", "sequence_no", "pos")
    return few.withColumn("occurrence", F.row_number().over(every)).filter(F.col("occurrence") <= most)


def shared_spellings(terms: DataFrame) -> DataFrame:
    """(u, v) of terms(name, aliases) that share a spelling: an equi-join on spellings, each linked to the least name of it."""
    spelled = terms.select("name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))).alias("s"))
    least = spelled.groupBy("s").agg(F.min("name").alias("v"))
    return spelled.join(least, "s").filter("name != v").select(F.col("name").alias("u"), "v").distinct()


#: The least similarity of synonyms, how many terms are compared and how many clusters shown.
SIMILARITY, MOST_TERMS, MOST_CLUSTERS = 85.0, 2000, 50


#: Rows of a key that one task joins on one side at most, about.
KEY_ROWS = 2048


def _salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join of left and right on a key; a key with many rows on the right is split, its left rows going to every part."""
    counts = right.groupBy(key).agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("_parts"))
    dealt = right.join(counts, key).withColumn("_part", F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int")).drop("_parts")
    every = left.join(counts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return every.join(dealt, [key, "_part"])


def candidate_pairs(names: DataFrame, least: float) -> DataFrame:
    """(u, v), u < v, of distinct names among which are all whose token_set_ratio is at least ``least``.

    Of two names let s be the common tokens, x and y all tokens of either, each joined by blanks, in letters n and m. The ratio
    is the greatest of three (or 100 where a name has no other tokens, which the first condition covers):

    * s against x or y. s begins x, so the ratio reaches ``least`` if and only if s has at least r = least / (200 - least) of
      the letters of x. A name's tokens are ordered by rarity; the last ones, together shorter than that, cannot do alone. So one
      of the first ones is shared: these are looked up among all tokens, and the letters of s are then counted.
    * x against y, common tokens first. It reaches ``least`` if their common subsequence has L >= least (n + m) / 200 letters.
      With a blank at either end, the pairs of neighbouring letters of a text are those of its tokens between blanks, in
      whatever order, n + 1 of them. Each of the n - L letters left out breaks two of x, each of the m - L between breaks
      one, so at least O = 3 L + 1 - n - m of them are common (for a low ``least`` letters are taken instead: O = L). Of k
      features ordered by rarity, rarest first, two texts with O in common share j among the first k - O + j of each, for any
      j up to O; and after the j-th that they share there are at least O - j on both sides. A key is a combination of j = 3 such
      features for short names, of two or one for long ones, that would have too many.

    Features and tokens of many names are split over tasks. Nothing is compared that shares no rare part.
    """
    c, r = least / 200.0, least / (200.0 - least)
    norm = names.select(F.col("name").alias("v"), F.filter(F.array_sort(F.array_distinct(F.split(normalised(F.col("name")), " "))), lambda t: t != "").alias("tokens")).filter(F.size("tokens") > 0)
    norm = checkpointed(norm.withColumn("n", F.char_length(F.array_join("tokens", " "))))

    def ordered(part: DataFrame, key: str) -> DataFrame:
        """part(v, key, ...) with each one's place at among its name's, the rarest first."""
        rarity = part.groupBy(key).agg(F.count("*").alias("_df"))
        return part.join(rarity, key).withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("_df", key))).drop("_df")

    def letters(tokens: Column) -> Column:
        return F.char_length(F.array_join(tokens, " "))

    tokens = norm.select("v", "n", "tokens", F.explode("tokens").alias("token"))
    rest = Window.partitionBy("v").orderBy(F.desc("at"))
    needed = ordered(tokens, "token").withColumn("_rest", F.sum(F.char_length("token") + 1).over(rest) - 1).filter(F.col("_rest") >= r * F.col("n") - 1e-9)
    needed = needed.select("token", F.col("v").alias("u"), F.col("tokens").alias("_own"), F.col("n").alias("_n"))
    sharing = _salted(needed, tokens.select("token", "v", "tokens"), "token").filter((F.col("u") != F.col("v")) & (letters(F.array_intersect("_own", "tokens")) >= r * F.col("_n") - 1e-9)).select("u", "v")

    if 3 * c > 1:
        grams = F.flatten(F.transform("tokens", lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) + 1), lambda i: F.substring(F.concat(F.lit(" "), t, F.lit(" ")), i, F.lit(2)))))
        size, common = F.col("n") + 1, lambda total: 3 * F.ceil(c * total - 1e-9) + 1 - total
        fewest = F.ceil((3 * c - 1) * (F.col("n") + F.ceil(r * F.col("n") - 1e-9)) + 1 - 1e-9)
    else:
        grams = F.split(F.array_join("tokens", " "), "")
        size, common = F.col("n"), lambda total: F.ceil(c * total - 1e-9)
        fewest = F.ceil(c * (F.col("n") + F.ceil(r * F.col("n") - 1e-9)) - 1e-9)
    counted = F.transform("_grams", lambda g, i: F.concat(g, F.size(F.filter(F.slice("_grams", F.lit(1), i), lambda x: x == g)).cast("string")))  # the second of a kind is another feature
    features = norm.withColumn("_grams", grams).select("v", "n", size.alias("size"), fewest.alias("_fewest"), F.explode(counted).alias("feature"))
    rare = F.transform(F.array_sort(F.collect_list(F.struct("at", "feature"))), lambda x: x["feature"])
    first = checkpointed(ordered(features, "feature").filter(F.col("at") <= F.col("size") - F.col("_fewest") + 3).groupBy("v", "n", "size", "_fewest").agg(rare.alias("rare")))

    def level(total: Column) -> Column:
        """How many shared features a key names, by the letters of a pair: as many as leave a name hundreds of keys."""
        return F.when((total <= 48) & (common(total) >= 3), 3).when((total <= 120) & (common(total) >= 2), 2).otherwise(1)

    def keyed(k: int) -> DataFrame:
        """v, n, size, key, at of every combination of k of a name's first features; at is the place of the last one."""
        most = {1: (F.col("n") * (1 + 1 / r) > 120) | (F.col("_fewest") < 3), 2: (F.col("n") * (1 + r) <= 120), 3: F.col("n") * (1 + r) <= 48}[k]
        few = F.slice("rare", F.lit(1), F.greatest(F.lit(0), F.col("size") - F.greatest("_fewest", F.lit(k)) + k).cast("int"))
        keys = F.transform("rare", lambda x, i: F.struct((i + 1).alias("at"), F.xxhash64(x).alias("key")))
        for _ in range(k - 1):
            more = lambda e: F.transform(F.filter(F.transform("rare", lambda x, i: F.struct((i + 1).alias("at"), x.alias("x"))), lambda o: o["at"] > e["at"]), lambda o: F.struct(o["at"].alias("at"), F.xxhash64(e["key"], o["x"]).alias("key")))
            keys = F.flatten(F.transform(keys, more))
        return first.filter(most).withColumn("rare", few).select("v", "n", "size", F.explode(keys).alias("k")).select("v", "n", "size", "k.key", "k.at")

    total = F.col("n") + F.col("_n")
    for k in (1, 2, 3):
        one = keyed(k)
        other = one.select("key", F.col("v").alias("u"), F.col("n").alias("_n"), F.col("size").alias("_size"), F.col("at").alias("_at"))
        enough = k + F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) >= common(total)
        alike = _salted(other, one, "key").filter((F.col("u") < F.col("v")) & (F.least("n", "_n") >= r * F.greatest("n", "_n") - 1e-9) & (level(total) == k) & enough)
        sharing = sharing.union(alike.select("u", "v"))
    return sharing.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_names(terms: DataFrame, least: float = SIMILARITY, most: int | None = MOST_TERMS) -> DataFrame:
    """(u, v, similarity) of each two names, or of the first so many in order of the name, whose token sets are alike.

    The number of terms is a limit of the feature; without it all names are joined. No pair is lost to a key.
    """
    names = terms.select("name").filter("name is not null").distinct()
    names = names.orderBy("name").limit(most) if most else names
    norm = [normalised(F.col(c)) for c in ("u", "v")]
    return candidate_pairs(names, least).withColumn("similarity", token_similarity(*norm)).filter(F.col("similarity") >= least)


def clusters(terms: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """cluster (least name), standard, members, size, similarity: standard is the name of most occurrences, then shortest, then first.

    similarity is the greatest of the cluster's edges (100 for edges without one). With most, only the largest clusters stay,
    of equal ones the most alike.
    """
    strength = F.col("similarity") if "similarity" in edges.columns else F.lit(100.0)
    known = edges.select("u", "v", strength.alias("similarity"))
    groups = connected_components(known.select("u", "v"))
    member = terms.join(groups, F.col("name") == F.col("node"))
    rank = F.struct(F.negative("occurrences"), F.char_length("name"), "name")
    found = member.groupBy(F.col("component").alias("cluster")).agg(F.min_by("name", rank).alias("standard"), F.array_sort(F.collect_set("name")).alias("members"), F.count("*").alias("size"))
    best = known.join(groups, F.col("u") == F.col("node")).groupBy(F.col("component").alias("cluster")).agg(F.round(F.max("similarity"), 1).alias("similarity"))
    both = found.join(best, "cluster")
    return both if most is None else both.orderBy(F.desc("size"), F.desc("similarity"), "cluster").limit(most)


def suggested_synonyms(terms: DataFrame, least: float = SIMILARITY, most_terms: int | None = MOST_TERMS, most_clusters: int | None = MOST_CLUSTERS) -> DataFrame:
    """clusters of the first so many terms(name, aliases, occurrences), or of all: linked where they share a spelling or are alike."""
    few = terms.orderBy("name").limit(most_terms) if most_terms else terms
    shared = shared_spellings(few).withColumn("similarity", F.lit(100.0))
    return clusters(few, shared.unionByName(similar_names(few, least, most_terms)), most_clusters)


def split(terms: DataFrame, children: DataFrame) -> DataFrame:
    """terms(term_id, name, status, is_selected) with the confirmed children(term_id, parent_id, name) of terms that are split in two or more."""
    counts = children.groupBy("parent_id").agg(F.count("*").alias("_n")).filter("_n >= 2").select(F.col("parent_id").alias("_id"))
    parents = terms.join(counts, F.col("term_id") == F.col("_id"), "left").withColumns({"status": F.when(F.col("_id").isNotNull(), "split").otherwise(F.col("status")), "is_selected": F.col("_id").isNull() & F.col("is_selected")}).drop("_id")
    new = children.join(counts, F.col("parent_id") == F.col("_id"), "left_semi").select("term_id", "name", F.lit("confirmed").alias("status"), F.lit(True).alias("is_selected"))
    return parents.select(new.columns).unionByName(new)


def replaced_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases(term_id, alias) with those of the terms of new(term_id, aliases) replaced: stripped, the first of each spelling kept."""
    each = new.select("term_id", F.posexplode("aliases").alias("_at", "_a")).select("term_id", "_at", strip(F.col("_a")).alias("alias")).filter("alias != ''")
    first = Window.partitionBy("term_id", F.lower("alias")).orderBy("_at")
    kept = each.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("term_id", "alias")
    return aliases.join(new.select("term_id"), "term_id", "left_anti").select("term_id", "alias").unionByName(kept)


def deleted(terms: DataFrame, gone: DataFrame) -> DataFrame:
    """terms with those of gone(term_id) marked as deleted and no longer selected; no row goes."""
    asked = gone.select("term_id").distinct().withColumn("_gone", F.lit(True))
    lost = F.coalesce("_gone", F.lit(False))
    return terms.join(asked, "term_id", "left").withColumns({"status": F.when(lost, "deleted").otherwise(F.col("status")), "is_selected": ~lost & F.col("is_selected")}).drop("_gone")


#: Categories that every project is given.
CATEGORIES = (("process_parameters", "工艺参数"), ("chemical_indicators", "化学指标"), ("sensory_evaluation", "感官评价"))


def with_template(categories: DataFrame, projects: DataFrame) -> DataFrame:
    """categories(project_id, code, name, position) and, for each of projects(project_id), what the template has and it lacks."""
    template = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(n).alias("name"), F.lit(i).alias("position")) for i, (c, n) in enumerate(CATEGORIES))))
    wanted = projects.select("project_id", template.alias("t")).select("project_id", "t.*")
    return categories.unionByName(wanted.join(categories, ["project_id", "code"], "left_anti").select(categories.columns))


def repointed(rows: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """rows whose term_id column names the target of merges(term_id, target_id) where it named a source."""
    to = merges.select(F.col("term_id").alias("_from"), F.col("target_id").alias("_to"))
    return rows.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def merged_status(terms: DataFrame, merges: DataFrame) -> DataFrame:
    """terms(term_id, status, is_selected) with the sources of merges marked."""
    source = merges.select("term_id").distinct().withColumn("_m", F.lit(True))
    gone = F.coalesce("_m", F.lit(False))
    return terms.join(source, "term_id", "left").withColumns({"status": F.when(gone, "merged").otherwise(F.col("status")), "is_selected": ~gone & F.col("is_selected")}).drop("_m")


def merged(target: DataFrame, sources: DataFrame) -> DataFrame:
    """term_id, alias: aliases of target(term_id, aliases) and the names and aliases of its sources, first spelling kept."""
    own = target.select("term_id", F.lit(0).alias("_from"), F.posexplode("aliases").alias("_at", "alias"))
    others = sources.select(F.col("target_id").alias("term_id"), F.col("term_id").alias("_from"), F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_at", "alias"))
    first = Window.partitionBy("term_id", F.lower("alias")).orderBy("_from", "_at")
    return own.unionByName(others).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("term_id", "alias")
