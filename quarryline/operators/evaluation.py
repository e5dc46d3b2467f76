"""Expected against actual: matches with tolerances, metrics that are null on nothing, issues, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import matcher_similarity
from ..functions.text import normalised, unit_token


def number_ok(expected: Column, actual: Column, absolute: Column, relative: Column) -> Column:
    """Within the larger of the two tolerances; no number, NaN and infinity never match."""
    finite = actual.isNotNull() & ~F.isnan(actual) & (F.abs(actual) != float("inf"))
    return F.coalesce(finite & (F.abs(actual - expected) <= F.greatest(F.coalesce(absolute, F.lit(0.0)), F.abs(expected) * F.coalesce(relative, F.lit(0.0)))), F.lit(False))


def text_ok(expected: Column, actual: Column) -> Column:
    return F.coalesce(normalised(expected) == normalised(actual), F.lit(False))


def unit_ok(expected: Column, actual: Column) -> Column:
    return unit_token(expected).eqNullSafe(unit_token(actual))


def compared(expected: DataFrame, actual: DataFrame, ok: Column) -> DataFrame:
    """id, status (matched, wrong, missing, unexpected) by a full outer join; ok may use e.* and a.*."""
    e, a = expected.withColumn("_e", F.lit(True)).alias("e"), actual.withColumn("_a", F.lit(True)).alias("a")
    both = e.join(a, F.col("e.id") == F.col("a.id"), "full")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(ok, "matched").otherwise("wrong")
    return both.select(F.coalesce("e.id", "a.id").alias("id"), status.alias("status"))


def metric(found: DataFrame, category: str) -> DataFrame:
    """matched, total and score of the expected ids; the score of nothing is null."""
    expected = found.filter("status != 'unexpected'")
    matched, total = F.count_if(F.col("status") == "matched"), F.count("*")
    return expected.agg(F.lit(category).alias("category"), matched.alias("matched"), total.alias("total"), F.when(total > 0, F.round(matched / total, 4)).alias("score"))


#: Sections of a gold standard, their metric and the category of their issues.
SECTIONS = {
    "documents": ("parsing_completeness", "parsing"),
    "fields": ("field_accuracy", "field"),
    "numbers": ("numeric_tolerance_accuracy", "numeric"),
    "associations": ("association_accuracy", "association"),
    "tables": ("table_structure_accuracy", "table"),
    "translations": ("translation_reference_score", "translation"),
}
ASSOCIATION = ("treatment_group", "timepoint", "condition")
TABLE = ("headers", "merged_cells", "footnotes", "cells")


def _same(e: str, a: str) -> Column:
    """Equal texts, null like an empty one."""
    return F.coalesce(normalised(F.col(e)), F.lit("")) == F.coalesce(normalised(F.col(a)), F.lit(""))


def section_ok(section: str) -> Column:
    """Whether an actual record a.* meets the expected e.* of a section.

    documents: parsed and evidence_locatable. fields: value, as text. numbers: value within tolerance or relative_tolerance
    (not negative), unit as text. associations: all keys as text. tables: equal in every place, null like empty.
    translations: similarity at least min_score (1 by default).
    """
    if section == "documents":
        return F.coalesce(F.col("a.parsed") & F.col("a.evidence_locatable"), F.lit(False))
    if section == "fields":
        return _same("e.value", "a.value")
    if section == "numbers":
        fair = (F.coalesce("e.tolerance", F.lit(0.0)) >= 0) & (F.coalesce("e.relative_tolerance", F.lit(0.0)) >= 0)
        return fair & number_ok(F.col("e.value"), F.col("a.value"), F.col("e.tolerance"), F.col("e.relative_tolerance")) & _same("e.unit", "a.unit")
    if section == "associations":
        return _all(*(_same(f"e.{k}", f"a.{k}") for k in ASSOCIATION))
    if section == "tables":
        return _all(*(_cells(F.col(f"e.{k}")) == _cells(F.col(f"a.{k}")) for k in TABLE))
    return F.col("similarity") >= F.coalesce("e.min_score", F.lit(1.0))


def _cells(c: Column) -> Column:
    """An array of any depth as text; null like an empty one."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.to_json(c)).otherwise("[]")


def _all(*tests: Column) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def section_status(section: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """id, status, similarity (of translations, 0 without a record or reference), expected and actual as JSON."""
    e, a = expected.withColumn("_e", F.lit(True)).alias("e"), actual.withColumn("_a", F.lit(True)).alias("a")
    both = e.join(a, F.col("e.id") == F.col("a.id"), "full")
    likeness = F.lit(None).cast("double")
    if section == "translations":
        reference, said = (F.coalesce(normalised(F.col(c)), F.lit("")) for c in ("e.reference", "a.translation"))
        likeness = F.when(F.col("_e") & (reference != ""), matcher_similarity(reference, said)).when(F.col("_e"), 0.0)
    both = both.withColumn("similarity", likeness)
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(section_ok(section), "matched").otherwise("wrong")

    def shown(side: str, mark: str, df: DataFrame) -> Column:
        return F.when(F.col(mark), F.to_json(F.struct(*(F.col(f"{side}.{c}") for c in df.columns if c not in ("id", mark)))))

    return both.select(F.coalesce("e.id", "a.id").alias("id"), status.alias("status"), "similarity", shown("e", "_e", expected).alias("expected"), shown("a", "_a", actual).alias("actual"))


def evaluated(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Metrics (metric, matched, total, score) and issues (category, id, expected, actual) of the sections that both have.

    The score is the matched share, for translations the mean similarity; null without expected records.
    """
    metrics, issues = None, None
    for section, (name, category) in SECTIONS.items():
        if section not in expected:
            continue
        found = section_status(section, expected[section], actual[section])
        asked = F.col("status") != "unexpected"
        total, matched = F.count_if(asked), F.count_if(F.col("status") == "matched")
        score = F.avg(F.when(asked, F.col("similarity"))) if section == "translations" else F.when(total > 0, matched / total)
        one = found.agg(F.lit(name).alias("metric"), matched.alias("matched"), total.alias("total"), score.alias("score"))
        kind = F.when(asked, category).otherwise("unexpected")
        bad = found.filter("status != 'matched'").select(kind.alias("category"), F.lit(section).alias("section"), "id", "status", "expected", "actual")
        metrics, issues = (one, bad) if metrics is None else (metrics.unionByName(one), issues.unionByName(bad))
    return metrics, issues


def report_lines(metrics: DataFrame, issues: DataFrame) -> DataFrame:
    """part, category, id, line of a Markdown report: a table of metrics, then every issue; in order of the first three."""
    spark = metrics.sparkSession
    head = ["# Gold standard evaluation", "", "The figures hold for the records given and claim no accuracy elsewhere.", "", "| metric | matched | total | score |", "|-|-|-|-|"]
    lines = spark.createDataFrame([(0, f"{i:02d}", "", t) for i, t in enumerate(head)], "part int, category string, id string, line string")
    score = F.when(F.col("score").isNull(), "-").otherwise(F.format_string("%.4f", F.col("score")))
    table = metrics.select(F.lit(1).alias("part"), F.col("metric").alias("category"), F.lit("").alias("id"), F.concat(F.lit("| "), F.concat_ws(" | ", "metric", F.col("matched").cast("string"), F.col("total").cast("string"), score), F.lit(" |")).alias("line"))
    each = F.concat(F.lit("* "), F.concat_ws(" ", "category", "section", "id", "status"), F.lit(": expected "), F.coalesce("expected", F.lit("nothing")), F.lit(", found "), F.coalesce("actual", F.lit("nothing")))
    return lines.unionByName(table).unionByName(issues.select(F.lit(2).alias("part"), "category", "id", each.alias("line")))


def write_report(metrics: DataFrame, issues: DataFrame, path: str) -> None:
    """The report as sorted text files, metrics and issues as JSON lines beside it."""
    report_lines(metrics, issues).orderBy("part", "category", "id").select("line").write.mode("overwrite").text(f"{path}/report")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    issues.write.mode("overwrite").json(f"{path}/issues")


def manifest(files: DataFrame) -> DataFrame:
    """path, size, sha256 of files(path, content) as the binaryFile source gives them."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(stated: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem: escaping, duplicate, missing, size and digest."""
    escape = stated.filter(F.col("path").rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)")).select("path", F.lit("escape").alias("problem"))
    twice = stated.groupBy("path").count().filter("count > 1").select("path", F.lit("duplicate").alias("problem"))
    both = stated.dropDuplicates(["path"]).join(found.toDF("path", "_size", "_sha256"), "path", "left")
    problem = F.when(F.col("_sha256").isNull(), "missing").when(F.col("size") != F.col("_size"), "size").when(F.col("sha256") != F.col("_sha256"), "digest")
    return both.select("path", problem.alias("problem")).filter("problem is not null").unionByName(escape).unionByName(twice)
