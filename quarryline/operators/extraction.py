"""Extraction: contexts of blocks, table rows and figures, and the values that fields find in them.

A schema's fields are part of the expression, so contexts are not joined with fields: every context is searched for all fields
in its own row. Contexts of the three kinds share their columns; what a kind lacks is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .values import dimensions, group_key, main_number, mined, parsed, sample_key, significance

MOST_FIELDS = 500
#: How far each kind of context is trusted; a figure's value has its own confidence, its figure's or the last.
BLOCK_CONFIDENCE, TABLE_CONFIDENCE, FIGURE_CONFIDENCE = 0.85, 0.9, 0.7
#: How a footnote of a table begins.
FOOTNOTE = r"(?i)^(?:注|Note|\*|[a-z]\))"
KEY = ("version_id", "page_id", "page_no")
COLUMNS = (*KEY, "kind", "source_key", "block_id", "table_cell_id", "figure_id", "text", "evidence", "previous", "next", "confidence", "method")


@dataclass(frozen=True)
class Field:
    key: str
    variants: tuple[str, ...]
    unit: int | None = None  # the preferred one


def is_footnote(text: Column) -> Column:
    return strip(text).rlike(FOOTNOTE)


def is_number(text: Column) -> Column:
    """Whether a label is a bare number, such as a tick of an axis."""
    return text.rlike(r"^[-+]?\d+(?:\.\d+)?\s*$")


def _lines(sep: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *(F.nullif(p, F.lit("")) for p in parts))


def block_contexts(blocks: DataFrame) -> DataFrame:
    """Contexts of blocks(version_id, page_id, page_no, block_id, sequence_no, content): a block with its neighbours on the page.

    Neighbours are those among the given blocks, so that a filter before this step decides what is near.
    """
    w = Window.partitionBy("version_id", "page_id").orderBy("sequence_no", "block_id")
    near = blocks.withColumns({"previous": F.lag("content").over(w), "next": F.lead("content").over(w)})
    source = F.concat(F.lit("block="), F.col("block_id").cast("string"), F.lit(":page="), F.col("page_no").cast("string"))
    return near.select(
        *KEY, F.lit("text").alias("kind"), source.alias("source_key"), "block_id", F.lit(None).cast("long").alias("table_cell_id"), F.lit(None).cast("long").alias("figure_id"),
        _lines("\n", F.col("previous"), F.col("content"), F.col("next")).alias("text"), F.coalesce("content", F.lit("")).alias("evidence"), "previous", "next",
        F.lit(BLOCK_CONFIDENCE).alias("confidence"), F.lit("rule_evidence_extractor").alias("method"),
    )


def table_contexts(cells: DataFrame) -> DataFrame:
    """A context for each row, but those of header cells only, of cells(*KEY, table_id, title, caption, table_cell_id, row, column, role, text, header_path)."""
    value = strip(F.coalesce("text", F.lit("")))
    head = F.array_join(F.coalesce("header_path", F.array().cast("array<string>")), " / ")
    segment = F.when(value != "", F.when(head != "", F.concat(head, F.lit(": "), value)).otherwise(value))
    first = F.struct("column", "table_cell_id")
    rows = cells.groupBy(*KEY, "table_id", "title", "caption", "row").agg(
        F.bool_and(F.coalesce(F.col("role") == "header", F.lit(False))).alias("head"),
        F.min(first).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(segment.isNotNull(), F.struct("column", "table_cell_id", segment.alias("s"))))), lambda c: c["s"]), " | ").alias("segments"),
    )
    source = F.concat(F.lit("table="), F.col("table_id").cast("string"), F.lit(":row="), F.col("row").cast("string"))
    return rows.filter(~F.col("head")).select(
        *KEY, F.lit("table").alias("kind"), source.alias("source_key"), F.lit(None).cast("long").alias("block_id"), F.col("first.table_cell_id").cast("long").alias("table_cell_id"), F.lit(None).cast("long").alias("figure_id"),
        _lines(" | ", F.col("title"), F.col("caption"), F.col("segments")).alias("text"), F.col("segments").alias("evidence"), F.col("title").alias("previous"), F.lit(None).cast("string").alias("next"),
        F.lit(TABLE_CONFIDENCE).alias("confidence"), F.lit("structured_table_extractor").alias("method"),
    )


def figure_contexts(figures: DataFrame) -> DataFrame:
    """A context for each direct value of figures(*KEY, figure_id, title, caption, confidence, labels array<string>, direct_values array<struct<text, confidence>>).

    The text holds the labels that are no bare numbers, then the value. A confidence of 0 counts as none.
    """
    labels = F.array_join(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda t: F.coalesce((t != "") & ~is_number(t), F.lit(False))), " | ")
    each = figures.select("*", labels.alias("_labels"), F.posexplode("direct_values").alias("_n", "_value"))
    value = F.coalesce("_value.text", F.lit(""))
    source = F.concat(F.lit("figure="), F.col("figure_id").cast("string"), F.lit(":value="), (F.col("_n") + 1).cast("string"))
    confidence = F.coalesce(F.nullif(F.col("_value.confidence"), F.lit(0.0)), F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(FIGURE_CONFIDENCE))
    return each.select(
        *KEY, F.lit("figure").alias("kind"), source.alias("source_key"), F.lit(None).cast("long").alias("block_id"), F.lit(None).cast("long").alias("table_cell_id"), F.col("figure_id").cast("long").alias("figure_id"),
        F.concat(_lines(" | ", F.col("title"), F.col("caption"), F.col("_labels")), F.lit(" | "), value).alias("text"), value.alias("evidence"), F.col("caption").alias("previous"), F.lit(None).cast("string").alias("next"),
        confidence.cast("double").alias("confidence"), F.lit("direct_chart_label_extractor").alias("method"),
    )


def included(rows: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """Blocks, cells or figures that an included hit of hits(block_id, table_id, figure_id, is_included) names by this key."""
    named = hits.filter("is_included").select(F.col(key).alias("_key")).filter("_key is not null")
    return rows.join(named, F.col(key) == F.col("_key"), "left_semi")


def extracted(contexts: DataFrame, fields: list[Field]) -> DataFrame:
    """A record for each value that a field finds in a context, in the order of the text: match_no counts from 1."""
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"at most {MOST_FIELDS} fields are allowed")
    usable = [(i, f) for i, f in enumerate(fields) if any(f.variants)]

    def of(i: int, f: Field) -> Column:
        return F.transform(mined(F.col("text"), list(f.variants)), lambda m, n: F.struct(F.lit(i).alias("position"), F.lit(f.key).alias("field"), F.lit(f.unit).cast("int").alias("target"), (n + 1).alias("match_no"), m["raw"].alias("raw_value"), m["unit"].alias("raw_unit")))

    none = F.array().cast("array<struct<position:int,field:string,target:int,match_no:int,raw_value:string,raw_unit:string>>")
    each = contexts.withColumn("_d", dimensions(F.col("text"))).withColumn("_m", F.explode(F.concat(none, *(of(i, f) for i, f in usable)))).select(*contexts.columns, "_d", "_m.*")
    p = F.col("parsed")
    group = group_key(F.col("source_key"), F.col("_d"))
    with_value = each.withColumn("parsed", parsed(F.col("raw_value")))
    return with_value.select(
        *contexts.columns, "position", "field", "target", "match_no", "raw_value", "raw_unit", "parsed", p["type"].alias("value_type"), main_number(p).alias("number"),
        F.substring(group, 1, 255).alias("group_key"), F.col("_d.timepoint").alias("timepoint"), sample_key(F.col("version_id"), group, F.col("field"), F.col("match_no")).alias("sample_key"),
        significance(F.col("raw_value")).alias("significance"), F.col("_d").alias("dimensions"), F.lit("pending").alias("review_status"), F.lit(False).alias("is_missing"),
    )


def run(schema_status: str, contexts: DataFrame, fields: list[Field]) -> DataFrame:
    """extracted, for a frozen schema only."""
    if schema_status != "frozen":
        raise ValueError("field_schema_not_frozen")
    return extracted(contexts, fields)


def reviewed(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """records(record_id, review_status, normalised, number, ...) with the status, and a number where given, of decisions(record_id, status, number).

    Only confirmed, modified, doubtful and excluded are accepted; raw values never change.
    """
    known = decisions.filter(F.col("status").isin("confirmed", "modified", "doubtful", "excluded")).select("record_id", F.col("status").alias("_status"), F.col("number").alias("_number"))
    return records.join(known, "record_id", "left").withColumns({"review_status": F.coalesce("_status", "review_status"), "number": F.coalesce("_number", "number")}).drop("_status", "_number")


def confirmed_conversions(records: DataFrame, confirm: DataFrame) -> DataFrame:
    """records(record_id, status, target_value, normalised) with the pending conversions of confirm(record_id) applied; others are left alone."""
    asked = confirm.select("record_id").distinct().withColumn("_yes", F.lit(True))
    yes = F.coalesce("_yes", F.lit(False)) & (F.col("status") == "pending")
    return records.join(asked, "record_id", "left").withColumns({"normalised": F.when(yes, F.col("target_value")).otherwise(F.col("normalised")), "status": F.when(yes, "applied").otherwise(F.col("status"))}).drop("_yes")
