"""Sheets of a dataset and of a search as DataFrames, and a writer: a folder for each sheet, nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, first_key, missing_as
from .search import matched_terms
from .values import key_part

#: What stands for nothing, characters of a structured cell, rows of the audit sheet, documents' columns.
MISSING, MOST_CONTENT, MOST_AUDIT = "——", 2000, 5000
BASE = ("filename", "title", "published", "publication", "treatment", "location", "timepoint", "review_status")


def _or_missing(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(MISSING))


def publication_time(date: Column, year: Column) -> Column:
    """The date, else the year (0 is none), else the marker."""
    return F.coalesce(date.cast("string"), F.nullif(year, F.lit(0)).cast("string"), F.lit(MISSING))


def raw_cell(present: Column, raw: Column, number: Column, text: Column) -> Column:
    """What a cell shows: its raw value (an empty one too), else the number, else a text, else the marker."""
    return F.when(~present, MISSING).otherwise(F.coalesce(raw, number.cast("string"), F.nullif(text, F.lit("")), F.lit(MISSING)))


def ml_cell(number: Column, boolean: Column, date: Column, text: Column, normalised: Column, ml: Column) -> Column:
    """What a model reads: number, boolean, date, text, then the value of the normalised or model JSON, or all of it; else empty."""

    def of(j: Column) -> Column:
        j = F.nullif(F.nullif(j, F.lit("{}")), F.lit(""))
        return F.coalesce(F.get_json_object(j, "$.value"), j)

    return F.coalesce(number.cast("string"), boolean.cast("string"), date.cast("string"), F.nullif(text, F.lit("")), of(normalised), of(ml), F.lit(""))


def base_columns(rows: DataFrame) -> DataFrame:
    """row_id and BASE of rows joined with their document.

    Columns: row_id, row_metadata and document_metadata (JSON), sample_key, filename, title, date, year, publication, review_status.
    """
    own, doc, key = F.col("row_metadata"), F.col("document_metadata"), F.col("sample_key")
    return rows.select(
        "row_id",
        _or_missing(F.col("filename")).alias("filename"),
        _or_missing(F.col("title")).alias("title"),
        publication_time(F.col("date"), F.col("year")).alias("published"),
        _or_missing(F.col("publication")).alias("publication"),
        F.coalesce(first_key(own, "treatment", "variety"), key_part(key, "treatment"), first_key(doc, "variety", "treatment"), F.lit(MISSING)).alias("treatment"),
        F.coalesce(first_key(doc, "location", "material"), first_key(own, "location", "material"), F.lit(MISSING)).alias("location"),
        F.coalesce(first_key(own, "timepoint"), key_part(key, "time"), F.lit(MISSING)).alias("timepoint"),
        _or_missing(F.col("review_status")).alias("review_status"),
    )


def dataset_sheet(rows: DataFrame, cells: DataFrame, fields: list[str], kind: str) -> DataFrame:
    """The main (kind raw) or model (kind ml) sheet: BASE and a column for each field of a stated list.

    cells(row_id, field, raw_value, value_number, value_boolean, value_date, value_text, normalized_value, ml_value).
    """
    shown = raw_cell(F.lit(True), F.col("raw_value"), F.col("value_number"), F.col("value_text")) if kind == "raw" else ml_cell(*(F.col(c) for c in ("value_number", "value_boolean", "value_date", "value_text", "normalized_value", "ml_value")))
    wide = cells.select("row_id", "field", shown.alias("shown")).groupBy("row_id").pivot("field", fields).agg(F.first("shown"))
    none = F.lit(MISSING if kind == "raw" else "")
    joined = base_columns(rows).join(wide, "row_id", "left")
    return joined.select("row_id", *BASE, *(F.coalesce(F.col(f"`{f}`"), none).alias(f) for f in fields))


def token_dictionary(terms: DataFrame, categories: DataFrame, aliases: DataFrame, units: DataFrame) -> DataFrame:
    """name, category, aliases, unit, status of the live terms(term_id, name, status, is_selected, deleted, category_id, unit_id) that are confirmed or selected."""
    live = terms.filter(~F.col("deleted") & ((F.col("status") == "confirmed") | F.col("is_selected")))
    spelled = aliases.filter("alias is not null and alias != ''").groupBy("term_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "、").alias("aliases"))
    joined = live.join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left").join(spelled, "term_id", "left").join(units.select("unit_id", F.col("symbol").alias("unit")), "unit_id", "left")
    return joined.select("name", *(_or_missing(F.col(c)).alias(c) for c in ("category", "aliases", "unit", "status")))


def traceability(rows: DataFrame, cells: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """row_key, field, raw_value, page_no, evidence_text of rows(row_id, row_key), cells(cell_id, row_id, field, raw_value), evidence(cell_id, page_id, evidence_text), pages(page_id, page_no)."""
    both = rows.join(cells, "row_id").join(evidence, "cell_id").join(pages, "page_id")
    return both.select("row_key", "field", "raw_value", "page_no", "evidence_text")


def conversion_sheet(conversions: DataFrame, units: DataFrame) -> DataFrame:
    """source_value, source_unit, target_value, target_unit, formula, status, created_at of conversions, with the units' symbols where they are known."""
    symbol = units.select("unit_id", "symbol")
    named = conversions.join(symbol.toDF("source_unit_id", "_s"), "source_unit_id", "left").join(symbol.toDF("target_unit_id", "_t"), "target_unit_id", "left")
    return named.select("source_value", F.coalesce(F.nullif("_s", F.lit("")), F.nullif("source_unit_text", F.lit("")), F.lit(MISSING)).alias("source_unit"), "target_value", _or_missing(F.col("_t")).alias("target_unit"), *(_or_missing(F.col(c)).alias(c) for c in ("formula", "status", "created_at")))


def audit_sheet(logs: DataFrame, users: DataFrame, most: int = MOST_AUDIT) -> DataFrame:
    """The newest logs(log_id, created_at, action, entity_type, entity_id, actor_id, reason, after) with their actor's name."""
    few = logs.orderBy(F.desc("created_at"), F.desc("log_id")).limit(most)
    named = few.join(users.select("actor_id", F.col("name").alias("_actor")), "actor_id", "left")
    return named.select(*(_or_missing(F.col(c)).alias(c) for c in ("created_at", "action", "entity_type", "entity_id")), F.coalesce("_actor", F.col("actor_id").cast("string"), F.lit(MISSING)).alias("actor"), F.coalesce(F.nullif("reason", F.lit("")), F.nullif("after", F.lit("")), F.lit("")).alias("summary"))


def found_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """documents(doc_id, title, authors, date, year, publication, metadata, filename) with hits, in order of their first one (order_no)."""
    first = hits.groupBy("doc_id").agg(F.min("result_no").alias("order_no"))
    both = first.join(documents, "doc_id")
    meta = F.col("metadata")
    return both.select(
        "order_no", "doc_id", _or_missing(F.col("title")).alias("title"), _or_missing(F.array_join("authors", "、")).alias("authors"), publication_time(F.col("date"), F.col("year")).alias("published"), _or_missing(F.col("publication")).alias("publication"),
        F.coalesce(first_key(meta, "variety", "treatment"), F.lit(MISSING)).alias("treatment"), F.coalesce(first_key(meta, "location", "material"), F.lit(MISSING)).alias("location"), _or_missing(F.col("filename")).alias("filename"),
    )


def hit_sheet(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits(result_no, doc_id, page_no, matches, previous, content, next, review_status) with titles, matched terms and all evidence as one text."""
    titles = documents.select("doc_id", "title")
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("previous", "content", "next")]
    return hits.join(titles, "doc_id", "left").select(
        "result_no", _or_missing(F.col("doc_id")).alias("doc_id"), _or_missing(F.col("title")).alias("title"), matched_terms(F.col("matches")).alias("terms"), F.lit("text").alias("evidence_type"), "page_no",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("previous", "content", "next")), missing_as(F.concat_ws(" ", *parts), MISSING).alias("evidence"), _or_missing(F.col("review_status")).alias("review_status"),
    )


def structured_sheet(hits: DataFrame, items: DataFrame, documents: DataFrame) -> DataFrame:
    """The tables and figures, items(doc_id, kind, number, title, caption, structured, page_no), of documents with hits; structured content is cut."""
    near = items.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").join(documents.select("doc_id", F.col("title").alias("_doc")), "doc_id", "left")
    return near.select("kind", *(_or_missing(F.col(c)).alias(c) for c in ("number", "title", "caption")), cut(F.coalesce("structured", F.lit("")), MOST_CONTENT).alias("structured"), "page_no", _or_missing(F.col("_doc")).alias("document"))


def candidate_sheet(terms: DataFrame, categories: DataFrame, occurrences: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, category, occurrences, documents, aliases, example, status of live terms, with the first example by document and place.

    occurrences(term_id, doc_id, place, n, context).
    """
    counts = occurrences.groupBy("term_id").agg(F.sum("n").alias("occurrences"), F.countDistinct("doc_id").alias("documents"), F.min_by("context", F.struct("doc_id", "place")).alias("example"))
    spelled = aliases.filter("alias is not null and alias != ''").groupBy("term_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "、").alias("aliases"))
    joined = terms.filter(~F.col("deleted")).join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left").join(counts, "term_id", "left").join(spelled, "term_id", "left")
    return joined.select("name", _or_missing(F.col("category")).alias("category"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("occurrences", "documents")), *(_or_missing(F.col(c)).alias(c) for c in ("aliases", "example", "status")))


def write_sheets(sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """Each sheet as a folder of files with a header; kind is csv, json or parquet."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").options(header="true", escape='"').format(kind).save(f"{path}/{name}")
