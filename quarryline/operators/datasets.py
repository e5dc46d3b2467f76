"""Versioned datasets from long records: rows, cells, completeness, content hash, clone, wide view, unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering
from .values import present


def numbered(rows: DataFrame, order: str, out: str = "row_no") -> DataFrame:
    """rows numbered from 1 in the order of a unique column."""
    return ordering.numbered(rows, [order], out, 1)


def first_records(records: DataFrame) -> DataFrame:
    """Of records(row_key, field, ord, ...) the first of each row and field."""
    w = Window.partitionBy("row_key", "field").orderBy("ord")
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dataset_rows(records: DataFrame) -> DataFrame:
    """row_key and row_no, in order of a row's first record."""
    return numbered(records.groupBy("row_key").agg(F.min("ord").alias("first_ord")), "first_ord").select("row_key", "row_no")


def wide(cells: DataFrame, fields: list[str], value: str = "value") -> DataFrame:
    """One row per row_key with a column per field, of a stated list, so no job runs to find the fields."""
    return cells.groupBy("row_key").pivot("field", fields).agg(F.first(value, ignorenulls=True))


def long(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    return rows.unpivot(key, fields, "field", "value")


def freeze_issues(rows: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    """row_id, field, code: required cells that are missing or empty, and doubtful cells; none allows a freeze.

    The field list is a schema, so rows meet all of it; cells join on row and field.
    """
    required = rows.select("row_id").crossJoin(F.broadcast(fields.filter("is_required").select("field")))  # a schema's fields
    found = required.join(cells.select("row_id", "field", "value_text", "value_number", "is_missing"), ["row_id", "field"], "left")
    has = ~F.coalesce("is_missing", F.lit(False)) & (present("string", F.col("value_text")) | present("number", F.col("value_number")))
    lacking = found.filter(~has).select("row_id", "field", F.lit("required_value_missing").alias("code"))
    doubtful = cells.filter("review_status = 'doubtful'").select("row_id", "field", F.lit("doubtful_value").alias("code"))
    return lacking.unionByName(doubtful)


def canonical(*columns: Column) -> Column:
    """A row as text with a fixed order and null marks."""
    return F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns))


def content_hash(rows: DataFrame, by: list[str], *columns: Column) -> DataFrame:
    """by and the SHA-256 of the sorted row digests of each group: equal for any order of rows, changed by any value.

    Digests are folded a thousandth of a group at a time, so a group's memory is that of its digests' digests.
    """
    digests = rows.select(*by, F.sha2(canonical(*columns), 256).alias("_d")).withColumn("_part", F.substring("_d", 1, 3))
    parts = digests.groupBy(*by, "_part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("_d"))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_d"))), lambda s: s["_d"]), ""), 256).alias("content_hash"))


def cloned(table: DataFrame, ids: list[str], version: str, new_version: str) -> DataFrame:
    """A version's rows under a new version, ids derived from the old ones; references cloned alike still meet."""
    return table.withColumns({version: F.lit(new_version)} | {c: F.sha2(F.concat_ws("/", F.lit(new_version), F.col(c).cast("string")), 256) for c in ids})


#: Review states of records that a dataset is built from, and the state of a version that may be changed.
BUILT_FROM, DRAFT = ("pending", "confirmed", "modified"), "draft"


def reviewed(records: DataFrame, statuses: tuple[str, ...] = BUILT_FROM) -> DataFrame:
    """The records(review_status, ...) that a dataset is built from; those of no state are left out."""
    return records.filter(F.col("review_status").isin(*statuses))


def judged(edits: DataFrame, versions: DataFrame, rows: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """edits(version_id, ...) with code: null if allowed, else why not.

    Only drafts of versions(version_id, status) may be changed. With rows(version_id, row_id) and fields(version_id, field) an
    edit's row and field must be the version's own.
    """
    known = versions.select("version_id", F.col("status").alias("_status"))
    out = edits.join(known, "version_id", "left")
    code = F.when(F.col("_status").isNull(), "dataset_version_not_found").when(F.col("_status") != DRAFT, "dataset_immutable")
    for name, table_, missing in (("row_id", rows, "dataset_row_not_found"), ("field", fields, "dataset_field_not_found")):
        if table_ is not None:
            own = table_.select("version_id", name).distinct().withColumn(f"_{name}", F.lit(True))
            out = out.join(own, ["version_id", name], "left")
            code = code.when(F.col(f"_{name}").isNull(), missing)
    return out.withColumn("code", code).drop("_status", "_row_id", "_field")


def with_added_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows(version_id, row_id, row_no, review_status, is_deleted) and the allowed ones of new(version_id, row_id, code), numbered on.

    Numbers go on from the version's greatest, deleted rows included, in order of row_id.
    """
    last = rows.groupBy("version_id").agg(F.max("row_no").alias("_last"))
    order = Window.partitionBy("version_id").orderBy("row_id")  # what one person adds to a draft
    added = new.filter("code is null").join(last, "version_id", "left").withColumn("row_no", F.coalesce("_last", F.lit(0)) + F.row_number().over(order))
    return rows.unionByName(added.select("version_id", "row_id", F.col("row_no").cast(dict(rows.dtypes)["row_no"]).alias("row_no"), F.lit("pending").alias("review_status"), F.lit(False).alias("is_deleted")))


def with_deleted_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows with the allowed ones of gone(version_id, row_id, code) marked as deleted; no row goes."""
    asked = gone.filter("code is null").select("version_id", "row_id").distinct().withColumn("_gone", F.lit(True))
    lost = F.coalesce("_gone", F.lit(False))
    return rows.join(asked, ["version_id", "row_id"], "left").withColumns({"review_status": F.when(lost, "deleted").otherwise(F.col("review_status")), "is_deleted": lost | F.col("is_deleted")}).drop("_gone")


def frozen(versions: DataFrame, rows: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    """version_id, status, code, issue_count, row_count, field_count, content_hash: every version asked to be frozen.

    Only a draft is, and only without issues: no required cell of a row that is not deleted may be missing, none of its cells
    doubtful. A refused version keeps its status and has a code and no hash. Inputs are versions(version_id, status),
    rows(version_id, row_id, is_deleted), fields(version_id, field, is_required) and cells(version_id, row_id, field,
    value_text, value_number, is_missing, review_status).
    """
    live = rows.filter("not is_deleted").select("version_id", "row_id")
    own = cells.join(live, ["version_id", "row_id"], "left_semi")
    required = live.join(fields.filter("is_required").select("version_id", "field"), "version_id")  # a row for each required field
    has = ~F.coalesce("is_missing", F.lit(False)) & (present("string", F.col("value_text")) | present("number", F.col("value_number")))
    lacking = required.join(own, ["version_id", "row_id", "field"], "left").filter(~has).select("version_id")
    issues = lacking.unionByName(own.filter("review_status = 'doubtful'").select("version_id")).groupBy("version_id").agg(F.count("*").alias("issue_count"))
    hashes = content_hash(own, ["version_id"], F.col("row_id"), F.col("field"), F.col("value_text"), F.col("value_number").cast("decimal(38, 6)"))
    counts = live.groupBy("version_id").agg(F.count("*").alias("row_count")), fields.groupBy("version_id").agg(F.count("*").alias("field_count"))
    out = versions.select("version_id", "status")
    for part in (issues, *counts, hashes):
        out = out.join(part, "version_id", "left")
    out = out.fillna(0, ["issue_count", "row_count", "field_count"])
    code = F.when(F.col("status") != DRAFT, "dataset_not_freezable").when(F.col("issue_count") > 0, "dataset_freeze_validation_failed")
    free = code.isNull()
    return out.select("version_id", F.when(free, "frozen").otherwise(F.col("status")).alias("status"), code.alias("code"), "issue_count", "row_count", "field_count", F.when(free, F.coalesce("content_hash", F.sha2(F.lit(""), 256))).alias("content_hash"))
