"""Edits of drafts, refused freezes and the review gate on hand-made rows."""

from quarryline.operators import datasets as D

VERSIONS = [(1, "draft"), (2, "frozen"), (3, "draft"), (4, "draft")]


def versions(spark):
    return spark.createDataFrame(VERSIONS, "version_id int, status string")


def test_only_reviewed_records_build(spark):
    rows = spark.createDataFrame([(1, "pending"), (2, "rejected"), (3, "modified"), (4, None), (5, "confirmed"), (6, "deleted")], "id int, review_status string")
    assert sorted(r.id for r in D.reviewed(rows).collect()) == [1, 3, 5]
    assert [r.id for r in D.reviewed(rows, ("rejected",)).collect()] == [2]


def test_edits_are_judged(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "version_id int, row_id int")
    fields = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "version_id int, field string")
    edits = spark.createDataFrame([(1, 10, "a"), (1, 20, "a"), (1, 10, "b"), (2, 20, "a"), (9, 10, "a"), (None, 10, "a")], "version_id int, row_id int, field string")
    got = {(r.version_id, r.row_id, r.field): r.code for r in D.judged(edits, versions(spark), rows, fields).collect()}
    assert list(got[k] for k in [(1, 10, "a"), (1, 20, "a"), (1, 10, "b"), (2, 20, "a"), (9, 10, "a"), (None, 10, "a")]) == [None, "dataset_row_not_found", "dataset_field_not_found", "dataset_immutable", "dataset_version_not_found", "dataset_version_not_found"]


def test_rows_are_added_and_deleted_in_drafts_only(spark):
    rows = spark.createDataFrame([(1, 10, 1, "confirmed", False), (1, 11, 2, "confirmed", False), (2, 20, 1, "confirmed", False)], "version_id int, row_id int, row_no long, review_status string, is_deleted boolean")
    gone = D.judged(spark.createDataFrame([(1, 11), (1, 11), (2, 20), (1, 99)], "version_id int, row_id int"), versions(spark), rows)
    left = D.with_deleted_rows(rows, gone)
    assert {(r.row_id, r.review_status, r.is_deleted) for r in left.collect()} == {(10, "confirmed", False), (11, "deleted", True), (20, "confirmed", False)}
    new = D.judged(spark.createDataFrame([(1, 13), (1, 12), (2, 21), (3, 30)], "version_id int, row_id int"), versions(spark))
    got = {(r.version_id, r.row_id): (r.row_no, r.review_status) for r in D.with_added_rows(left, new).collect()}
    assert got == {(1, 10): (1, "confirmed"), (1, 11): (2, "deleted"), (1, 12): (3, "pending"), (1, 13): (4, "pending"), (2, 20): (1, "confirmed"), (3, 30): (1, "pending")}


def test_freezing(spark):
    rows = spark.createDataFrame([(1, 10, False), (1, 11, True), (2, 20, False), (3, 30, False)], "version_id int, row_id int, is_deleted boolean")
    fields = spark.createDataFrame([(v, f, f == "a") for v in (1, 2, 3) for f in "ab"], "version_id int, field string, is_required boolean")

    def cells(*more):
        base = [(1, 10, "a", "x", None, False, "pending"), (1, 11, "b", "y", None, False, "doubtful"), (2, 20, "a", "x", None, False, "pending")]
        return spark.createDataFrame([*base, *more], "version_id int, row_id int, field string, value_text string, value_number double, is_missing boolean, review_status string")

    def outcome(c):
        return {r.version_id: r for r in D.frozen(versions(spark), rows, fields, c).collect()}

    got = outcome(cells((3, 30, "a", " ", None, False, "pending"), (3, 30, "b", None, 0.0, False, "doubtful")))
    assert (got[1].status, got[1].code, got[1].issue_count, got[1].row_count, got[1].field_count) == ("frozen", None, 0, 1, 2)  # what is deleted has no issues
    assert (got[2].status, got[2].code, got[2].content_hash) == ("frozen", "dataset_not_freezable", None)
    assert (got[3].status, got[3].code, got[3].issue_count, got[3].content_hash) == ("draft", "dataset_freeze_validation_failed", 2, None)
    assert got[4].status == "frozen" and got[4].row_count == 0  # an empty draft has no issues
    again = outcome(cells((1, 10, "b", None, 0.0, False, "pending")))
    assert again[1].content_hash not in (None, got[1].content_hash)
