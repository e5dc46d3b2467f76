"""Rules around a project's data: reviews, claims, retries, archives, scopes, roles, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped
from .tables import latest

#: Sources that a report lists, and rows of an audit log.
MOST_SOURCES, MOST_AUDIT = 200, 5000


def claimed(jobs: DataFrame, most: int = 1) -> DataFrame:
    """The queued jobs(job_id, status, priority, queued_at) that are taken next: greatest priority, then longest in the queue."""
    order = [F.desc("priority"), F.col("queued_at"), F.col("job_id")]
    return jobs.filter("status = 'queued'").orderBy(*order).limit(most).withColumn("status", F.lit("running"))


def retried(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, status, retry_count, max_retries) with may_retry: failed or cancelled ones with retries left go back to the queue."""
    may = F.col("status").isin("failed", "cancelled") & (F.col("retry_count") < F.col("max_retries"))
    return jobs.withColumns({"may_retry": may, "retry_count": F.col("retry_count") + may.cast("int"), "status": F.when(may, "queued").otherwise(F.col("status"))})


def progress(events: DataFrame) -> DataFrame:
    """job_id, n, stage, percent of append-only events(event_id, job_id, stage, percent): how many, and the last, percent within 0 to 100."""
    counted = events.groupBy("job_id").agg(F.count("*").alias("n"))
    last = latest(events, ["job_id"], F.desc("event_id")).select("job_id", "stage", clamped(F.col("percent")).alias("percent"))
    return counted.join(last, "job_id")


def recorded(log: DataFrame, new: DataFrame) -> DataFrame:
    """log(event_id, job_id, ...) with new(job_id, at, ...) appended: ids go on within each job, in order of time."""
    top = log.groupBy("job_id").agg(F.max("event_id").alias("_top"))
    w = Window.partitionBy("job_id").orderBy("at")
    added = new.join(top, "job_id", "left").withColumn("event_id", F.coalesce("_top", F.lit(0)) + F.row_number().over(w))
    return log.unionByName(added.select(log.columns))


def guarded_owners(members: DataFrame) -> DataFrame:
    """members(project_id, user_id, role, status) with may_leave: the last active owner of a project must stay."""
    owner = (F.col("role") == "owner") & (F.col("status") == "active")
    owners = members.groupBy("project_id").agg(F.count_if(owner).alias("_owners"))
    return members.join(owners, "project_id").withColumn("may_leave", ~owner | (F.col("_owners") > 1)).drop("_owners")


def archived(projects: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """projects(project_id, status) as wanted(project_id, archive) says, and an audit row for each real change; deleted ones stay."""
    asked = projects.join(wanted, "project_id", "left")
    new = F.when(F.col("status") == "deleted", F.col("status")).when(F.col("archive"), "archived").when(~F.col("archive"), "active").otherwise(F.col("status"))
    changed = asked.withColumn("_new", new)
    audit = changed.filter(F.col("_new") != F.col("status")).select("project_id", F.when(F.col("_new") == "archived", "archive").otherwise("unarchive").alias("action"))
    return changed.select("project_id", F.col("_new").alias("status")), audit


def scope_issues(reports: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """report_id, part, code of reports(report_id, project_id, a key for each part): parts that are missing or of another project.

    parts(key, project_id) by the name of their column in reports; a null key asks for nothing.
    """
    out = None
    for name, part in parts.items():
        known = part.toDF("_key", "_project")
        joined = reports.filter(F.col(name).isNotNull()).join(known, F.col(name) == F.col("_key"), "left")
        code = F.when(F.col("_key").isNull(), "not_found").when(~F.col("_project").eqNullSafe(F.col("project_id")), "other_project")
        one = joined.select("report_id", F.lit(name).alias("part"), code.alias("code")).filter("code is not null")
        out = one if out is None else out.unionByName(one)
    return out


def converted_requests(requests: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """requests(request_id, rule_id, user_id, value, confirmed) with code (null: converted) and target.

    A rule(rule_id, active, org, multiplier, offset, confirm) must be active and global or of an organisation that the user is
    an active member of; it may ask for confirmation; only affine ones are computed.
    """
    own = members.filter("status = 'active'").select(F.col("org").alias("_org"), F.col("user_id").alias("_user")).distinct()
    both = requests.join(rules.filter("active").withColumnRenamed("rule_id", "_rule"), F.col("rule_id") == F.col("_rule"), "left")
    seen = both.join(own, (F.col("org") == F.col("_org")) & (F.col("user_id") == F.col("_user")), "left")
    unknown = F.col("_rule").isNull() | (F.col("org").isNotNull() & F.col("_user").isNull())
    code = F.when(unknown, "conversion_rule_not_found").when(F.col("confirm") & ~F.col("confirmed"), "conversion_requires_confirmation").when(F.col("multiplier").isNull(), "formula_conversion_not_executable")
    return seen.select("request_id", code.alias("code"), F.when(code.isNull(), F.col("value") * F.col("multiplier") + F.coalesce("offset", F.lit(0.0))).alias("target"))


def report_sources(documents: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """The first live documents(document_id, project_id, created_at, deleted_at), in order of creation."""
    return documents.filter("deleted_at is null").orderBy("created_at", "document_id").limit(most)


def untranslated(blocks: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Non-blank blocks(block_id, page_no, sequence_no, content) in order that have no translation yet; all of them to overwrite."""
    some = blocks.filter(F.trim("content") != "")
    left = some if overwrite else some.join(done.select("block_id"), "block_id", "left_anti")
    return left.orderBy("page_no", "sequence_no", "block_id")


def cell_counters(cells: DataFrame, has_value: Column) -> DataFrame:
    """version_id, required_missing, doubtful, total of cells(version_id, is_required, review_status, ...)."""
    return cells.groupBy("version_id").agg(F.count_if(F.col("is_required") & ~has_value).alias("required_missing"), F.count_if(F.col("review_status") == "doubtful").alias("doubtful"), F.count("*").alias("total"))


def facets(records: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Each key once with the name that its last record gives, and how many records it has."""
    return records.groupBy(key).agg(F.max_by(name, order).alias(name), F.count("*").alias("n"))


def lacking(needed: DataFrame, held: DataFrame, by: str, item: str) -> DataFrame:
    """by, missing (sorted items): what each needs of needed(by, item) and held(by, item) does not have; none is no row."""
    return needed.join(held.select(by, item), [by, item], "left_anti").groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("missing"))


def nested(parents: DataFrame, children: DataFrame, key: str, out: str, order: list[str]) -> DataFrame:
    """parents with an array of their children's rows, in order; empty without any."""
    rest = [c for c in children.columns if c not in (key, *order)]
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(out))
    joined = parents.join(rows, key, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(dict(joined.dtypes)[out])))


def upload_tally(files: DataFrame) -> DataFrame:
    """created, duplicate, failed of files(file_id, sha256, problem): a failed one has a problem, a later copy is a duplicate."""
    good = F.col("problem").isNull()
    first = Window.partitionBy("sha256").orderBy("file_id")
    ranked = files.filter(good).withColumn("_n", F.row_number().over(first)).select(F.when(F.col("_n") == 1, "created").otherwise("duplicate").alias("s"))
    every = ranked.unionByName(files.filter(~good).select(F.lit("failed").alias("s")))
    return every.agg(*(F.count_if(F.col("s") == s).alias(s) for s in ("created", "duplicate", "failed")))
