"""Deduplication, issue rollup, numbering, lookup joins and the status overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.functions.fingerprint import DEFAULT_RULES, GroupingRules, with_fingerprint
from issueforge.plans.skew import attach, salt, salts_seen
from issueforge.plans.slices import arrival_number
from issueforge.schema import ARRIVAL, DEFAULT_STATUS, STATUSES
from issueforge.session import materialize

# What grouping needs of an envelope.  Payload columns stay out of the shuffles.
NARROW = (
    "event_id", "seq", "received_us", "project", "fingerprint", "level", "timestamp", "type",
    "culprit", "title",
)
WIDE_TASK_ROWS = 50_000  # rows with payload that one task reads from a shuffle
ISSUE_KEY = ["project", "fingerprint"]
FIRST_FIELDS = ("level", "type", "culprit", "title", "sample_event_id", "first_received_us", "first_seq")
ISSUE_COLUMNS = (
    "id", "fingerprint", "project", "level", "type", "culprit", "title", "status", "first_seen",
    "last_seen", "count", "sample_event_id",
)


def arrival() -> Column:
    return F.struct(*ARRIVAL)


def fingerprinted(envelopes: DataFrame, rules: GroupingRules = DEFAULT_RULES) -> DataFrame:
    """Narrow rows for grouping: one map-only stage over the envelopes."""
    return with_fingerprint(envelopes, rules).select(*NARROW)


def dedupe(rows: DataFrame) -> DataFrame:
    """The first-arrived delivery of every event_id, over all projects.

    A partial aggregate, so a thousandfold redelivered id leaves each map task as one row.
    """
    rest = [c for c in rows.columns if c != "event_id"]
    return (
        rows.groupBy("event_id")
        .agg(F.min_by(F.struct(*rest), arrival()).alias("_first"))
        .select(*[("event_id" if c == "event_id" else F.col(f"_first.{c}").alias(c)) for c in rows.columns])
    )


def redelivered(rows: DataFrame) -> DataFrame:
    """The ``seq`` of every delivery that is not the first of its event_id."""
    ids = rows.select("event_id", *ARRIVAL).withColumn("_salt", salt("seq"))
    repeated = (
        ids.groupBy("event_id")
        .agg(
            F.min_by("seq", arrival()).alias("first_seq"),
            F.count("*").alias("_n"),
            salts_seen().alias("_salts"),
        )
        .filter("_n > 1")
        .drop("_n")
    )
    return attach(ids, repeated, ["event_id"]).filter("seq <> first_seq").select("seq")


def drop_redelivered(rows: DataFrame) -> DataFrame:
    """D1 for wide rows: payloads are not shuffled by event_id, only the losing ids are looked up.

    Where the ids are too many to broadcast, both sides are dealt by seq into tasks of about
    ``WIDE_TASK_ROWS`` rows, however many shuffle partitions the session has: their number follows the rows.
    """
    fixed = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(fixed, -(-rows.count() // WIDE_TASK_ROWS))
    return rows.join(redelivered(rows).repartition(tasks, "seq"), "seq", "left_anti")


def rollup_partials(accepted: DataFrame) -> DataFrame:
    """One row per (project, fingerprint) of accepted events; merges with `merge_partials`."""
    first = F.struct(
        "level", "type", "culprit", "title", F.col("event_id").alias("sample_event_id"),
        F.col("received_us").alias("first_received_us"), F.col("seq").alias("first_seq"),
    )
    return (
        accepted.groupBy(*ISSUE_KEY)
        .agg(
            F.count("*").alias("count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.min_by(first, arrival()).alias("_first"),
        )
        .select(*ISSUE_KEY, "count", "first_seen", "last_seen", "_first.*")
    )


def merge_partials(old: DataFrame, new: DataFrame) -> DataFrame:
    """S3: fold a batch's partial rollup into an earlier snapshot."""
    both = old.unionByName(new)
    return (
        both.groupBy(*ISSUE_KEY)
        .agg(
            F.sum("count").alias("count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min_by(F.struct(*FIRST_FIELDS), F.struct("first_received_us", "first_seq")).alias("_first"),
        )
        .select(*ISSUE_KEY, "count", "first_seen", "last_seen", "_first.*")
    )


def number_issues(rollup: DataFrame) -> DataFrame:
    """D3: ids 1..n in order of first arrival.

    The rollup is written out first: numbering reads it on three branches, and none of them should
    run the fingerprints again.
    """
    return arrival_number(materialize(rollup, "rollup"), "first_received_us", "first_seq", "id")


def issues_of(rows: DataFrame) -> DataFrame:
    """Narrow deliveries -> numbered issues."""
    return number_issues(rollup_partials(dedupe(rows)))


def attributed(rows: DataFrame) -> DataFrame:
    """Every delivery with the issue key of the stored event and whether it was the one counted.

    A redelivery belongs to the issue of the first-arrived delivery of its id, whatever its own
    payload says; ``fingerprint`` stays its own, ``issue_project``/``issue_fingerprint`` are the
    stored event's.
    """
    salted = rows.withColumn("_salt", salt("seq"))
    stored = (
        salted.groupBy("event_id")
        .agg(
            F.min_by(
                F.struct(
                    F.col("seq").alias("first_seq"),
                    F.col("project").alias("issue_project"),
                    F.col("fingerprint").alias("issue_fingerprint"),
                ),
                arrival(),
            ).alias("_first"),
            salts_seen().alias("_salts"),
        )
        .select("event_id", "_first.*", "_salts")
    )
    return (
        attach(salted, stored, ["event_id"])
        .withColumn("accepted", F.col("seq") == F.col("first_seq"))
        .drop("first_seq")
    )


def with_issue(
    rows: DataFrame, issues: DataFrame, project: str, fingerprint: str, *columns: str | Column
) -> DataFrame:
    """Look up issue columns for event rows; even when one issue holds most of the rows."""
    salted = rows.withColumn("_salt", salt("seq"))
    present = salted.groupBy(project, fingerprint).agg(salts_seen().alias("_salts"))
    wanted = issues.select(F.col("project").alias(project), F.col("fingerprint").alias(fingerprint), *columns)
    return attach(salted, present.join(wanted, [project, fingerprint]), [project, fingerprint])


def unseen(batch: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Deliveries whose event_id is not stored yet.  The batch side is deduplicated first."""
    return dedupe(batch).join(stored_ids.select("event_id"), "event_id", "left_anti")


def delivery_results(evals: DataFrame, issues: DataFrame, fired: DataFrame) -> DataFrame:
    """Id, issue_id, fingerprint, new_issue and fired rules for every valid delivery.

    ``evals`` are `attributed` deliveries; each carries its own fingerprint.
    """
    resolved = with_issue(
        evals, issues, "issue_project", "issue_fingerprint", F.col("id").alias("issue_id"), "first_seq"
    )
    rules = fired.groupBy("seq").agg(F.sort_array(F.collect_set("rule")).alias("_rules"))
    return (
        resolved.join(rules, "seq", "left")
        .select(
            "seq",
            F.col("event_id").alias("id"),
            "issue_id",
            "fingerprint",
            (F.col("seq") == F.col("first_seq")).alias("new_issue"),
            F.coalesce(F.array_join("_rules", ","), F.lit("")).alias("alerts"),
        )
    )


def status_changes_checked(changes: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applicable changes, rejected changes with a reason)."""
    named = changes.join(issues.select(F.col("id").alias("issue_id"), F.lit(True).alias("_known")), "issue_id", "left")
    judged = named.withColumn(
        "reject",
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid status").when(
            F.col("_known").isNull(), "issue not found"
        ),
    ).drop("_known")
    return judged.filter("reject IS NULL").drop("reject"), judged.filter("reject IS NOT NULL")


def current_status(changes: DataFrame) -> DataFrame:
    """Last status per issue; changes are reduced to one row per issue map-side."""
    return changes.groupBy("issue_id").agg(F.max_by("status", "change_seq").alias("status"))


def with_status(issues: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Issues in the public column order with their current status.  New events do not reopen."""
    if changes is None:
        rows = issues.withColumn("status", F.lit(DEFAULT_STATUS))
    else:
        valid = changes.filter(F.col("status").isin(*STATUSES))
        latest = current_status(valid).withColumnRenamed("issue_id", "id")
        rows = issues.join(latest, "id", "left").withColumn(
            "status", F.coalesce("status", F.lit(DEFAULT_STATUS))
        )
    return rows.select(*ISSUE_COLUMNS)


def store_counts(rows: DataFrame) -> DataFrame:
    """Number of stored events and issues."""
    per_issue = dedupe(rows.select("event_id", *ARRIVAL, *ISSUE_KEY)).groupBy(*ISSUE_KEY).agg(F.count("*").alias("n"))
    return per_issue.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("issues")
    )


def dedupe_ratio(rows: DataFrame, by_project: bool = False) -> DataFrame:
    """Events per issue, two decimals."""
    per_issue = dedupe(rows.select("event_id", *ARRIVAL, *ISSUE_KEY)).groupBy(*ISSUE_KEY).agg(F.count("*").alias("n"))
    grouped = per_issue.groupBy("project") if by_project else per_issue.groupBy()
    return grouped.agg(
        F.sum("n").alias("events"),
        F.count("*").alias("issues"),
        F.round(F.sum("n") / F.nullif(F.count("*"), F.lit(0)), 2).alias("dedupe_ratio"),
    )


def window_counts(accepted: DataFrame, issues: DataFrame, now_us: Column, window_us: int) -> DataFrame:
    """Events of every issue received at or after now - window; zero where there are none."""
    recent = (
        accepted.filter(F.col("received_us") >= now_us - F.lit(window_us))
        .groupBy(*ISSUE_KEY)
        .agg(F.count("*").alias("n"))
    )
    return issues.join(recent, ISSUE_KEY, "left").select(
        F.col("id").alias("issue_id"), F.coalesce("n", F.lit(0)).alias("window_count")
    )
