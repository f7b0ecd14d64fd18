"""Table and file sinks: events, issues, alerts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issueforge.schema import ENVELOPE_FIELDS

EVENT_COLUMNS = (
    "event_id", "issue_id", "fingerprint", "project", "level", "timestamp", "received_at", "payload",
)


def payload() -> Column:
    """The whole envelope as JSON, with its nulls and defaults."""
    return F.to_json(F.struct(*ENVELOPE_FIELDS), {"ignoreNullFields": "false"})


def event_rows(resolved: DataFrame, envelope: Column | None = None) -> DataFrame:
    """S2 rows from accepted envelopes that carry fingerprint, issue_id and the arrival columns.

    ``envelope`` is the payload where it is written already; the typed envelope is then not needed.
    """
    return resolved.withColumn("payload", payload() if envelope is None else envelope).select(
        "event_id",
        "issue_id",
        "fingerprint",
        "project",
        "level",
        "timestamp",
        (F.col("received_us") / F.lit(1e6)).alias("received_at"),
        "payload",
        F.date_from_unix_date(F.floor(F.col("received_us") / F.lit(86_400_000_000)).cast("int")).alias("day"),
    )


def append_events(rows: DataFrame, path: str) -> None:
    """Append below project=/day= folders, so that project and time filters prune files.

    The rebalance hint lets AQE gather each folder's rows into files of even size: small folders
    share a task, a hot project's day is split over several.  Rows are sorted by issue and event time
    within a file, so that a lookup by issue skips row groups; event ids have a bloom filter.
    """
    even = rows.hint("rebalance", F.col("project"), F.col("day"))
    (
        even.sortWithinPartitions("project", "day", "issue_id", "timestamp")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#event_id", "true")
        .partitionBy("project", "day")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events with the columns as written (partition values keep their types)."""
    schema = (
        "event_id string, issue_id bigint, fingerprint string, level string, timestamp double, "
        "received_at double, payload string, project string, day date"
    )
    return spark.read.schema(schema).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").json(path)
