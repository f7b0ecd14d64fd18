"""Issue queries: filter, sort, page, detail, newest events, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issueforge.plans.slices import running_total
from issueforge.schema import ENVELOPE_TYPE

# ---- fixed values ----------------------------------------------------------------------------
SORTS = ("count", "last_seen", "first_seen")
ORDERS = ("asc", "desc")
DEFAULT_LIMIT, MAX_LIMIT, DETAIL_EVENTS = 100, 1000, 50
OVERVIEW = ("id", "status", "count", "level", "project", "title", "culprit")
# ---- end of fixed values ---------------------------------------------------------------------
DRIVER_ROWS = 100_000  # deepest page kept as a top-k on the driver side of the plan


def filter_issues(issues: DataFrame, project: str = "", level: str = "", status: str = "") -> DataFrame:
    """Q1: equality filters; an empty value means no filter."""
    for column, wanted in (("project", project), ("level", level), ("status", status)):
        if wanted:
            issues = issues.filter(F.col(column) == wanted)
    return issues


def sort_keys(sort: str = "last_seen", order: str = "desc", strict: bool = False) -> list[Column]:
    """Q2: the sort column and an id tiebreak.

    Lenient callers get last_seen for unknown sorts and descending for any order but ``asc``; the
    strict (public) form rejects both.
    """
    if strict and (sort not in SORTS or order not in ORDERS):
        raise ValueError(f"sort must be one of {SORTS} and order one of {ORDERS}")
    column = F.col(sort if sort in SORTS else "last_seen")
    return [column.asc() if order.lower() == "asc" else column.desc(), F.col("id").asc()]


def sort_issues(issues: DataFrame, sort: str = "last_seen", order: str = "desc", strict: bool = False) -> DataFrame:
    return issues.orderBy(*sort_keys(sort, order, strict))


def page(
    issues: DataFrame, sort: str = "last_seen", order: str = "desc", limit: int = DEFAULT_LIMIT, offset: int = 0
) -> DataFrame:
    """Q3: one page with the number of rows returned in ``page_rows``.

    Shallow pages plan as a top-k.  A page deeper than DRIVER_ROWS would make that top-k hold
    offset+limit rows, so there the rows are ranked in slices of the sort column instead.
    """
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_LIMIT} and offset >= 0")
    keys = sort_keys(sort, order, strict=True)
    if offset <= DRIVER_ROWS:
        rows = issues.orderBy(*keys).offset(offset).limit(limit)
    else:
        rows = _deep_page(issues, sort, order, limit, offset).orderBy(*keys)
    return rows.withColumn("page_rows", F.count("*").over(Window.partitionBy(F.lit(1))))


def _deep_page(issues: DataFrame, sort: str, order: str, limit: int, offset: int) -> DataFrame:
    sign = 1 if order == "asc" else -1
    width = 1 if sort == "count" else 60
    ranked = running_total(
        issues.select("id", (F.col(sort) * sign).alias("_key"), F.lit(0).alias("_one_table"))
        .withColumn("_row", F.lit(1).cast("bigint")),
        ["_one_table"], ["_key", "id"], "_row", width, "_rank",
    )
    wanted = ranked.filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)).select("id")
    return issues.join(wanted, "id", "left_semi")


def issue_by_id(issues: DataFrame, issue_id: int) -> DataFrame:
    """Q4: one row or none."""
    return issues.filter(F.col("id") == issue_id)


def newest_events(events: DataFrame, key: list[str], limit: int = DETAIL_EVENTS) -> DataFrame:
    """Q5: the newest events of every issue.

    The rank filter is pushed below the shuffle (window group limit), so a map task sends at most
    ``limit`` rows per issue however hot it is.
    """
    newest = Window.partitionBy(*key).orderBy(F.col("timestamp").desc(), F.col("event_id"))
    return events.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)


def issue_detail(issues: DataFrame, events: DataFrame, issue_id: int | None = None) -> DataFrame:
    """Issues with their newest events; for one issue the id filter reaches both scans."""
    if issue_id is not None:
        issues = issue_by_id(issues, issue_id)
        events = events.filter(F.col("issue_id") == issue_id)
    newest = newest_events(events, ["issue_id"]).select("issue_id", "position", "event_id", "timestamp", "payload")
    return issues.join(newest, issues["id"] == newest["issue_id"]).drop("issue_id")


def decode_payload(events: DataFrame) -> DataFrame:
    """Q6: stored JSON back to the typed document."""
    return events.withColumn("envelope", F.from_json("payload", ENVELOPE_TYPE))


def overview(issues: DataFrame) -> DataFrame:
    """Q7: the 100 most recently seen issues."""
    return issues.orderBy(*sort_keys()).limit(DEFAULT_LIMIT).select(*OVERVIEW)
