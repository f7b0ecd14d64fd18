"""Alert rules as set operations: new issue, rolling-window threshold crossing, outbox."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issueforge.plans.slices import DEFAULT_SLICE_US, MICROS, SEQ_BLOCK, SLICE_ROWS, equi_depth_slices

# ---- fixed values ----------------------------------------------------------------------------
NEW_ISSUE, THRESHOLD = "new_issue", "threshold"
NEW_ISSUE_REASON = "first occurrence of this fingerprint"
OFF_WORDS = ("", "0", "off", "none")
# ---- end of fixed values ---------------------------------------------------------------------
RULE_ORDER = {NEW_ISSUE: 1, THRESHOLD: 2}
EVAL_KEY = ["issue_project", "issue_fingerprint"]


@dataclass(frozen=True)
class AlertRules:
    new_issue: bool = True
    threshold: int | None = 10
    window_seconds: float = 60.0
    target_url: str | None = None

    @property
    def window_us(self) -> int:
        return round(self.window_seconds * MICROS)

    @classmethod
    def from_options(cls, options: dict[str, str]) -> AlertRules:
        """Text options: ``new_issue``, ``threshold``, ``window``, ``url``."""
        threshold = options.get("threshold", "10").strip()
        return cls(
            new_issue=options.get("new_issue", "1") not in ("0", "false"),
            threshold=None if threshold.lower() in OFF_WORDS else int(threshold),
            window_seconds=float(options.get("window", "60")),
            target_url=options.get("url") or None,
        )


def rolling_counts(
    evals: DataFrame,
    window_us: int,
    slice_us: int = DEFAULT_SLICE_US,
    prior: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
    seq_block: int = SEQ_BLOCK,
) -> DataFrame:
    """A2: the issue's accepted events in the trailing window, at every delivery.

    ``evals`` has EVAL_KEY, received_us, seq and accepted; the result adds ``window_count`` and
    ``previous_count`` (the count at the issue's previous delivery, NULL at its first).

    Every accepted event is a +1 at its arrival and a -1 just after arrival + window; the count is
    the running sum of both.  The running sum is cut into slices of equal depth
    (`plans.slices.equi_depth_slices`: at most ``slice_rows`` + ``seq_block`` points, cut by seq
    inside one microsecond, histogram bins ``slice_us`` wide), so neither a hot issue, nor a
    burst in one microsecond, nor a long window gathers in one task.
    ``prior`` (EVAL_KEY, count) gives the last count of issues evaluated in earlier batches, and
    rows flagged ``_context`` are counted but not evaluated.
    """
    if "_context" not in evals.columns:
        evals = evals.withColumn("_context", F.lit(False))
    arrival = F.struct(
        F.col("received_us").alias("_t"),
        F.lit(0).alias("_leaves"),
        F.col("accepted").cast("bigint").alias("_delta"),
        F.col("_context"),
    )
    expiry = F.struct(
        (F.col("received_us") + F.lit(window_us)).alias("_t"),
        F.lit(1).alias("_leaves"),
        F.lit(-1).cast("bigint").alias("_delta"),
        F.lit(True).alias("_context"),
    )
    both = F.when(F.col("accepted"), F.array(arrival, expiry)).otherwise(F.array(arrival))
    points = evals.select(*EVAL_KEY, "seq", F.explode_outer(both).alias("_p")).select(*EVAL_KEY, "seq", "_p.*")
    order = ["_t", "_leaves", "seq"]
    points = equi_depth_slices(points, EVAL_KEY, ["_t", "_leaves", "seq"], slice_us, slice_rows, seq_block)
    inside = Window.partitionBy(*EVAL_KEY, "_slice").orderBy(*order)
    own = points.withColumn("_own", F.sum("_delta").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    is_arrival = ~F.col("_context")
    local = own.withColumn(
        "_own_previous",
        F.last(F.when(is_arrival, F.col("_own")), ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, -1)
        ),
    )
    # One row per slice: what it adds, and the count at its last delivery.  Computed where the
    # window left the rows, so the points are not shuffled again.
    ends = local.groupBy(*EVAL_KEY, "_slice").agg(
        F.max_by("_own", F.struct(*order)).alias("_adds"),
        F.max_by(F.when(is_arrival, F.col("_own")), F.when(is_arrival, F.struct(*order))).alias("_last_own"),
    )
    earlier = Window.partitionBy(*EVAL_KEY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.withColumn("_before", F.coalesce(F.sum("_adds").over(earlier), F.lit(0)))
        .withColumn(
            "_before_previous",
            F.last(F.col("_last_own") + F.col("_before"), ignorenulls=True).over(earlier),
        )
        .select(*EVAL_KEY, "_slice", "_before", "_before_previous")
    )
    if prior is not None:
        carried = (
            carried.join(prior.withColumnRenamed("count", "_prior"), EVAL_KEY, "left")
            .withColumn("_before_previous", F.coalesce("_before_previous", "_prior"))
            .drop("_prior")
        )
    return (
        local.filter(is_arrival)
        .join(carried, [*EVAL_KEY, "_slice"])
        .select(
            *EVAL_KEY,
            F.col("_t").alias("received_us"),
            "seq",
            (F.col("_delta") == 1).alias("accepted"),
            (F.col("_own") + F.col("_before")).alias("window_count"),
            F.coalesce(F.col("_own_previous") + F.col("_before"), "_before_previous").alias("previous_count"),
        )
    )


def crossings(counts: DataFrame, threshold: int) -> DataFrame:
    """A3: deliveries that fire.  After any evaluation the rule is armed exactly when count < N."""
    return counts.filter(
        (F.col("window_count") >= threshold)
        & (F.col("previous_count").isNull() | (F.col("previous_count") < threshold))
    )


def new_issue_alerts(issues: DataFrame) -> DataFrame:
    """A1: one alert per issue, on the delivery that created it."""
    return issues.select(
        F.col("first_received_us").alias("received_us"),
        F.col("first_seq").alias("seq"),
        F.lit(RULE_ORDER[NEW_ISSUE]).alias("rule_order"),
        F.lit(NEW_ISSUE).alias("rule"),
        F.col("id").alias("issue_id"),
        "project",
        "title",
        F.lit(NEW_ISSUE_REASON).alias("reason"),
        (F.col("first_received_us") / F.lit(1e6)).alias("at"),
    )


def rolling_counts_after(new: DataFrame, tail: DataFrame, last: DataFrame, window_us: int) -> DataFrame:
    """A2 for a later batch: ``tail`` holds the accepted rows that may still be in a window, ``last``
    (EVAL_KEY, count) the count at every issue's latest delivery.

    Tail rows only contribute; they are not evaluated again.
    """
    context = tail.withColumn("_context", F.lit(True))
    return rolling_counts(
        context.unionByName(new.withColumn("_context", F.lit(False))), window_us, prior=last.select(*EVAL_KEY, "count")
    )


def describe_crossings(fired: DataFrame, issues: DataFrame, rules: AlertRules) -> DataFrame:
    """Crossings with the issue's id and title and the reason text."""
    issue = issues.select(
        F.col("project").alias("issue_project"), F.col("fingerprint").alias("issue_fingerprint"),
        F.col("id").alias("issue_id"), "project", "title",
    )
    return fired.join(issue, EVAL_KEY).select(
        "received_us",
        "seq",
        F.lit(RULE_ORDER[THRESHOLD]).alias("rule_order"),
        F.lit(THRESHOLD).alias("rule"),
        "issue_id",
        "project",
        "title",
        F.concat(
            F.col("window_count").cast("string"),
            F.lit(f" events in {int(rules.window_seconds)}s (>= {rules.threshold})"),
        ).alias("reason"),
        (F.col("received_us") / F.lit(1e6)).alias("at"),
    )


def threshold_alerts(evals: DataFrame, issues: DataFrame, rules: AlertRules) -> DataFrame:
    """A3.  Only fired rows reach the join with the issues."""
    return describe_crossings(
        crossings(rolling_counts(evals, rules.window_us), rules.threshold), issues, rules
    )


def alerts(evals: DataFrame, issues: DataFrame, rules: AlertRules) -> DataFrame:
    """A4, unsorted: all alerts of both rules with their firing position."""
    parts = []
    if rules.new_issue:
        parts.append(new_issue_alerts(issues))
    if rules.threshold is not None:
        parts.append(threshold_alerts(evals, issues, rules))
    if not parts:
        return new_issue_alerts(issues).limit(0)
    feed = parts[0]
    for part in parts[1:]:
        feed = feed.unionByName(part)
    return feed


def firing_order(feed: DataFrame) -> DataFrame:
    """A4: a range-partitioned sort by arrival, new-issue before threshold."""
    return feed.orderBy("received_us", "seq", "rule_order")


def outbox(feed: DataFrame, rules: AlertRules) -> DataFrame:
    """One (url, payload) row per alert where a target is configured, else only the record."""
    return feed.select(
        "received_us",
        "seq",
        "rule_order",
        F.lit(rules.target_url).cast("string").alias("url"),
        F.to_json(F.struct("rule", "issue_id", "project", "title", "reason", "at")).alias("payload"),
    )
