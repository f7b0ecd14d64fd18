"""Structured Streaming twins of ingest, dedupe, rollup and alerts.

The stream itself is map-only: it reads envelope lines and validates them.  Each micro-batch goes to
the batch operators; redeliveries are found by a join of its event ids with the table of ids stored
by earlier ones, so no Python runs.  Every table is written under
``<name>/batch=<id>``: a replayed micro-batch overwrites its own folder, so results do not depend
on restarts.  There is no watermark: late event times are never dropped.

The ids of earlier micro-batches are kept in a seen-id index (`seen_index.SeenIndex`): hash buckets
per run, runs merged by size, so a micro-batch opens only the buckets its ids hash to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from issueforge.functions.fingerprint import DEFAULT_RULES, GroupingRules, with_fingerprint
from issueforge.operators import alerts as alert_ops
from issueforge.operators import issues as issue_ops
from issueforge.operators.alerts import EVAL_KEY, AlertRules
from issueforge.plans.slices import arrival_number
from issueforge.sources import envelopes, sinks
from issueforge.streaming.seen_index import SeenIndex

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SNAPSHOT = (
    "project string, fingerprint string, count bigint, first_seen double, last_seen double, level string, "
    "type string, culprit string, title string, sample_event_id string, first_received_us bigint, first_seq bigint"
)
TAIL = "issue_project string, issue_fingerprint string, received_us bigint, seq bigint, accepted boolean"
LAST = "issue_project string, issue_fingerprint string, count bigint, at bigint"
IDS = "project string, fingerprint string, id bigint"
SEEN = "event_id string, issue_project string, issue_fingerprint string"
ALERT = (
    "received_us bigint, seq bigint, rule_order int, rule string, issue_id bigint, project string, "
    "title string, reason string, at double"
)


def streaming_session(spark: SparkSession, state_partitions: int) -> SparkSession:
    """A session of the same application with the settings the streams need."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return session


def envelope_stream(session: SparkSession, source: str, max_files: int) -> DataFrame:
    """Lines as a collector drops them; see `sources.envelopes.read_envelopes` for the format."""
    lines = session.readStream.option("maxFilesPerTrigger", max_files).text(source)
    return envelopes.validated(envelopes.unwrap(lines))


def _put(rows: DataFrame, root: str, name: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def _get(session: SparkSession, root: str, name: str, batch: int, schema: str) -> DataFrame:
    """The snapshot an earlier micro-batch left, or no rows before the first."""
    if batch < 0:
        return session.createDataFrame([], schema)
    return session.read.schema(schema).parquet(f"{root}/{name}/batch={batch}")


def _staged(checked: DataFrame, root: str, batch_id: int, rules: GroupingRules, *more: Column) -> DataFrame:
    """Validated deliveries decoded once and written: NARROW, ``reasons``, ``raw`` of rejected rows and ``more``.

    Every table of the micro-batch reads these flat columns; caching the typed envelopes instead keeps all their
    nested columns and decodes a batch again where it does not fit.
    """
    raw = F.when(F.size("reasons") > 0, F.col("raw")).alias("raw")
    rows = with_fingerprint(checked, rules).select(*issue_ops.NARROW, "reasons", raw, *more)
    _put(rows, root, "checked", batch_id)
    return checked.sparkSession.read.schema(rows.schema).parquet(f"{root}/checked/batch={batch_id}")


def _run(rows: DataFrame, each: Callable[[DataFrame, int], None], root: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def start_ingest(
    session: SparkSession, source: str, root: str, max_files: int, rules: GroupingRules = DEFAULT_RULES
) -> StreamingQuery:
    """ST1: accepted (fingerprinted) and quarantined rows, one folder per micro-batch each."""

    def each(batch: DataFrame, batch_id: int) -> None:
        staged = _staged(batch, root, batch_id, rules)
        _put(envelopes.accepted(staged).select(*issue_ops.NARROW), root, "accepted", batch_id)
        _put(envelopes.quarantined(staged), root, "quarantine", batch_id)

    return _run(envelope_stream(session, source, max_files), each, root)


def seen_index(session: SparkSession, root: str) -> SeenIndex:
    """Event ids stored by micro-batches with their issues."""
    return SeenIndex(session, f"{root}/seen-index", SEEN)


def tagged(batch: DataFrame, root: str, batch_id: int, rules: GroupingRules = DEFAULT_RULES) -> DataFrame:
    """ST2: the valid deliveries of a micro-batch with the issue of the stored event, tagged accepted or not.

    Exact over the whole history.  Writes the tagged rows and the ids they add, and returns the
    written rows.  A replayed micro-batch reads the ids of those before it only.
    """
    narrow = issue_ops.fingerprinted(envelopes.accepted(batch), rules)
    _put(narrow, root, "narrow", batch_id)
    return _tagged(batch.sparkSession.read.schema(narrow.schema).parquet(f"{root}/narrow/batch={batch_id}"), root, batch_id)


def _tagged(narrow: DataFrame, root: str, batch_id: int) -> DataFrame:
    """`tagged` for valid deliveries that are written already with their fingerprints."""
    spark = narrow.sparkSession
    own = issue_ops.attributed(narrow)
    ids = narrow.select("event_id").distinct()
    index = seen_index(spark, root)
    index.compact(batch_id)
    known = index.lookup(ids, batch_id).select(
        "event_id", F.col("issue_project").alias("_project"), F.col("issue_fingerprint").alias("_fingerprint")
    )
    rows = (
        own.join(known, "event_id", "left")
        .withColumns(
            {
                "accepted": F.col("accepted") & F.col("_fingerprint").isNull(),
                "issue_project": F.coalesce("_project", "issue_project"),
                "issue_fingerprint": F.coalesce("_fingerprint", "issue_fingerprint"),
            }
        )
        .drop("_project", "_fingerprint")
    )
    _put(rows, root, "deliveries", batch_id)
    rows = spark.read.schema(rows.schema).parquet(f"{root}/deliveries/batch={batch_id}")
    index.add(rows.filter("accepted").select("event_id", *EVAL_KEY), batch_id)
    return rows


def start_dedupe(session: SparkSession, source: str, root: str, max_files: int) -> StreamingQuery:
    """ST2 with a sink: tagged deliveries per micro-batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        tagged(batch, root, batch_id)

    return _run(envelope_stream(session, source, max_files), each, root)


def _numbered(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Issues after a micro-batch with their ids.  An id never changes: issues that are new in this
    micro-batch are numbered after the largest id so far, in order of first arrival within it."""
    issues = _get(spark, root, "issues", batch_id, SNAPSHOT)
    old = _get(spark, root, "ids", batch_id - 1, IDS)
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = issues.join(old, ["project", "fingerprint"], "left_anti")
    new = arrival_number(fresh, "first_received_us", "first_seq", "id")
    _put(old.unionByName(new.select("project", "fingerprint", (F.col("id") + top).alias("id"))), root, "ids", batch_id)
    return issues.join(_get(spark, root, "ids", batch_id, IDS), ["project", "fingerprint"])


def ingest_batch(
    checked: DataFrame,
    root: str,
    batch_id: int,
    rules: AlertRules | None = None,
    skew_seconds: float = 3600.0,
    store_events: bool = True,
) -> None:
    """Durable ingest of one batch of validated deliveries (`envelopes.validated`) below ``root``.

    Finds redeliveries, merges the issue snapshot, gives new issues their ids and, as asked, appends
    the event and quarantine tables and evaluates the alert rules into alerts and outbox.  Batch ids
    count from 0; every table is written under ``batch=<id>``, so a batch that is given again
    overwrites itself.  What arrives first is decided batch by batch: a delivery of a later batch is
    a redelivery of an earlier one's, whatever their arrival times.
    """
    spark = checked.sparkSession
    if store_events:
        payload = F.when(F.size("reasons") == 0, sinks.payload()).alias("payload")
        staged = _staged(checked, root, batch_id, DEFAULT_RULES, payload)
        stored = envelopes.accepted(staged)
        batch = _tagged(stored.select(*issue_ops.NARROW), root, batch_id)
    else:
        batch = tagged(checked, root, batch_id)
    accepted = batch.filter("accepted")
    before = _get(spark, root, "issues", batch_id - 1, SNAPSHOT)
    _put(issue_ops.merge_partials(before, issue_ops.rollup_partials(accepted)), root, "issues", batch_id)
    issues = _numbered(spark, root, batch_id)
    if store_events:
        # payloads stay where they are while Spark can broadcast the redelivered rows and the issues
        full = stored.join(batch.filter("not accepted").select("seq"), "seq", "left_anti").join(
            issues.select("project", "fingerprint", F.col("id").alias("issue_id")), ["project", "fingerprint"]
        )
        even = sinks.event_rows(full, F.col("payload")).sortWithinPartitions("project", "day", "issue_id", "timestamp")
        even.write.mode("overwrite").partitionBy("project", "day").parquet(f"{root}/events/batch={batch_id}")
        _put(envelopes.quarantined(staged), root, "quarantine", batch_id)
    if rules is not None:
        fired = _fired(batch, root, batch_id, issues, before, rules, int(skew_seconds * 1_000_000))
        if fired is not None:
            _put(fired, root, "alerts", batch_id)
            if rules.target_url:
                _put(alert_ops.outbox(_get(spark, root, "alerts", batch_id, ALERT), rules), root, "outbox", batch_id)


def _fired(
    batch: DataFrame, root: str, batch_id: int, issues: DataFrame, before: DataFrame, rules: AlertRules, skew_us: int
) -> DataFrame | None:
    fresh = issues.join(before.select("project", "fingerprint"), ["project", "fingerprint"], "left_anti")
    fired = alert_ops.new_issue_alerts(fresh) if rules.new_issue else None
    if rules.threshold is None:
        return fired
    spark = batch.sparkSession
    new = batch.select(*EVAL_KEY, "received_us", "seq", "accepted")
    tail = _get(spark, root, "tail", batch_id - 1, TAIL)
    last = _get(spark, root, "last", batch_id - 1, LAST)
    reached = tail.agg(F.max("received_us")).first()[0]
    if reached is not None:
        late = new.filter(F.col("received_us") < reached - skew_us)
        _put(late, root, "late", batch_id)
    counts = alert_ops.rolling_counts_after(new, tail, last, rules.window_us)
    _put(counts, root, "counts", batch_id)
    counts = spark.read.schema(counts.schema).parquet(f"{root}/counts/batch={batch_id}")
    newest = counts.groupBy(*EVAL_KEY).agg(
        F.max_by("window_count", F.struct("received_us", "seq")).alias("count"),
        F.max("received_us").alias("at"),
    )
    merged = _latest(last, newest)
    _put(merged, root, "last", batch_id)
    kept = tail.unionByName(counts.filter("accepted").select(*EVAL_KEY, "received_us", "seq", "accepted"))
    newest_us = kept.agg(F.max("received_us")).first()[0]
    if newest_us is not None:
        kept = kept.filter(F.col("received_us") >= newest_us - rules.window_us - skew_us)
    _put(kept, root, "tail", batch_id)
    crossed = alert_ops.describe_crossings(alert_ops.crossings(counts, rules.threshold), issues, rules)
    return crossed if fired is None else fired.unionByName(crossed)


def start_issues(
    session: SparkSession,
    source: str,
    root: str,
    max_files: int,
    rules: AlertRules | None = None,
    skew_seconds: float = 3600.0,
    store_events: bool = False,
) -> StreamingQuery:
    """ST3 and, with ``rules``, ST4: issue snapshots and alerts, by `ingest_batch` per micro-batch.

    Arrivals up to ``skew_seconds`` before the newest of earlier micro-batches still find the context
    their rolling counts need.  Rows that go further back are counted too, but with what context is
    left, and are written to the table ``late`` as well.

    State tables: the rollup of all issues and their ids, the accepted rows of the last window, and
    the count at each issue's last delivery.  A micro-batch reads the folders of the one before it.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, batch_id, rules, skew_seconds, store_events)

    return _run(envelope_stream(session, source, max_files), each, root)


def _latest(last: DataFrame, newest: DataFrame) -> DataFrame:
    """Counts of this micro-batch replace earlier ones."""
    both = last.withColumn("_age", F.lit(0)).unionByName(newest.withColumn("_age", F.lit(1)))
    return both.groupBy(*EVAL_KEY).agg(
        F.max_by("count", "_age").alias("count"), F.max_by("at", "_age").alias("at")
    )


def read_all(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All micro-batches of an append-only table."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/{name}").drop("batch")


def read_latest(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The newest snapshot; partition pruning reads one folder."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/{name}")
    newest = rows.select(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == newest).drop("batch")
