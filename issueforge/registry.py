"""The registered queries: every operator over the given tables.

Each query takes (spark, sf_dir) and returns a DataFrame with flat, named columns.  Queries that
need error events run on deliveries derived from the whole ``events`` table (`sources.derived`).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from issueforge.functions import fingerprint as fp
from issueforge.functions import sql as sql_functions
from issueforge.functions import stack as stack_functions
from issueforge.functions import text
from issueforge.operators import alerts, browse, evaluate, issues, metrics, rawlogs
from issueforge.operators.alerts import AlertRules
from issueforge.schema import ENVELOPE_FIELDS
from issueforge.session import materialize, scratch_path
from issueforge.sources import derived, envelopes, sinks
from issueforge.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALERT_RULES = AlertRules(threshold=8, window_seconds=86_400.0, target_url="http://sink/hook")
CUSTOM_RULES = fp.GroupingRules(in_app_exclude=("src/server/",), in_app_include=("express",))
CRUMBS_KEPT = 5


def query(function: Query) -> Query:
    """Register; counts and positions leave as BIGINT like those of any SQL engine."""

    @functools.wraps(function)
    def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        result = function(spark, sf_dir)
        small = [f.name for f in result.schema if isinstance(f.dataType, IntegerType)]
        return result.withColumns({name: F.col(name).cast("bigint") for name in small})

    QUERIES[function.__name__] = widened
    return function


# ---- shared inputs -----------------------------------------------------------------------------


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    return issues.fingerprinted(derived.deliveries(spark, sf))


def narrow_once(spark: SparkSession, sf: str) -> DataFrame:
    """For queries whose plan reads the fingerprints on more than one branch."""
    return materialize(narrow(spark, sf), "fingerprinted")


def json_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """The deliveries as JSON text, some of them broken: seq, received_us, raw."""
    rows = derived.deliveries(spark, sf)
    broken = F.col("seq") % 29
    kept = {
        "event_id": F.when(broken == 1, F.lit("not-hex")).otherwise(F.col("event_id")),
        "level": F.when(broken == 2, F.lit("explode")).otherwise(F.col("level")),
        "timestamp": F.when(broken == 3, F.lit(0.0)).otherwise(F.col("timestamp")),
        "message": F.when(broken != 4, F.col("message")),
        "exception": F.when(broken != 4, F.col("exception")),
    }
    whole = rows.withColumns(kept)
    # absent keys: platform, tags and extra are left to their defaults on every third row
    lean = F.to_json(
        F.struct(
            "event_id", "timestamp", "level",
            F.when(broken != 7, F.col("project")).alias("project"),
            "release", "transaction", "message", "exception",
        )
    )
    full = F.to_json(F.struct(*ENVELOPE_FIELDS), {"ignoreNullFields": "false"})
    body = F.when(F.col("seq") % 3 == 0, lean).otherwise(full)
    body = (
        F.when(broken == 5, F.regexp_replace(body, '"project":"[^"]*"', '"project":null'))
        .when(broken == 6, F.left(body, F.length(body) - 1))
        .when(broken == 8, F.regexp_replace(body, '"release":"[^"]*"', '"release":7'))
        .otherwise(body)
    )
    return whole.select("seq", "received_us", body.alias("raw"))


def checked(spark: SparkSession, sf: str) -> DataFrame:
    return envelopes.validated(json_deliveries(spark, sf))


def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One change per row of ``events``; some name unknown issues or statuses."""
    k = F.col("k")
    return derived.events_base(spark, sf).select(
        (F.col("user_id") % 60 + 1).alias("issue_id"),
        F.when(k % 5 == 0, "resolved")
        .when(k % 5 == 1, "ignored")
        .when(k % 5 == 2, "unresolved")
        .when(k % 5 == 3, "resolved")
        .otherwise("closed")
        .alias("status"),
        F.col("seq").alias("change_seq"),
    )


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Issues with their current status."""
    return issues.with_status(issues.issues_of(narrow(spark, sf)), status_changes(spark, sf))


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted envelopes with issue id, as event rows."""
    full = materialize(fp.with_fingerprint(issues.drop_redelivered(derived.deliveries(spark, sf))), "accepted")
    numbered = issues.number_issues(issues.rollup_partials(full.select(*issues.NARROW)))
    resolved = issues.with_issue(full, numbered, "project", "fingerprint", F.col("id").alias("issue_id"))
    return sinks.event_rows(resolved)


def raw_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw error rows with V8 stack text, newest call first."""
    base = derived.events_base(spark, sf)
    user, k, kind = F.col("user_id"), F.col("k"), F.col("event_type")
    root = F.concat(F.lit("/srv/b"), (user % 5).cast("string"))

    def line(function: Column, place: Column) -> Column:
        spot = F.concat(place, F.lit(":"), (user + 1).cast("string"), F.lit(":"), (k + 1).cast("string"))
        return F.when(function == "", F.concat(F.lit("    at "), spot)).otherwise(
            F.concat(F.lit("    at "), function, F.lit(" ("), spot, F.lit(")"))
        )

    fn = F.concat(F.when(k % 2 == 0, "async ").otherwise(""), F.lit("work"), (k % 4).cast("string"))
    stack = F.concat_ws(
        "\n",
        F.concat(F.lit("E: saw item"), k.cast("string")),
        line(F.lit("next"), F.concat(F.lit("/h/node_modules/express@4."), (k % 3).cast("string"), F.lit(".0/lib/router.js"))),
        line(fn, F.concat(F.when(k % 3 == 0, "file://").otherwise(""), root, F.lit("/src/lib/m"), (k % 4).cast("string"), F.lit(".js"))),
        line(F.when(k % 5 == 0, "").otherwise("Object.<anonymous>"), F.concat(root, F.lit("2/boot.js"))),
        line(F.lit("handle"), F.lit("src/server/handler.js")),
        F.lit("    at native code"),
        line(F.lit("processTicksAndRejections"), F.lit("node:internal/process/task_queues")),
    )
    is_message = kind.isin("view", "click")
    return base.select(
        F.concat(F.lit("c"), (user % 7).cast("string")).alias("client"),
        F.when(kind == "error", "captured")
        .when(kind == "purchase", "uncaught")
        .when(kind == "signup", "unhandled")
        .otherwise("message")
        .alias("kind"),
        F.when(~is_message, F.when(k % 4 == 0, "").otherwise("TypeError")).alias("name"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(kind, F.lit(" saw item"), k.cast("string"))).alias("message"),
        F.when(~is_message & (k % 7 != 0), stack).alias("stack"),
        F.concat(root, F.when(k % 2 == 0, "/").otherwise("")).alias("app_root"),
        F.when(k % 13 == 0, "warning").alias("level"),
        F.when(user % 2 == 0, F.concat(F.lit("p"), (user % 3).cast("string"))).alias("project"),
        F.lit("app@1.0.0").alias("release"),
        F.lit("test").alias("environment"),
        F.lit(None).cast("string").alias("server_name"),
        F.create_map(F.lit("runtime"), F.lit("node20")).alias("tags"),
        "seq",
        "received_us",
    )


def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth against fingerprints, per stored project."""
    rows = fp.with_fingerprint(derived.deliveries(spark, sf))
    return rows.select("true_label", F.col("fingerprint").alias("pred_label"))


def source_lang(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "documents").select(
        F.col("source").alias("true_label"), F.col("lang").alias("pred_label")
    )


def json_array(column: Column) -> Column:
    return F.array_join(column, "\n")


def each_frame(rows: DataFrame, frames: Column) -> DataFrame:
    """seq, position, f.  The outer form keeps the optimizer from adding a "has elements" filter
    below, which would compute the array a second time.
    """
    return rows.select("seq", F.posexplode_outer(frames).alias("position", "f")).filter("position IS NOT NULL")


# ---- sources, sinks ------------------------------------------------------------------------------


@query
def envelope_source(spark: SparkSession, sf: str) -> DataFrame:
    """Written as collector lines, read back, parsed and typed."""
    path = scratch_path(spark, "lines")
    record = F.to_json(F.struct("seq", "received_us", F.col("raw").alias("body")))
    json_deliveries(spark, sf).select(record.alias("value")).write.text(path)
    rows = envelopes.accepted(envelopes.validated(envelopes.read_envelopes(spark, path)))
    exc = fp.picked_exception(F.col("exception"))
    return rows.select(
        "seq", "event_id", "timestamp", "platform", "level", "project", "release", "message",
        exc["type"].alias("exc_type"),
        exc["value"].alias("exc_value"),
        F.coalesce(F.size(exc["stacktrace"]["frames"]), F.lit(0)).alias("frames"),
        F.try_variant_get("extra", "$.k", "bigint").alias("extra_k"),
        F.try_element_at("tags", F.lit("user")).alias("tag_user"),
    )


@query
def event_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Appended by project and day, then read back."""
    path = scratch_path(spark, "events")
    sinks.append_events(stored_events(spark, sf), path)
    back = sinks.read_events(spark, path)
    return back.select(
        "event_id", "issue_id", "fingerprint", "project", "level", "timestamp", "received_at",
        F.get_json_object("payload", "$.message").alias("message"),
        F.get_json_object("payload", "$.exception.values[0].type").alias("exc_type"),
        F.date_format("day", "yyyy-MM-dd").alias("day"),
    )


@query
def issue_detail_one(spark: SparkSession, sf: str) -> DataFrame:
    """J3 for one issue, from the event table as it is stored."""
    path = scratch_path(spark, "events")
    sinks.append_events(stored_events(spark, sf), path)
    detail = browse.issue_detail(listed(spark, sf), sinks.read_events(spark, path), issue_id=1)
    return detail.select("id", "title", "position", "event_id", "timestamp", F.get_json_object("payload", "$.message").alias("message"))


@query
def issue_upsert_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """S3: four arrival batches merged one after another into the issue snapshot."""
    rows = narrow_once(spark, sf)
    low, high = rows.agg(F.min("received_us"), F.max("received_us")).first()
    batches = 4
    width = (high - low) // batches + 1
    snapshot, stored = None, None
    for i in range(batches):
        batch = rows.filter(
            (F.col("received_us") >= low + i * width) & (F.col("received_us") < low + (i + 1) * width)
        )
        fresh = issues.dedupe(batch) if stored is None else issues.unseen(batch, stored)
        fresh = materialize(fresh, "fresh")
        partials = issues.rollup_partials(fresh)
        snapshot = partials if snapshot is None else issues.merge_partials(snapshot, partials)
        snapshot = materialize(snapshot, "snapshot")
        stored = fresh.select("event_id") if stored is None else stored.unionByName(fresh.select("event_id"))
    return snapshot


def _alert_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = narrow_once(spark, sf)
    return issues.attributed(rows.select("event_id", "seq", "received_us", "project", "fingerprint")), issues.issues_of(rows)


@query
def alert_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """S4"""
    evals, numbered = _alert_inputs(spark, sf)
    rows = alerts.outbox(alerts.alerts(evals, numbered, ALERT_RULES), ALERT_RULES)
    decoded = F.from_json("payload", "rule string, issue_id bigint, project string, title string, reason string, at double")
    return rows.withColumn("p", decoded).select("received_us", "seq", "rule_order", "url", "p.*")


# ---- validation ----------------------------------------------------------------------------------


def _judged(rows: DataFrame, valid: Column) -> DataFrame:
    """Every delivery; text that is no JSON object is not valid."""
    return rows.select("seq", F.when(F.col("_is_object"), valid).otherwise(F.lit(False)).alias("valid"))


@query
def envelope_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """V1"""
    rows = envelopes.parsed(json_deliveries(spark, sf))
    return rows.select(
        "seq",
        *(
            F.when(F.col("_is_object"), value).alias(name)
            for name, value in {
                "platform": F.col("platform"), "level": F.col("level"), "project": F.col("project"), "tags": F.size("tags"),
                "breadcrumbs": F.size("breadcrumbs"), "extra": F.to_json("extra"),
            }.items()
        ),
    )


@query
def validate_event_id(spark: SparkSession, sf: str) -> DataFrame:
    """V2"""
    rows = envelopes.parsed(json_deliveries(spark, sf))
    return _judged(rows, envelopes.valid_event_id(F.col("event_id")))


@query
def validate_level(spark: SparkSession, sf: str) -> DataFrame:
    """V3"""
    rows = envelopes.parsed(json_deliveries(spark, sf))
    return _judged(rows, envelopes.valid_level(F.col("level")))


@query
def validate_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """V4"""
    rows = envelopes.parsed(json_deliveries(spark, sf))
    return _judged(rows, envelopes.valid_timestamp(F.col("timestamp")))


@query
def validate_payload(spark: SparkSession, sf: str) -> DataFrame:
    """V5"""
    rows = envelopes.parsed(json_deliveries(spark, sf))
    return _judged(rows, envelopes.has_payload(F.col("exception"), F.col("message")))


@query
def validate_types(spark: SparkSession, sf: str) -> DataFrame:
    """V6: the names of the badly typed fields of every document."""
    rows = envelopes.parsed(json_deliveries(spark, sf))
    wrong = F.when(F.col("_is_object"), F.array_join("_wrong", ",")).otherwise(F.lit("json"))
    return rows.select("seq", wrong.alias("wrong"))


@query
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    """V7"""
    return envelopes.validation_report(checked(spark, sf))


# ---- projections, scalar functions -----------------------------------------------------------------


@query
def issue_title(spark: SparkSession, sf: str) -> DataFrame:
    """P3"""
    return fp.with_fingerprint(derived.deliveries(spark, sf)).select("seq", "type", "title")


@query
def culprit(spark: SparkSession, sf: str) -> DataFrame:
    """P4"""
    return fp.with_fingerprint(derived.deliveries(spark, sf)).select("seq", "culprit")


@query
def frame_in_app(spark: SparkSession, sf: str) -> DataFrame:
    """P5: the decision for every frame."""
    frames = each_frame(fp.with_signatures(derived.deliveries(spark, sf)), F.col("_signatures"))
    return frames.select("seq", "position", fp.in_app(F.col("f.flag"), F.col("f.module")).alias("in_app"))


@query
def select_frames(spark: SparkSession, sf: str) -> DataFrame:
    """P6"""
    rows = fp.with_signatures(derived.deliveries(spark, sf), CUSTOM_RULES)
    return rows.select("seq", json_array(F.transform("_selected", lambda f: f["module"])).alias("modules"))


@query
def frame_signature(spark: SparkSession, sf: str) -> DataFrame:
    """P7"""
    rows = fp.with_signatures(derived.deliveries(spark, sf))
    return each_frame(rows, F.col("_signatures")).select(
        "seq", "position", F.concat(F.col("f.module"), F.lit(":"), F.col("f.function")).alias("signature")
    )


@query
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """P8"""
    return fp.with_fingerprint(derived.deliveries(spark, sf)).select(
        "seq", "fingerprint", "kind", json_array(F.col("components")).alias("components")
    )


@query
def fingerprint_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries and distinct fingerprints by kind."""
    rows = fp.with_fingerprint(derived.deliveries(spark, sf)).select("kind", "fingerprint")
    per = rows.groupBy("kind", "fingerprint").agg(F.count("*").alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("deliveries"), F.count("*").alias("fingerprints"))


@query
def fingerprint_custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P9"""
    return fp.with_fingerprint(derived.deliveries(spark, sf), CUSTOM_RULES).select("seq", "fingerprint", "culprit")


@query
def normalize_message(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over whole documents and conversation turns."""
    documents = derived.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text"
    )
    turns = derived.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("key"), "text"
    )
    return documents.unionByName(turns).select("key", text.normalize_message(F.col("text")).alias("normalized"))


@query
def normalize_function(spark: SparkSession, sf: str) -> DataFrame:
    """F2 over names derived from every part of speech of the events."""
    base = derived.events_base(spark, sf)
    k = F.col("k")
    name = (
        F.when(k % 10 == 0, F.lit(None).cast("string"))
        .when(k % 10 == 1, "")
        .when(k % 10 == 2, " eval ")
        .when(k % 10 == 3, F.concat(F.lit("Object"), k.cast("string"), F.lit(".<anonymous>")))
        .when(k % 10 == 4, "async eval")
        .when(k % 10 == 5, " \t ")
        .when(k % 10 == 6, "?")
        .when(k % 10 == 7, F.concat(F.lit("\u00a0async run"), F.col("user_id").cast("string"), F.lit("\n")))
        .otherwise(F.concat(F.col("event_type"), k.cast("string")))
    )
    return base.select("seq", text.normalize_function(name).alias("normalized"))


@query
def normalize_module(spark: SparkSession, sf: str) -> DataFrame:
    """F3 over page URLs and all derived frame paths."""
    urls = derived.table(spark, sf, "pages").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("key"), F.col("url").alias("path")
    )
    frames = each_frame(derived.deliveries(spark, sf), fp.picked_exception(F.col("exception"))["stacktrace"]["frames"])
    paths = frames.select(
        F.concat(F.lit("frame"), F.col("seq").cast("string"), F.lit("/"), F.col("position").cast("string")).alias("key"),
        F.col("f.filename").alias("path"),
    )
    return urls.unionByName(paths).select("key", text.normalize_module(F.col("path")).alias("normalized"))


@query
def sql_normalize_message(spark: SparkSession, sf: str) -> DataFrame:
    """the SQL functions over documents: texts, sources, and module paths built from source and language."""
    sql_functions.register(spark)
    documents = derived.table(spark, sf, "documents")
    return documents.selectExpr(
        "doc_id",
        "normalize_message(text) AS message",
        "normalize_function(source) AS function",
        "normalize_module(concat('/srv/src/', source, '/', lang, '.js?v=', doc_id)) AS module",
        "fingerprint_of(array('message:', normalize_message(text))) AS digest",
    )


# ---- joins, dedupe, rollup ---------------------------------------------------------------------------


@query
def new_events_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """The second half of the arrivals against the stored first half."""
    rows = narrow_once(spark, sf)
    middle = rows.agg(F.floor((F.min("received_us") + F.max("received_us")) / 2)).first()[0]
    stored = rows.filter(F.col("received_us") < middle).select("event_id")
    fresh = issues.unseen(rows.filter(F.col("received_us") >= middle), stored)
    return fresh.select("event_id", "seq", "project", "fingerprint")


@query
def events_with_issue(spark: SparkSession, sf: str) -> DataFrame:
    """J2"""
    accepted = materialize(issues.dedupe(narrow(spark, sf)), "accepted")
    numbered = issues.number_issues(issues.rollup_partials(accepted))
    joined = issues.with_issue(accepted, numbered, "project", "fingerprint", F.col("id").alias("issue_id"), F.col("count").alias("issue_count"))
    return joined.select("seq", "event_id", "project", "fingerprint", "issue_id", "issue_count")


@query
def issue_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Every issue with its 50 newest events."""
    events = materialize(stored_events(spark, sf), "events")
    detail = browse.issue_detail(listed(spark, sf), events)
    return detail.select(
        "id", "title", "status", "count", "position", "event_id", "timestamp",
        F.get_json_object("payload", "$.message").alias("message"),
    )


@query
def issue_status(spark: SparkSession, sf: str) -> DataFrame:
    """J4"""
    return listed(spark, sf).select("id", "project", "fingerprint", "status")


@query
def status_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that name no known issue or no known status."""
    return issues.status_changes_checked(status_changes(spark, sf), issues.issues_of(narrow(spark, sf)))[1]


@query
def dedupe_events(spark: SparkSession, sf: str) -> DataFrame:
    """D1"""
    return issues.dedupe(narrow(spark, sf))


@query
def dedupe_wide(spark: SparkSession, sf: str) -> DataFrame:
    """D1 for payload-carrying rows, by anti join on the redelivered offsets."""
    kept = issues.drop_redelivered(derived.deliveries(spark, sf))
    return kept.select("seq", "event_id", "project", "level", sinks.payload().alias("payload")).select(
        "seq", "event_id", "project", "level", F.get_json_object("payload", "$.message").alias("message")
    )


@query
def issue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """D2"""
    return issues.rollup_partials(issues.dedupe(narrow(spark, sf)))


@query
def issue_ids(spark: SparkSession, sf: str) -> DataFrame:
    """D3"""
    return issues.issues_of(narrow(spark, sf)).select("id", "project", "fingerprint", "sample_event_id")


@query
def store_counts(spark: SparkSession, sf: str) -> DataFrame:
    """D4"""
    return issues.store_counts(narrow(spark, sf))


@query
def dedupe_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """D5, overall and per project."""
    rows = narrow_once(spark, sf)
    overall = issues.dedupe_ratio(rows).withColumn("project", F.lit("*"))
    return issues.dedupe_ratio(rows, by_project=True).unionByName(overall)


@query
def window_count_asof(spark: SparkSession, sf: str) -> DataFrame:
    """D6 at one day before the last arrival."""
    accepted = materialize(issues.dedupe(narrow(spark, sf)), "accepted")
    numbered = issues.number_issues(issues.rollup_partials(accepted))
    now = accepted.agg(F.max("received_us")).first()[0]
    return issues.window_counts(accepted, numbered, F.lit(now), ALERT_RULES.window_us)


@query
def delivery_results(spark: SparkSession, sf: str) -> DataFrame:
    """D7"""
    evals, numbered = _alert_inputs(spark, sf)
    evals, numbered = materialize(evals, "evals"), materialize(numbered, "issues")
    return issues.delivery_results(evals, numbered, alerts.alerts(evals, numbered, ALERT_RULES))


# ---- alerts ------------------------------------------------------------------------------------------


@query
def alerts_new_issue(spark: SparkSession, sf: str) -> DataFrame:
    """A1"""
    return alerts.new_issue_alerts(issues.issues_of(narrow(spark, sf)))


@query
def rolling_issue_count(spark: SparkSession, sf: str) -> DataFrame:
    """A2"""
    rows = narrow_once(spark, sf).select("event_id", "seq", "received_us", "project", "fingerprint")
    return alerts.rolling_counts(issues.attributed(rows), ALERT_RULES.window_us).select(
        "issue_project", "issue_fingerprint", "seq", "accepted", "window_count", "previous_count"
    )


@query
def alerts_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """A3"""
    evals, numbered = _alert_inputs(spark, sf)
    return alerts.threshold_alerts(evals, numbered, ALERT_RULES)


@query
def alert_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A4"""
    evals, numbered = _alert_inputs(spark, sf)
    return alerts.firing_order(alerts.alerts(evals, numbered, ALERT_RULES))


@query
def alerts_threshold_off(spark: SparkSession, sf: str) -> DataFrame:
    """A5"""
    evals, numbered = _alert_inputs(spark, sf)
    off = AlertRules.from_options({"threshold": " OFF ", "window": "60"})
    return alerts.firing_order(alerts.alerts(evals, numbered, off))


# ---- issue queries -------------------------------------------------------------------------------------


@query
def issues_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Q1"""
    return browse.filter_issues(listed(spark, sf), project="p1", level="error", status="resolved")


@query
def issues_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Q2"""
    return browse.sort_issues(listed(spark, sf), "count", "desc", strict=True)


@query
def issues_page(spark: SparkSession, sf: str) -> DataFrame:
    """Q3"""
    return browse.page(listed(spark, sf), "first_seen", "asc", limit=10, offset=5)


@query
def issue_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Q4"""
    return browse.issue_by_id(listed(spark, sf), 7)


@query
def issue_recent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: the 50 newest events of every issue."""
    accepted = issues.dedupe(narrow(spark, sf))
    return browse.newest_events(accepted, ["project", "fingerprint"]).select(
        "project", "fingerprint", "position", "event_id", "timestamp"
    )


@query
def payload_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Q6"""
    rows = browse.decode_payload(derived.deliveries(spark, sf).withColumn("payload", sinks.payload()).select("seq", "payload"))
    e = F.col("envelope")
    exc = fp.picked_exception(e["exception"])
    return rows.select(
        "seq",
        e["event_id"].alias("event_id"),
        e["timestamp"].alias("timestamp"),
        e["level"].alias("level"),
        e["message"].alias("message"),
        exc["value"].alias("exc_value"),
        F.try_element_at(exc["stacktrace"]["frames"], F.lit(-1))["lineno"].alias("top_line"),
        F.try_element_at(e["tags"], F.lit("user")).alias("tag_user"),
        F.try_variant_get(e["extra"], "$.k", "bigint").alias("extra_k"),
    )


@query
def issue_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Q7"""
    return browse.overview(listed(spark, sf))


# ---- grouping quality --------------------------------------------------------------------------------


@query
def pair_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """E1"""
    return evaluate.as_double(evaluate.pair_confusion(label_pairs(spark, sf)), "tp", "fp", "fn", "tn")


@query
def pair_prf(spark: SparkSession, sf: str) -> DataFrame:
    """E2"""
    return evaluate.pair_prf(label_pairs(spark, sf)).select(
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    )


@query
def merge_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """E3"""
    return evaluate.merge_split_counts(label_pairs(spark, sf))


@query
def split_groups(spark: SparkSession, sf: str) -> DataFrame:
    """E4 with the event type as the truth: one type, many causes."""
    kinds = F.split_part(F.col("true_label"), F.lit("/"), F.lit(1)).alias("true_label")
    return evaluate.split_groups(label_pairs(spark, sf).select(kinds, "pred_label"))


@query
def merged_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """E4"""
    return evaluate.merged_clusters(source_lang(spark, sf))


@query
def merged_clusters_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """E4 with a cluster that is NULL."""
    rows = source_lang(spark, sf).withColumn("pred_label", F.nullif("pred_label", F.lit("en")))
    return evaluate.merged_clusters(rows)


@query
def label_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """E5"""
    return evaluate.label_entropy(label_pairs(spark, sf)).select(
        *[F.round(c, 9).alias(c) for c in ("true_entropy", "pred_entropy")]
    )


@query
def homogeneity_completeness_v(spark: SparkSession, sf: str) -> DataFrame:
    """E6"""
    return evaluate.homogeneity_completeness_v(source_lang(spark, sf)).select(
        *[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v_measure")]
    )


@query
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """E7 through the JSON sink."""
    path = scratch_path(spark, "report")
    report = evaluate.as_double(evaluate.eval_report(label_pairs(spark, sf)), "tp", "fp", "fn", "tn")
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """D8 per group of lineitem."""
    rows = derived.table(spark, sf, "lineitem")
    return metrics.metric_summary(rows, "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query
def metric_summary_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """D8 with a group whose key is NULL."""
    rows = derived.table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    return metrics.metric_summary(rows, "l_extendedprice", ["flag"])


@query
def metric_summary_halfup(spark: SparkSession, sf: str) -> DataFrame:
    """D9 over a whole column."""
    return metrics.metric_summary(derived.table(spark, sf, "events"), "value", half_up=True)


# ---- raw logs ------------------------------------------------------------------------------------------


@query
def parse_stack(spark: SparkSession, sf: str) -> DataFrame:
    """B1: every raw frame, oldest call first."""
    frames = each_frame(raw_logs(spark, sf), stack_functions.raw_frames(F.col("stack")))
    return frames.select("seq", "position", "f.*")


@query
def frame_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """B2"""
    parsed = stack_functions.parse_stack(F.col("stack"), F.col("app_root"))
    frames = each_frame(raw_logs(spark, sf), parsed)
    return frames.select("seq", "position", "f.function", "f.filename", "f.lineno", "f.colno", "f.in_app")


@query
def build_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """B3, with the fingerprint the built envelopes get."""
    rows = fp.with_fingerprint(rawlogs.build_envelopes(raw_logs(spark, sf), "raw"))
    exc = fp.picked_exception(F.col("exception"))
    return rows.select(
        "seq", "event_id", "timestamp", "level", "project", "message",
        exc["type"].alias("exc_type"),
        exc["value"].alias("exc_value"),
        F.size(exc["stacktrace"]["frames"]).alias("frames"),
        "fingerprint",
        "title",
    )


@query
def breadcrumbs_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Views, clicks and signups are crumbs; errors and purchases carry the latest five."""
    base = derived.events_base(spark, sf).withColumn(
        "client", F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string"))
    )
    is_event = F.col("event_type").isin("error", "purchase")
    crumb = F.struct(
        (F.col("received_us") / F.lit(1e6)).alias("timestamp"),
        F.col("event_type").alias("category"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("k").cast("string")).alias("message"),
        F.lit("info").alias("level"),
        F.parse_json(F.lit("{}")).alias("data"),
    )
    crumbs = base.filter(~is_event).select("client", "seq", crumb.alias("c"))
    events = base.filter(is_event).select("client", "seq")
    filled = rawlogs.attach_breadcrumbs(events, crumbs, F.col("c"), CRUMBS_KEPT)
    return filled.select(
        "client", "seq",
        F.size("breadcrumbs").alias("n"),
        F.array_join(F.transform("breadcrumbs", lambda c: c["message"]), "|").alias("messages"),
    )


# ---- streaming -------------------------------------------------------------------------------------------

FILES_PER_BATCH = 4  # at least
ROWS_TO_FILL_A_FILE = 1_000  # of a batch on average, so that none of its files stays unwritten
STREAM_BATCHES = 3


def write_lines(spark: SparkSession, rows: DataFrame, batches: int = STREAM_BATCHES) -> tuple[str, int]:
    """Drop (seq, received_us, raw) as collector files, in arrival order; the folder and the files of a batch.

    Files follow the rows, so that a large batch is written by more tasks.  Every batch has the same number of
    them, as a micro-batch takes that many; a batch too small to fill them all sets it.  The times are read
    from the narrow columns alone, and each batch builds only its own texts.
    """
    low, high = rows.agg(F.min("received_us"), F.max("received_us")).first()
    width = (high - low) // batches + 1
    batch = F.floor((F.col("received_us") - low) / F.lit(width))
    sizes = {r[0]: r[1] for r in rows.groupBy(batch.alias("batch")).count().collect()}
    least = min(sizes.get(i, 0) for i in range(batches))
    files = max(FILES_PER_BATCH, min(-(-max(sizes.values()) // derived.TASK_ROWS), least // ROWS_TO_FILL_A_FILE))
    path = scratch_path(spark, "stream")
    record = F.to_json(F.struct("seq", "received_us", F.col("raw").alias("body")))
    for i in range(batches):
        part = rows.filter(
            (F.col("received_us") >= low + i * width) & (F.col("received_us") < low + (i + 1) * width)
        )
        part.select(record.alias("value")).repartition(files).write.mode("append").text(path)
    return path, files


def _stream(spark: SparkSession) -> SparkSession:
    return ingest.streaming_session(spark, spark.sparkContext.defaultParallelism)


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: accepted rows and the quarantine, one row each."""
    root = scratch_path(spark, "ingest")
    source, files = write_lines(spark, json_deliveries(spark, sf))
    ingest.start_ingest(_stream(spark), source, root, files).awaitTermination()
    good = spark.read.parquet(f"{root}/accepted").select("seq", "fingerprint", F.lit("").alias("reasons"))
    bad = spark.read.parquet(f"{root}/quarantine").select(
        "seq", F.lit("").alias("fingerprint"), F.array_join("reasons", ",").alias("reasons")
    )
    return good.unionByName(bad)


@query
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: every delivery with its stored issue and whether it was counted."""
    root = scratch_path(spark, "dedupe")
    source, files = write_lines(spark, clean_lines(spark, sf))
    ingest.start_dedupe(_stream(spark), source, root, files).awaitTermination()
    return spark.read.parquet(f"{root}/deliveries").select(
        "seq", "event_id", "fingerprint", "accepted", "issue_project", "issue_fingerprint"
    )


def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All deliveries as valid JSON."""
    return derived.deliveries(spark, sf).select("seq", "received_us", sinks.payload().alias("raw"))


def run_issue_stream(spark: SparkSession, lines: DataFrame, rules: AlertRules | None = None) -> str:
    root = scratch_path(spark, "issues")
    source, files = write_lines(spark, lines)
    ingest.start_issues(_stream(spark), source, root, files, rules).awaitTermination()
    return root


@query
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """ST3"""
    root = run_issue_stream(spark, clean_lines(spark, sf))
    return ingest.read_latest(spark, root, "issues", ingest.SNAPSHOT)


@query
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """ST4"""
    root = run_issue_stream(spark, clean_lines(spark, sf), ALERT_RULES)
    return ingest.read_all(spark, root, "alerts", ingest.ALERT)


@query
def stream_out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """ST5: deliveries arrive newest event first; nothing is dropped as late."""
    reversed_time = (F.lit(4_000_000_000_000_000) - (F.col("timestamp") * 1e6)).cast("bigint")
    lines = derived.deliveries(spark, sf).select("seq", reversed_time.alias("received_us"), sinks.payload().alias("raw"))
    root = run_issue_stream(spark, lines)
    return ingest.read_latest(spark, root, "issues", ingest.SNAPSHOT)


@query
def store_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S1-S4 durable: four batches, the third quarter of arrivals before the second, one given twice.

    An issue's id follows the batch it first came in, then its first arrival there.
    """
    rows = materialize(clean_lines(spark, sf), "clean")
    low, high = rows.agg(F.min("received_us"), F.max("received_us")).first()
    width = (high - low) // 4 + 1
    root, session = scratch_path(spark, "store"), _stream(spark)
    for number, quarter in ((0, 0), (1, 2), (1, 2), (2, 1), (3, 3)):
        part = rows.filter(F.floor((F.col("received_us") - low) / F.lit(width)) == quarter)
        ingest.ingest_batch(envelopes.validated(part), root, number)
    events = spark.read.parquet(f"{root}/events").groupBy("issue_id").agg(F.count("*").alias("events"))
    ids = session.read.schema(ingest.IDS).parquet(f"{root}/ids/batch=3")
    snapshot = session.read.schema(ingest.SNAPSHOT).parquet(f"{root}/issues/batch=3").select("project", "fingerprint", "count", "title")
    return snapshot.join(ids, ["project", "fingerprint"]).join(events, F.col("id") == F.col("issue_id")).drop("issue_id")
