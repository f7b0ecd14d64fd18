"""Error-event deliveries derived from a plain ``events`` table (event_id, ts, user_id, ...).

The table carries no stack frames, so frames, messages and redeliveries are computed from its
columns by fixed rules.  Every row of the table becomes one delivery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issueforge.schema import BREADCRUMB_TYPE, EXCEPTION_TYPE, FRAME_TYPE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits.

    A scan with at least one split per core, which is any large table, is left as it is; below
    that the raw columns are redistributed once so that the expression-heavy stage after it is
    not confined to a few tasks.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


TASK_ROWS = 50_000  # rows of a task that decodes or fingerprints each of them


def spread_rows(scan: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Tasks of about ``rows`` rows each, at least one per core, whatever the files' row groups.

    Splits of a scan follow bytes: a row group is read by one task, and a narrow table holds millions of rows in
    the bytes of one split.  Only raw columns are redistributed; the count is answered from the footers.
    """
    wanted = -(-scan.count() // rows)
    return scan.repartition(max(wanted, scan.sparkSession.sparkContext.defaultParallelism))


def wall_micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a timestamp column's wall clock, whatever the session's time zone."""
    ts = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        ts = F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return F.unix_micros(ts)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, received_us, user_id, event_type, value, k."""
    events = spread_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return events.select(
        F.col("event_id").alias("seq"),
        wall_micros(events, "ts").alias("received_us"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _frames(user: Column, k: Column) -> Column:
    def frame(function: Column, filename: Column, lineno: Column, in_app: Column) -> Column:
        return F.struct(
            function.alias("function"),
            filename.alias("filename"),
            F.lit(None).cast("string").alias("module"),
            lineno.cast("bigint").alias("lineno"),
            (k + 1).cast("bigint").alias("colno"),
            in_app.alias("in_app"),
            F.lit(None).cast("string").alias("context_line"),
        )

    unflagged = F.lit(None).cast("boolean")
    even = k % 2 == 0
    return F.array(
        frame(F.lit("handle"), _text("/srv/b", user % 5, "/src/server/handler.js"), user, unflagged),
        frame(
            _text(F.when(even, "async ").otherwise(""), "work", k % 4),
            _text("src/lib/m", k % 4, ".js?v=", k),
            k + 10,
            unflagged,
        ),
        frame(
            F.lit("next"),
            _text("/h", user, "/node_modules/express@4.", k % 3, ".0/lib/router.js"),
            k + 20,
            F.when(even, F.lit(False)),
        ),
    ).cast(f"array<{FRAME_TYPE}>")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed envelopes plus ``seq``, ``received_us`` and the ground-truth ``true_label``."""
    base = events_base(spark, sf_dir)
    seq, user, kind, k = F.col("seq"), F.col("user_id"), F.col("event_type"), F.col("k")
    has_stack = kind.isin("error", "purchase")
    has_exception = kind.isin("error", "purchase", "signup")
    exc_type = F.when(kind == "error", _text("E", k % 2)).when(kind == "purchase", "PaymentError")
    exc_value = _text(
        "User ", user, " saw 'item", k, "' at 0x", F.left(F.md5(k.cast("string")), F.lit(8)),
        " after ", k * 10, "ms  from u", user, "@x", k, ".io in s3",
    )
    message = _text(
        "Shard db-", k % 7, " ", kind, " slow ", F.md5(user.cast("string")), " v1.", k % 3
    )
    exception = F.when(
        has_exception,
        F.struct(
            F.array(
                F.struct(
                    exc_type.alias("type"),
                    exc_value.alias("value"),
                    F.when(has_stack, F.struct(_frames(user, k).alias("frames"))).alias("stacktrace"),
                )
            ).alias("values")
        ).cast(EXCEPTION_TYPE),
    )
    template = (
        F.when(kind == "error", _text(k % 2, "/", k % 4))
        .when(kind == "purchase", _text(k % 4))
        .otherwise(_text(k % 3))
    )
    return base.select(
        F.md5((seq - (seq % 17 == 16).cast("bigint")).cast("string")).alias("event_id"),
        ((F.col("received_us") - k * 60_000_000) / F.lit(1e6)).alias("timestamp"),
        F.lit("node").alias("platform"),
        F.when(kind == "error", "error")
        .when(kind == "purchase", "fatal")
        .when(kind == "signup", "warning")
        .when(kind == "click", "info")
        .otherwise("debug")
        .alias("level"),
        _text("p", user % 3).alias("project"),
        F.lit(None).cast("string").alias("logger"),
        _text("app@1.", k % 3).alias("release"),
        F.lit("production").alias("environment"),
        F.lit(None).cast("string").alias("server_name"),
        F.when((kind == "view") & (k % 2 == 0), _text("GET /shop/", k % 3)).alias("transaction"),
        F.when(kind.isin("view", "click"), message).alias("message"),
        exception.alias("exception"),
        F.create_map(F.lit("user"), user.cast("string")).alias("tags"),
        F.array().cast(f"array<{BREADCRUMB_TYPE}>").alias("breadcrumbs"),
        F.parse_json(_text('{"k": ', k, "}")).alias("extra"),
        "seq",
        "received_us",
        _text(kind, "/", template).alias("true_label"),
    )
