"""Raw error logs -> envelopes, and breadcrumbs attached as of each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from issueforge.functions.stack import parse_stack
from issueforge.functions.text import blank
from issueforge.session import materialize
from issueforge.plans.skew import attach, keyed_join, salt, salts_seen
from issueforge.plans.slices import running_total
from issueforge.schema import BREADCRUMB_TYPE, DEFAULT_PLATFORM, DEFAULT_PROJECT, EXCEPTION_TYPE

# ---- fixed values ----------------------------------------------------------------------------
LEVEL_OF_KIND = {"captured": "error", "uncaught": "fatal", "unhandled": "error", "message": "info"}
DEFAULT_ERROR_NAME = "Error"
DEFAULT_CRUMBS = 50
# ---- end of fixed values ---------------------------------------------------------------------
SEQ_SLICE = 65_536


def build_envelopes(raw: DataFrame, source: str) -> DataFrame:
    """Rows (client, kind, name, message, stack, app_root, level, project, release,
    environment, server_name, tags, seq, received_us) -> envelope rows.

    ``level`` and ``project`` may be NULL for the defaults.  The event id is a digest of source and
    offset, so replaying a log redelivers the same ids.
    """
    is_message = F.col("kind") == "message"
    default_level = F.lit(None).cast("string")
    for kind, level in LEVEL_OF_KIND.items():
        default_level = F.when(F.col("kind") == kind, level).otherwise(default_level)
    frames = parse_stack(F.col("stack"), F.col("app_root"))
    exception = F.struct(
        F.array(
            F.struct(
                F.when(blank(F.col("name")), DEFAULT_ERROR_NAME).otherwise(F.col("name")).alias("type"),
                F.coalesce("message", F.lit("")).alias("value"),
                F.struct(frames.alias("frames")).alias("stacktrace"),
            )
        ).alias("values")
    ).cast(EXCEPTION_TYPE)
    return raw.select(
        F.md5(F.concat_ws("\n", F.lit(source), F.col("seq").cast("string"))).alias("event_id"),
        (F.col("received_us") / F.lit(1e6)).alias("timestamp"),
        F.lit(DEFAULT_PLATFORM).alias("platform"),
        F.coalesce("level", default_level).alias("level"),
        F.coalesce("project", F.lit(DEFAULT_PROJECT)).alias("project"),
        F.lit(None).cast("string").alias("logger"),
        "release",
        "environment",
        "server_name",
        F.lit(None).cast("string").alias("transaction"),
        F.when(is_message, F.col("message")).alias("message"),
        F.when(~is_message, exception).alias("exception"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
        F.array().cast(f"array<{BREADCRUMB_TYPE}>").alias("breadcrumbs"),
        F.parse_json(F.lit("{}")).alias("extra"),
        "client",
        "seq",
        "received_us",
    )


def attach_breadcrumbs(
    events: DataFrame, crumbs: DataFrame, crumb: Column, last: int = DEFAULT_CRUMBS, out: str = "breadcrumbs"
) -> DataFrame:
    """Give every event its client's latest ``last`` crumbs so far, oldest first.

    Both inputs have ``client`` and a common ``seq``.  Crumbs get their rank within the client by a
    sliced running count and are packed into blocks of at most 2 x ``last`` neighbours; an event
    reads the one block its rank falls into.  A busy client's events are spread over salts.
    """
    element = crumbs.select(crumb.alias("_crumb")).schema["_crumb"].dataType
    none = F.array().cast(ArrayType(element, True))
    if last <= 0:
        return events.withColumn(out, none)
    points = crumbs.select("client", "seq", F.lit(1).cast("bigint").alias("_is_crumb")).unionByName(
        events.select("client", "seq", F.lit(0).cast("bigint").alias("_is_crumb"))
    )
    # three branches read the ranks; crumb bodies join only where they are packed
    ranked = materialize(running_total(points, ["client"], ["seq"], "_is_crumb", SEQ_SLICE, "_rank"), "crumb-ranks")
    bodies = crumbs.select("client", "seq", crumb.alias("_crumb"))
    own_block = F.floor((F.col("_rank") - 1) / F.lit(last)).cast("bigint")
    # a crumb is also context for the following block
    blocks = (
        keyed_join(bodies, ranked.filter("_is_crumb = 1").select("client", "seq", "_rank"), ["client", "seq"])
        .withColumn("_block", F.explode(F.array(own_block, own_block + 1)))
        .groupBy("client", "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "_crumb")), lambda a, b: (a["_rank"] - b["_rank"]).cast("int")).alias("_packed"))
    )
    asks = (
        ranked.filter("_is_crumb = 0")
        .select("client", "seq", "_rank", own_block.alias("_block"))
        .withColumn("_salt", salt("seq"))
    )
    present = asks.groupBy("client", "_block").agg(salts_seen().alias("_salts"))
    filled = attach(asks, keyed_join(blocks, present, ["client", "_block"]), ["client", "_block"]).select(
        "client",
        "seq",
        F.transform(
            F.filter(
                "_packed",
                lambda c: (c["_rank"] <= F.col("_rank")) & (c["_rank"] > F.col("_rank") - F.lit(last)),
            ),
            lambda c: c["_crumb"],
        ).alias("_found"),
    )
    return (
        keyed_join(events.drop(out), filled, ["client", "seq"], "left")
        .withColumn(out, F.coalesce("_found", none))
        .drop("_found")
    )
