"""Event generators as Spark jobs: a skewed mixed stream and a labelled set with known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issueforge.plans.slices import running_total
from issueforge.schema import BREADCRUMB_TYPE, EXCEPTION_TYPE, FRAME_TYPE

# ---- fixed values: root causes (type, value, ((function, file), ...)) --------------------------
CAUSES = (
    ("TypeError", "Cannot read properties of undefined (reading 'id')",
     (("handleRequest", "src/server/handler.js"), ("renderUserCard", "src/components/UserCard.js"))),
    ("TypeError", "Cannot read properties of undefined (reading 'toFixed')",
     (("handleRequest", "src/server/handler.js"), ("formatPrice", "src/utils/money.js"))),
    ("RangeError", "Maximum call stack size exceeded",
     (("traverse", "src/services/tree.js"), ("walk", "src/services/tree.js"))),
    ("ReferenceError", "process is not defined",
     (("bootstrap", "src/index.js"), ("loadConfig", "src/config/loader.js"))),
    ("PaymentError", "charge declined",
     (("handleCheckout", "src/routes/checkout.js"), ("processPayment", "src/payments/stripe.js"))),
    ("UnauthorizedError", "no token provided",
     (("authMiddleware", "src/middleware/auth.js"), ("verify", "src/security/jwt.js"))),
    ("ValidationError", "field 'email' is required",
     (("validateBody", "src/http/validate.js"), ("createUser", "src/services/user.js"))),
    ("TimeoutError", "upstream timed out",
     (("fetchInventory", "src/services/inventory.js"), ("httpGet", "src/lib/http.js"))),
    ("SyntaxError", "Unexpected token < in JSON",
     (("parseResponse", "src/lib/json.js"), ("callApi", "src/services/api.js"))),
    ("NotFoundError", "order not found",
     (("getOrder", "src/services/order.js"), ("loadOrder", "src/db/orders.js"))),
    ("ConflictError", "duplicate key value",
     (("insertRow", "src/db/pg.js"), ("saveCart", "src/services/cart.js"))),
    ("TypeError", "x.map is not a function",
     (("renderList", "src/components/List.js"), ("mapItems", "src/components/List.js"))),
)
STREAM_START, LABELLED_START = 1_723_500_000.0, 1_723_000_000.0
STREAM_GAP = (0.01, 0.5)
PROJECT, RELEASE, ENVIRONMENT = "checkout", "app@1.4.2", "production"
# Labelled groups: (label, size, type, value or message, ((function, file, in_app), ...)).
# {a} {b} {c} stand for per-event draws; group 6 alternates an async marker, group 10 an extra frame.
GROUPS = (
    ("G1_usercard_undefined", 12, "TypeError",
     "Cannot read properties of undefined (reading '{a}') for user {b}",
     (("handleRequest", "src/server/handler.js", True), ("renderProfile", "src/components/Profile.js", True),
      ("renderUserCard", "src/components/UserCard.js", True))),
    ("G2_money_undefined", 9, "TypeError", "Cannot read properties of undefined (reading 'toFixed')",
     (("handleRequest", "src/server/handler.js", True), ("formatPrice", "src/utils/money.js", True))),
    ("G3_tree_recursion", 8, "RangeError", "Maximum call stack size exceeded near 0x{c}",
     (("traverse", "src/services/tree.js", True), ("walk", "src/services/tree.js", True),
      ("walk", "src/services/tree.js", True))),
    ("G4_db_timeout", 10, None, "Connection to db-shard-{b} timed out after {b}ms", ()),
    ("G5_invalid_email", 7, None, "Invalid email address 'user{b}@{a}.io' rejected by validator", ()),
    ("G6_payment_async", 8, "PaymentError", "charge declined (code {a})",
     (("handleCheckout", "src/routes/checkout.js", True), ("{async}processPayment", "src/payments/stripe.js", True))),
    ("G7_auth_middleware", 7, "UnauthorizedError", "no token provided",
     (("handle", "node_modules/express@4.{d}.2/lib/router/index.js", False),
      ("authMiddleware", "src/middleware/auth.js", True))),
    ("G8_coupon_null", 6, "TypeError", "Cannot read properties of null (reading 'percent')",
     (("handleRequest", "src/server/handler.js", True), ("applyDiscount", "src/utils/coupon.js", True))),
    ("G9_config_reference", 6, "ReferenceError", "process is not defined",
     (("bootstrap", "src/index.js", True), ("loadConfig", "src/config/loader.js", True))),
    ("G10_webhook_signature", 8, "SignatureError", "hmac signature mismatch",
     (("handleWebhook", "src/routes/webhook.js", True), ("withRetry", "src/lib/retry.js", None),
      ("verifySignature", "src/security/hmac.js", True))),
)
# ---- end of fixed values -----------------------------------------------------------------------


def uniform(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) fixed by the row's columns: the same whichever task computes it."""
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 30)) / F.lit(float(1 << 30))


def between(low: int, high: int, seed: int, *what: Column | str) -> Column:
    return (F.lit(low) + F.floor(uniform(seed, *what) * (high - low + 1))).cast("bigint")


def _envelope(event_id: Column, timestamp: Column, message: Column, exception: Column) -> list[Column]:
    nothing = F.lit(None).cast("string")
    return [
        event_id.alias("event_id"),
        timestamp.alias("timestamp"),
        F.lit("node").alias("platform"),
        F.lit("error").alias("level"),
        F.lit(PROJECT).alias("project"),
        nothing.alias("logger"),
        F.lit(RELEASE).alias("release"),
        F.lit(ENVIRONMENT).alias("environment"),
        nothing.alias("server_name"),
        nothing.alias("transaction"),
        message.alias("message"),
        exception.cast(EXCEPTION_TYPE).alias("exception"),
        F.create_map().cast("map<string,string>").alias("tags"),
        F.array().cast(f"array<{BREADCRUMB_TYPE}>").alias("breadcrumbs"),
        F.parse_json(F.lit("{}")).alias("extra"),
    ]


def _frame(function: Column, filename: Column, in_app: Column, seed: int) -> Column:
    return F.struct(
        function.alias("function"),
        filename.alias("filename"),
        F.lit(None).cast("string").alias("module"),
        between(1, 400, seed, "seq").alias("lineno"),
        between(1, 120, seed + 1, "seq").alias("colno"),
        in_app.cast("boolean").alias("in_app"),
        F.lit(None).cast("string").alias("context_line"),
    )


def _exception(exc_type: Column, value: Column, frames: Column) -> Column:
    return F.struct(
        F.array(
            F.struct(
                exc_type.alias("type"), value.alias("value"),
                F.struct(frames.cast(f"array<{FRAME_TYPE}>").alias("frames")).alias("stacktrace"),
            )
        ).alias("values")
    )


def mixed_stream(rows: DataFrame, causes: int = len(CAUSES), seed: int = 2024) -> DataFrame:
    """G1: one event per input row (column ``seq``), cause i drawn with weight 1/(i+1).

    Times are running sums of random gaps, computed in slices of ``seq``.
    """
    picked = CAUSES[:causes]
    weights = [1.0 / (i + 1) for i in range(len(picked))]
    draw = uniform(seed, F.lit("cause"), "seq") * sum(weights)
    cause = F.lit(len(picked) - 1)
    for i in reversed(range(len(picked) - 1)):
        cause = F.when(draw < sum(weights[: i + 1]), i).otherwise(cause)

    def pick(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cause") + 1)

    gap_us = F.lit(STREAM_GAP[0]) + uniform(seed, F.lit("gap"), "seq") * (STREAM_GAP[1] - STREAM_GAP[0])
    timed = running_total(
        rows.select("seq", F.lit(0).alias("_stream"), F.round(gap_us * 1e6).cast("bigint").alias("_gap")),
        ["_stream"], ["seq"], "_gap", 65_536, "_offset",
    )
    frames = F.array(
        *[
            _frame(pick([c[2][i][0] for c in picked]), pick([c[2][i][1] for c in picked]), F.lit(True), seed + 7 * i)
            for i in range(2)
        ]
    )
    value = F.concat(
        pick([c[1] for c in picked]), F.lit(" (uid "),
        between(1, 100_000, seed, F.lit("uid"), "seq").cast("string"), F.lit(")"),
    )
    at_us = F.lit(int(STREAM_START * 1e6)) + F.col("_offset")
    return timed.withColumn("cause", cause.cast("int")).select(
        *_envelope(
            F.md5(F.concat_ws("/", F.lit(seed), F.col("seq").cast("string"))),
            at_us / F.lit(1e6),
            F.lit(None).cast("string"),
            _exception(pick([c[0] for c in picked]), value, frames),
        ),
        "seq",
        at_us.alias("received_us"),
        F.concat(F.lit("cause"), F.col("cause").cast("string")).alias("true_label"),
    )


def labelled_set(spark: SparkSession, copies: DataFrame | None = None, seed: int = 1337) -> DataFrame:
    """The labelled set; with ``copies`` (column ``copy``) one full set per row of it."""
    whole = spark.range(1).select(F.lit(0).cast("bigint").alias("copy")) if copies is None else copies.select("copy")
    per_set = sum(g[1] for g in GROUPS)
    members = F.array(
        *[F.struct(F.lit(g).alias("g"), F.lit(m).alias("m")) for g, group in enumerate(GROUPS) for m in range(group[1])]
    )
    rows = (
        whole.select("copy", F.posexplode(members).alias("position", "member"))
        .select("copy", "position", "member.g", "member.m")
        .withColumn("seq", F.col("copy") * per_set + F.col("position"))
    )

    def by_group(values: list[Column]) -> Column:
        chosen = values[-1]
        for i in reversed(range(len(values) - 1)):
            chosen = F.when(F.col("g") == i, values[i]).otherwise(chosen)
        return chosen

    even = F.col("m") % 2 == 0
    fills = {
        "{a}": F.left(F.md5(F.concat(F.lit("a"), F.col("seq").cast("string"))), F.lit(6)),
        "{b}": between(1, 9999, seed, "seq").cast("string"),
        "{c}": F.left(F.md5(F.col("seq").cast("string")), F.lit(8)),
        "{d}": between(17, 19, seed, F.lit("v"), "seq").cast("string"),
        "{async}": F.when(even, "async ").otherwise(""),
    }

    def filled(template: str) -> Column:
        text = F.lit(template)
        for mark, value in fills.items():
            if mark in template:
                text = F.replace(text, F.lit(mark), value)
        return text

    def frames(specs: tuple) -> Column:
        built = F.array(
            *[
                F.when(
                    F.lit(flag is not None) | even,
                    _frame(filled(fn), filled(file), F.lit(flag is not False), seed + i),
                )
                for i, (fn, file, flag) in enumerate(specs)
            ]
        )
        return F.array_compact(built).cast(f"array<{FRAME_TYPE}>")

    exceptions = [
        _exception(F.lit(t), filled(v), frames(specs)).cast(EXCEPTION_TYPE) if t else F.lit(None).cast(EXCEPTION_TYPE)
        for _, _, t, v, specs in GROUPS
    ]
    messages = [F.lit(None).cast("string") if t else filled(v) for _, _, t, v, _ in GROUPS]
    at = F.lit(LABELLED_START) + F.col("seq") * 2.5
    return rows.select(
        *_envelope(
            F.md5(F.concat_ws("/", F.lit(seed), F.col("seq").cast("string"))), at,
            by_group(messages), by_group(exceptions),
        ),
        "seq",
        (at * 1e6).cast("bigint").alias("received_us"),
        by_group([F.lit(g[0]) for g in GROUPS]).alias("true_label"),
    )
