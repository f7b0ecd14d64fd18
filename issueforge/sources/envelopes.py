"""JSON envelopes -> typed rows, with every rejected row kept in a quarantine table.

Documents are read as VARIANT because an absent key (takes the default) and an explicit null
(an error for fields that are not optional) must be told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issueforge.functions.text import bind, strip
from issueforge.schema import (
    BREADCRUMB_TYPE,
    DEFAULT_LEVEL,
    DEFAULT_PLATFORM,
    DEFAULT_PROJECT,
    EVENT_ID_PATTERN,
    EXCEPTION_TYPE,
    EXCEPTION_VALUE_TYPE,
    FRAME_TYPE,
    LEVELS,
)

# ---- fixed values: accepted spellings ----------------------------------------------------------
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")
INTEGER_TEXT = r"^[+-]?\d+(?:_\d+)*(?:\.0*)?$"
FLOAT_TEXT = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+)(?:e[+-]?\d+)?|nan|inf|infinity)$"
# ---- end of fixed values -----------------------------------------------------------------------

OBJECT = "map<string,variant>"
LIST = "array<variant>"
Checked = tuple[Column, Column]  # (is the type acceptable, typed value)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in, columns ``raw`` and the arrival columns of the wrapper record.

    A line is ``{"seq":..,"received_us":..,"body":"<envelope JSON>"}``; the wrapper is what a
    collector writes, the body is what a client sent.
    """
    return unwrap(spark.read.text(path))


def unwrap(lines: DataFrame) -> DataFrame:
    record = F.from_json("value", "seq bigint, received_us bigint, body string")
    return lines.select(record.alias("r")).select("r.seq", "r.received_us", F.col("r.body").alias("raw"))


def _as(x: Column, target: str) -> Column:
    return F.try_variant_get(x, "$", target)


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _is_number(x: Column) -> Column:
    return _kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _absent(x: Column, nullable: bool) -> Column:
    return x.isNull() | F.is_variant_null(x) if nullable else x.isNull()


def text(x: Column, nullable: bool = True) -> Checked:
    is_text = _kind(x) == "STRING"
    return _absent(x, nullable) | is_text, F.when(is_text, _as(x, "string"))


def number(x: Column, nullable: bool = True) -> Checked:
    words = F.regexp_replace(strip(_as(x, "string")), r"(?<=\d)_(?=\d)", "")
    value = (
        F.when(_is_number(x), _as(x, "double"))
        .when(_kind(x) == "BOOLEAN", _as(x, "boolean").cast("int").cast("double"))
        .when((_kind(x) == "STRING") & strip(_as(x, "string")).rlike(FLOAT_TEXT), words.try_cast("double"))
    )
    return _absent(x, nullable) | value.isNotNull(), value


def integer(x: Column) -> Checked:
    words = F.regexp_replace(strip(_as(x, "string")), r"(?<=\d)_(?=\d)|\.0*$", "")
    exact = _as(x, "decimal(38,18)")
    value = (
        F.when(_kind(x) == "BIGINT", _as(x, "bigint"))
        .when(_is_number(x) & (exact == F.floor(exact)), exact.try_cast("bigint"))
        .when(_kind(x) == "BOOLEAN", _as(x, "boolean").cast("bigint"))
        .when((_kind(x) == "STRING") & strip(_as(x, "string")).rlike(INTEGER_TEXT), words.try_cast("bigint"))
    )
    return _absent(x, True) | value.isNotNull(), value


def flag(x: Column) -> Checked:
    word = F.lower(_as(x, "string"))
    value = (
        F.when(_kind(x) == "BOOLEAN", _as(x, "boolean"))
        .when(_is_number(x) & (_as(x, "double") == 1), True)
        .when(_is_number(x) & (_as(x, "double") == 0), False)
        .when((_kind(x) == "STRING") & word.isin(*TRUE_WORDS), True)
        .when((_kind(x) == "STRING") & word.isin(*FALSE_WORDS), False)
    )
    return _absent(x, True) | value.isNotNull(), value


def _key(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def _both(checks: list[Column]) -> Column:
    ok = checks[0]
    for check in checks[1:]:
        ok = ok & check
    return ok


def _checked(ok: Column, value: Column) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), value.alias("v"))


def _field(check: Callable[[Column], Checked | Column], x: Column) -> Column:
    """struct<ok, v>; nested checks return it directly, scalar ones as a pair."""
    result = check(x)
    return result if isinstance(result, Column) else _checked(*result)


def _record(x: Column, fields: dict, target: str) -> Column:
    """struct<ok, v> of an object's fields; ok is false for anything but an object."""

    def combine(m: Column, r: Column) -> Column:
        ok = m.isNotNull()
        for name in fields:
            ok = ok & r[name]["ok"]
        return _checked(ok, F.struct(*[r[name]["v"].alias(name) for name in fields]).cast(target))

    def build(m: Column) -> Column:
        parts = F.struct(*[_field(check, _key(m, name)).alias(name) for name, check in fields.items()])
        return bind(parts, lambda r: combine(m, r))

    return bind(_as(x, OBJECT), build)


def _records(x: Column, fields: dict, target: str) -> Column:
    """A list of objects that may be absent (empty) but not null."""
    items = F.transform(_as(x, LIST), lambda item: _record(item, fields, target))
    return bind(
        items,
        lambda done: _checked(
            x.isNull() | F.coalesce(F.forall(done, lambda r: r["ok"]), F.lit(False)),
            F.coalesce(F.transform(done, lambda r: r["v"]), F.array().cast(f"array<{target}>")),
        ),
    )


def _optional(x: Column, record: Column) -> Column:
    """An object that may be absent or null."""
    return bind(record, lambda r: _checked(r["ok"] | _absent(x, True), F.when(r["ok"], r["v"])))


def _dict(x: Column) -> Checked:
    is_dict = _as(x, OBJECT).isNotNull()
    return x.isNull() | is_dict, F.coalesce(F.when(is_dict, x), F.parse_json(F.lit("{}")))


def _tags(x: Column) -> Column:
    return bind(
        _as(x, OBJECT),
        lambda entries: _checked(
            x.isNull() | F.forall(F.map_values(entries), lambda v: _kind(v) == "STRING"),
            F.coalesce(
                F.transform_values(entries, lambda _, v: _as(v, "string")),
                F.create_map().cast("map<string,string>"),
            ),
        ),
    )


_FRAME = {
    "function": text, "filename": text, "module": text, "lineno": integer, "colno": integer,
    "in_app": flag, "context_line": text,
}
_CRUMB = {"timestamp": number, "category": text, "message": text, "level": text, "data": _dict}
_TRACE_TYPE = f"struct<frames:array<{FRAME_TYPE}>>"


def _stacktrace(x: Column) -> Column:
    return _optional(x, _record(x, {"frames": lambda f: _records(f, _FRAME, FRAME_TYPE)}, _TRACE_TYPE))


_VALUE = {"type": text, "value": text, "stacktrace": _stacktrace}


# schema_of_variant of an exception whose leaves have the types of the columns; unknown keys do not match
_PLAIN_FRAME = (
    r"OBJECT<(?:(?:(?:colno|lineno): BIGINT|in_app: BOOLEAN"
    r"|(?:context_line|filename|function|module): STRING|\w+: VOID)(?:, |(?=>)))*>"
)
_PLAIN_TRACE = rf"OBJECT<frames: ARRAY<(?:VOID|{_PLAIN_FRAME})>>"
_PLAIN_VALUE = rf"OBJECT<(?:(?:(?:type|value): STRING|stacktrace: {_PLAIN_TRACE}|\w+: VOID)(?:, |(?=>)))*>"
_PLAIN_EXCEPTION = rf"^OBJECT<values: ARRAY<{_PLAIN_VALUE}>>$"


def _exception(x: Column) -> Column:
    """One cast where every leaf has its column's type, else field by field.

    The cast cannot tell an absent list from a null one, and the schema of a list hides its null
    elements: where the cast left any of these null, the fields are judged one by one as well.
    """
    plain = F.when(_kind(x).rlike(_PLAIN_EXCEPTION), _as(x, EXCEPTION_TYPE))
    return bind(plain, lambda e: F.when(_whole(e), _checked(F.lit(True), e)).otherwise(_exception_by_field(x)))


def _whole(exception: Column) -> Column:
    """No null element, no stack trace without frames."""

    def traced(trace: Column) -> Column:
        frames = F.coalesce(F.forall(trace["frames"], lambda f: f.isNotNull()), F.lit(False))
        return trace.isNull() | frames

    return F.coalesce(F.forall(exception["values"], lambda v: v.isNotNull() & traced(v["stacktrace"])), F.lit(False))


def _exception_by_field(x: Column) -> Column:
    values = {"values": lambda v: _records(v, _VALUE, EXCEPTION_VALUE_TYPE)}
    return _optional(x, _record(x, values, EXCEPTION_TYPE))


def _defaulted(default: str) -> Callable[[Column], Checked]:
    def check(x: Column) -> Checked:
        fine, value = text(x, nullable=False)
        return fine, F.when(x.isNull(), default).otherwise(value)

    return check


_ENVELOPE = {
    "event_id": lambda x: text(x, nullable=False),
    "timestamp": lambda x: number(x, nullable=False),
    "platform": _defaulted(DEFAULT_PLATFORM),
    "level": _defaulted(DEFAULT_LEVEL),
    "project": _defaulted(DEFAULT_PROJECT),
    "logger": text,
    "release": text,
    "environment": text,
    "server_name": text,
    "transaction": text,
    "message": text,
    "exception": _exception,
    "tags": _tags,
    "breadcrumbs": lambda x: _records(x, _CRUMB, BREADCRUMB_TYPE),
    "extra": _dict,
}


def parsed(deliveries: DataFrame) -> DataFrame:
    """V1 + V6: add the typed envelope columns, ``_is_object`` and ``_wrong``, the names of badly
    typed fields.  Defaults fill absent keys only.  Of a repeated key the last value counts, which
    needs the session setting in ``session.RECOMMENDED``; without it this refuses to run.

    Each field is a projection of its own, so that Spark decodes the fields a query asks for.  A filter on a
    field would be pushed below and decode it again: `validated` puts a one-row `explode_outer` in its way.
    """
    if deliveries.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        raise ValueError("set spark.sql.variant.allowDuplicateKeys to true: documents that repeat a key would be lost")
    rows = deliveries.select(
        "seq", "received_us", "raw", _as(F.try_parse_json("raw"), OBJECT).alias("_doc")
    )
    decoded = rows.select(
        "seq", "received_us", "raw", F.col("_doc").isNotNull().alias("_is_object"),
        *[_field(check, _key(F.col("_doc"), n)).alias(n) for n, check in _ENVELOPE.items()],
    )
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"{n}.ok"), F.lit(n)) for n in _ENVELOPE]))
    return decoded.select(
        "seq", "received_us", "raw", "_is_object", wrong.alias("_wrong"), *[F.col(f"{n}.v").alias(n) for n in _ENVELOPE]
    )


def valid_event_id(event_id: Column) -> Column:
    """V2; (?d) makes ``$`` accept one trailing line feed and nothing else."""
    return event_id.rlike("(?d)" + EVENT_ID_PATTERN)


def valid_level(level: Column) -> Column:
    """V3"""
    return level.isin(*LEVELS)


def valid_timestamp(timestamp: Column) -> Column:
    """V4; NaN is greater than every number in Spark and so passes."""
    return ~(timestamp <= 0)


def has_payload(exception: Column, message: Column) -> Column:
    """V5"""
    return F.coalesce(F.size(exception["values"]) > 0, F.lit(False)) | F.coalesce(
        F.length(strip(message)) > 0, F.lit(False)
    )


def validated(deliveries: DataFrame) -> DataFrame:
    """V1-V6: typed envelope plus ``reasons``; empty reasons mean valid.

    The payload rule is only judged for otherwise valid envelopes.
    """
    rows = parsed(deliveries)
    field_reasons = F.array_compact(
        F.array(
            F.when(F.col("event_id").isNull() & ~F.array_contains("_wrong", "event_id"), F.lit("event_id missing")),
            F.when(~valid_event_id(F.col("event_id")), F.lit("event_id")),
            F.when(F.col("timestamp").isNull() & ~F.array_contains("_wrong", "timestamp"), F.lit("timestamp missing")),
            F.when(~valid_timestamp(F.col("timestamp")), F.lit("timestamp")),
            F.when(~valid_level(F.col("level")), F.lit("level")),
        )
    )
    typed = F.concat(F.transform("_wrong", lambda n: F.concat(F.lit("type:"), n)), field_reasons)
    reasons = (
        F.when(~F.col("_is_object"), F.array(F.lit("json")))
        .when(F.size("_fields") > 0, F.col("_fields"))
        .when(~has_payload(F.col("exception"), F.col("message")), F.array(F.lit("payload")))
        .otherwise(F.array().cast("array<string>"))
    )
    # filters on the reasons stop here instead of repeating the decoding below
    judged = rows.withColumn("_fields", typed).select("*", F.explode_outer(F.array(reasons)).alias("reasons"))
    return judged.drop("_fields", "_is_object", "_wrong")


def accepted(checked: DataFrame) -> DataFrame:
    """V7, valid side: typed envelopes with the arrival columns."""
    return checked.filter(F.size("reasons") == 0).drop("reasons", "raw")


def quarantined(checked: DataFrame) -> DataFrame:
    """V7, rejected side: the raw text with the reasons."""
    return checked.filter(F.size("reasons") > 0).select("seq", "received_us", "raw", "reasons")


def validation_report(checked: DataFrame) -> DataFrame:
    """V7: rows per reason; valid rows count under 'valid'."""
    return (
        checked.select(
            F.explode(
                F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("valid")))
            ).alias("reason")
        )
        .groupBy("reason")
        .agg(F.count("*").alias("rows"))
    )
