"""Stack and message fingerprints over envelope rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.functions.text import (
    UNKNOWN_MODULE,
    anchor_path,
    bind,
    blank,
    clean_path,
    non_blank,
    normalize_message,
    strip,
    tidy_function,
)

# ---- fixed values ----------------------------------------------------------------------------
IN_APP_EXCLUDE = ("node_modules/", "node:internal", "internal/")
NO_TYPE = "<none>"
UNKNOWN_CULPRIT = "<unknown>"
MESSAGE_CULPRIT = "<message>"
UNKNOWN_TITLE = "<unknown error>"
MESSAGE_TITLE_CHARS = 200
KIND_STACK, KIND_TYPE, KIND_MESSAGE = "stacktrace", "type+message", "message"
# ---- end of fixed values ---------------------------------------------------------------------


@dataclass(frozen=True)
class GroupingRules:
    """In-app patterns: substrings looked for in the normalised module of an unflagged frame."""

    in_app_exclude: tuple[str, ...] = IN_APP_EXCLUDE
    in_app_include: tuple[str, ...] = ()


DEFAULT_RULES = GroupingRules()


def picked_exception(exception: Column) -> Column:
    """The most recent exception of the chain, NULL for none."""
    return F.try_element_at(exception["values"], F.lit(-1))


def in_app(flag: Column, module: Column, rules: GroupingRules = DEFAULT_RULES) -> Column:
    """The explicit flag, else include patterns, else exclude patterns, else true."""

    def any_of(patterns: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | module.contains(pattern)
        return hit

    return F.coalesce(flag, any_of(rules.in_app_include) | ~any_of(rules.in_app_exclude))


def frame_signatures(frames: Column) -> Column:
    """array<struct<module,function,flag>> with both names normalised; empty for NULL frames."""
    cleaned = F.transform(
        frames,
        lambda f: F.struct(
            clean_path(F.coalesce(non_blank(f["module"]), f["filename"])).alias("path"),
            blank(F.coalesce(non_blank(f["module"]), f["filename"])).alias("unknown"),
            f["function"].alias("name"),
            strip(f["function"]).alias("stripped"),
            f["in_app"].alias("flag"),
        ),
    )
    named = F.transform(
        cleaned,
        lambda f: F.struct(
            F.when(f["unknown"], UNKNOWN_MODULE).otherwise(anchor_path(f["path"])).alias("module"),
            tidy_function(f["name"], f["stripped"]).alias("function"),
            f["flag"].alias("flag"),
        ),
    )
    return F.coalesce(
        named, F.array().cast("array<struct<module:string,function:string,flag:boolean>>")
    )


def in_app_signatures(signatures: Column, rules: GroupingRules = DEFAULT_RULES) -> Column:
    return F.filter(signatures, lambda f: in_app(f["flag"], f["module"], rules))


def selected_signatures(signatures: Column, kept: Column) -> Column:
    """In-app frames, or all of them where none is in-app."""
    return F.when(F.size(kept) > 0, kept).otherwise(signatures)


def with_signatures(df: DataFrame, rules: GroupingRules = DEFAULT_RULES) -> DataFrame:
    """Add ``_exc`` (picked exception), ``_signatures`` and ``_selected``."""
    return (
        df.withColumn("_exc", picked_exception(F.col("exception")))
        .withColumn("_signatures", frame_signatures(F.col("_exc.stacktrace.frames")))
        .withColumn("_kept", in_app_signatures(F.col("_signatures"), rules))
        .withColumn("_selected", selected_signatures(F.col("_signatures"), F.col("_kept")))
        .drop("_kept")
    )


def stack_summary(frames: Column, rules: GroupingRules = DEFAULT_RULES) -> Column:
    """struct<present, components, culprit> of a frame array, in one expression.

    The intermediate arrays stay inside it instead of being written out between projections.
    """

    def summary(signatures: Column, chosen: Column) -> Column:
        top = F.try_element_at(chosen, F.lit(-1))
        return F.struct(
            (F.size(signatures) > 0).alias("present"),
            F.transform(chosen, lambda f: F.concat(f["module"], F.lit(":"), f["function"])).alias("components"),
            F.concat(top["function"], F.lit(" ("), top["module"], F.lit(")")).alias("culprit"),
        )

    def selected(signatures: Column) -> Column:
        return bind(
            in_app_signatures(signatures, rules),
            lambda kept: bind(selected_signatures(signatures, kept), lambda chosen: summary(signatures, chosen)),
        )

    return bind(frame_signatures(frames), selected)


def title(exc_type: Column, exc_value: Column, message: Column) -> Column:
    """Display title: the exception, else the message's first characters."""
    value = strip(exc_value)
    return (
        F.when(~blank(exc_type), F.when(blank(value), exc_type).otherwise(F.concat_ws(": ", exc_type, value)))
        .when(~blank(message), F.left(strip(message), F.lit(MESSAGE_TITLE_CHARS)))
        .otherwise(UNKNOWN_TITLE)
    )


def with_fingerprint(df: DataFrame, rules: GroupingRules = DEFAULT_RULES) -> DataFrame:
    """Add ``fingerprint, kind, components, culprit, type, title`` to envelope rows.

    A narrow projection.  Each step names what the next one uses more than once, so that the
    optimizer keeps the regular expressions in one place instead of repeating them.
    """
    exc_type, exc_value = F.col("_exc.type"), F.col("_exc.value")
    tag = F.concat(F.lit("type:"), F.coalesce(non_blank(exc_type), F.lit(NO_TYPE)))
    kind = F.col("kind")
    return (
        df.withColumn("_exc", picked_exception(F.col("exception")))
        .withColumn("_stack", stack_summary(F.col("_exc.stacktrace.frames"), rules))
        .withColumn(
            "kind",
            F.when(F.col("_stack.present"), KIND_STACK)
            .when(~blank(exc_type) | ~blank(exc_value), KIND_TYPE)
            .otherwise(KIND_MESSAGE),
        )
        .withColumn("_text", F.when(kind == KIND_TYPE, exc_value).when(kind == KIND_MESSAGE, F.col("message")))
        .withColumn("_text", normalize_message(F.col("_text")))
        .withColumn(
            "components",
            F.when(kind == KIND_STACK, F.concat(F.array(tag), F.col("_stack.components")))
            .when(kind == KIND_TYPE, F.array(tag, F.concat(F.lit("value:"), F.col("_text"))))
            .otherwise(F.array(F.concat(F.lit("message:"), F.col("_text")))),
        )
        .withColumn("fingerprint", F.sha1(F.array_join("components", "\n")))
        .withColumn(
            "culprit",
            F.when(kind == KIND_STACK, F.col("_stack.culprit"))
            .when(kind == KIND_TYPE, F.coalesce(non_blank(exc_type), F.lit(UNKNOWN_CULPRIT)))
            .otherwise(F.coalesce(non_blank(F.col("transaction")), F.lit(MESSAGE_CULPRIT))),
        )
        .withColumn("type", exc_type)
        .withColumn("title", title(exc_type, exc_value, F.col("message")))
        .drop("_exc", "_stack", "_text")
    )
