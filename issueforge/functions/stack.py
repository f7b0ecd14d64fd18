"""V8 stack text -> frames, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from issueforge.functions.text import ANONYMOUS, blank
from issueforge.schema import FRAME_TYPE

# ---- fixed values: ECMAScript's white space and line terminators, spelled out for Java ----------
JS_TRIM = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ASCII first, the rare rest behind one range test
JS_SPACE = r"[\t-\r \xa0[\u1680-\ufeff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
JS_ANY = r"[^\n\r\u2028\u2029]"
FRAME_LINE = (
    rf"^{JS_SPACE}*at{JS_SPACE}+(?:({JS_ANY}+?){JS_SPACE}+\()?({JS_ANY}+?):([0-9]+):([0-9]+)\)?{JS_SPACE}*\z"
)
RUNTIME_FILE = r"^(node:|internal/|events\.js|timers\.js)"
PACKAGE_FOLDER = "node_modules"
FILE_SCHEME = "^file://"
DRIVE_PATH = r"^[A-Za-z]:[\\/]"
ROOT_TAIL = r"[\\/]+\z"
ROOT_HEAD = r"^[\\/]+"
TOP_LEVEL = "Object.<anonymous>"
# ---- end of fixed values -----------------------------------------------------------------------


SEPARATOR = "\x01"


def _trim(value: Column) -> Column:
    return F.btrim(value, F.lit(JS_TRIM))


def stack_lines(stack: Column) -> Column:
    """Frame lines of a stack text, oldest call first; empty for a NULL stack."""
    lines = F.filter(F.split(stack, "\n"), lambda line: line.contains(":") & line.rlike(FRAME_LINE))
    return F.coalesce(F.reverse(lines), F.array().cast("array<string>"))


def _groups(line: Column) -> Column:
    """The pattern's four groups with one match instead of four.

    The groups are joined by a control character; a line that contains it is matched per group.
    """
    joined = F.regexp_replace(line, FRAME_LINE, f"$1{SEPARATOR}$2{SEPARATOR}$3{SEPARATOR}$4")
    return F.when(
        ~line.contains(SEPARATOR), F.split(joined, SEPARATOR)
    ).otherwise(F.array(*[F.regexp_extract(line, FRAME_LINE, g) for g in (1, 2, 3, 4)]))


def raw_frames(stack: Column) -> Column:
    """array<struct<function,file,lineno,colno>> as written, the file without its scheme."""
    return F.transform(
        F.transform(stack_lines(stack), _groups),
        lambda g: F.struct(
            _trim(g[0]).alias("function"),
            F.regexp_replace(_trim(g[1]), FILE_SCHEME, "").alias("file"),
            g[2].try_cast("bigint").alias("lineno"),
            g[3].try_cast("bigint").alias("colno"),
        ),
    )


def app_frames(frames: Column, app_root: Column) -> Column:
    """B2: raw frames -> envelope frames relative to the application root.

    The root is a plain prefix: ``/app`` also covers ``/app2``.
    """
    root = F.coalesce(F.regexp_replace(app_root, ROOT_TAIL, ""), F.lit(""))

    def frame(f: Column) -> Column:
        file = f["file"]
        runtime = file.rlike(RUNTIME_FILE)
        under_root = file.startswith(root)
        absolute = file.startswith("/") | file.rlike(DRIVE_PATH)
        relative = F.when(
            ~runtime & (root != "") & under_root,
            F.regexp_replace(F.substr(file, F.length(root) + 1), ROOT_HEAD, ""),
        ).otherwise(file)
        name = f["function"]
        return F.struct(
            F.when(blank(name) | name.isin(ANONYMOUS, TOP_LEVEL), ANONYMOUS).otherwise(name).alias("function"),
            relative.alias("filename"),
            F.lit(None).cast("string").alias("module"),
            f["lineno"].alias("lineno"),
            f["colno"].alias("colno"),
            (~runtime & ~file.contains(PACKAGE_FOLDER) & (under_root | ~absolute)).alias("in_app"),
            F.lit(None).cast("string").alias("context_line"),
        )

    return F.transform(frames, frame).cast(f"array<{FRAME_TYPE}>")


def parse_stack(stack: Column, app_root: Column) -> Column:
    """B1 + B2"""
    return app_frames(raw_frames(stack), app_root)
