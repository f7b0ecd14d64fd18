"""Normalisers for messages, function names and module paths, as Column expressions.

Nothing here leaves the JVM.  Texts follow Unicode rules for word characters, digits and white
space, which Java's regular expressions only do when asked, hence the explicit classes below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: these decide the fingerprint and must not change --------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"  # Unicode aware under (?U)
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
HEX = "[0-9a-fA-F]"
# (pattern, placeholder, literals of which every match must contain one), in order of application.
# A cheap look-ahead comes first where the rule proper starts with a look-behind: it fails on the
# first character almost everywhere.  A single blank is left alone instead of being rewritten.
MESSAGE_RULES = (
    (rf"0x{HEX}+", "<addr>", ("0x",)),
    (
        rf"(?={HEX}{{8}}-)(?<!{WORD}){HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}(?!{WORD})",
        "<uuid>",
        ("-",),
    ),
    (rf"{EDGE}[\p{{L}}\p{{N}}_.+-]++@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+{EDGE}", "<email>", ("@",)),
    (rf"(?={HEX}{{16}})(?<!{WORD}){HEX}{{16,}}+(?!{WORD})", "<hex>", ()),
    (r"""'[^']*'|"[^"]*\"""", "<str>", ("'", '"')),
    (r"(?=\p{Nd})(?<![\p{L}\p{N}_.])\p{Nd}++", "<num>", ()),
    (rf"(?U) {SPACE}+|[\s\x1c-\x1f&&[^ ]]{SPACE}*", " ", ()),
)
ANONYMOUS = "<anonymous>"
ANONYMOUS_NAMES = ("?", "<anonymous>", "<unknown>", "eval")
UNKNOWN_MODULE = "<unknown>"
ASYNC_MARKER = "async "
URL_SCHEME = r"^[a-z]+://"
QUERY_OR_HASH = r"[?#].*$"
PACKAGE_VERSION = r"@\p{Nd}+\.\p{Nd}+\.\p{Nd}+"
NODE_BUILTIN = "node:"
PACKAGE_DIR = "node_modules/"
APP_MARKERS = ("/src/", "/dist/", "/build/", "/lib/", "/app/")
# ---- end of fixed values ---------------------------------------------------------------------


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def blank(value: Column) -> Column:
    """True for SQL NULL and for the empty string."""
    return value.isNull() | (value == "")


def non_blank(value: Column) -> Column:
    """The value, or NULL where it is the empty string."""
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    """Drop Unicode white space at both ends (``trim`` alone only knows U+0020)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def normalize_message(message: Column) -> Column:
    """Replace what varies between occurrences (ids, addresses, quoted data) by placeholders."""
    text = strip(message)
    for pattern, placeholder, needs in MESSAGE_RULES:
        text = _rewrite(text, pattern, placeholder, needs)
    return F.coalesce(F.trim(text), F.lit(""))


def _rewrite(text: Column, pattern: str, placeholder: str, needs: tuple[str, ...]) -> Column:
    if not needs:
        return F.regexp_replace(text, pattern, placeholder)

    def guarded(t: Column) -> Column:
        present = t.contains(needs[0])
        for literal in needs[1:]:
            present = present | t.contains(literal)
        return F.when(present, F.regexp_replace(t, pattern, placeholder)).otherwise(t)

    return bind(text, guarded)


def tidy_function(name: Column, stripped: Column) -> Column:
    """`normalize_function` of a name whose stripped form is at hand."""
    return (
        F.when(blank(name), ANONYMOUS)
        .when(stripped.isin(*ANONYMOUS_NAMES) | stripped.endswith("." + ANONYMOUS), ANONYMOUS)
        .when(stripped.startswith(ASYNC_MARKER), F.substr(stripped, F.lit(len(ASYNC_MARKER) + 1)))
        .otherwise(stripped)
    )


def normalize_function(name: Column) -> Column:
    """A frame's function name without wrappers and the async marker."""
    return F.when(blank(name), ANONYMOUS).otherwise(bind(strip(name), lambda f: tidy_function(name, f)))


def clean_path(path: Column) -> Column:
    """First half of `normalize_module`: slashes, then scheme, query and version in one pass.

    The three patterns cannot overlap or create matches for each other, so one alternation gives
    what three rewrites in a row would.  (?d): only a line feed ends a line.
    """
    return F.regexp_replace(
        F.replace(strip(path), F.lit("\\"), F.lit("/")),
        f"(?d){URL_SCHEME}|{QUERY_OR_HASH}|{PACKAGE_VERSION}",
        "",
    )


def anchor_path(p: Column) -> Column:
    """Second half: keep the part of a cleaned path that is the same on every machine."""
    anchored = F.when(p.startswith(NODE_BUILTIN), p).when(
        p.contains(PACKAGE_DIR),
        F.concat(F.lit(PACKAGE_DIR), F.substring_index(p, PACKAGE_DIR, -1)),
    )
    for marker in APP_MARKERS:
        anchored = anchored.when(p.contains(marker), F.substr(p, F.locate(marker, p) + 1))
    return anchored.otherwise(F.ltrim(p, F.lit("/")))


def normalize_module(path: Column) -> Column:
    """A module or file path reduced to a machine-independent key."""
    return F.when(blank(path), UNKNOWN_MODULE).otherwise(bind(clean_path(path), anchor_path))
