"""The normalisers and the fingerprint digest as SQL functions.

They are SQL-bodied temporary functions: the optimizer inlines the body, nothing is a UDF at run
time.  The bodies are rendered from the same fixed patterns as the Column forms.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from issueforge.functions.text import (
    ANONYMOUS,
    ANONYMOUS_NAMES,
    APP_MARKERS,
    ASYNC_MARKER,
    MESSAGE_RULES,
    NODE_BUILTIN,
    PACKAGE_DIR,
    PACKAGE_VERSION,
    QUERY_OR_HASH,
    UNKNOWN_MODULE,
    URL_SCHEME,
    WHITE_SPACE,
)


def literal(text: str) -> str:
    """A SQL string literal; every character outside plain ASCII letters and such is escaped."""
    safe = "".join(c if c.isalnum() and c.isascii() or c in " <>.:/@_-+*?#()[]{}|^$,&!=~;" else f"\\u{ord(c):04x}" for c in text)
    return f"'{safe}'"


def _strip(x: str) -> str:
    return f"btrim({x}, {literal(WHITE_SPACE)})"


def _message_body() -> str:
    body = _strip("msg")
    for pattern, placeholder, _ in MESSAGE_RULES:
        body = f"regexp_replace({body}, {literal(pattern)}, {literal(placeholder)})"
    return f"coalesce(trim({body}), '')"


def _bind(value: str, body: str) -> str:
    return f"transform(array({value}), v -> {body})[0]"


def _function_body() -> str:
    names = ", ".join(literal(n) for n in ANONYMOUS_NAMES)
    picked = (
        f"CASE WHEN v IN ({names}) OR endswith(v, {literal('.' + ANONYMOUS)}) THEN {literal(ANONYMOUS)} "
        f"WHEN startswith(v, {literal(ASYNC_MARKER)}) THEN substr(v, {len(ASYNC_MARKER) + 1}) ELSE v END"
    )
    return f"CASE WHEN fn IS NULL OR fn = '' THEN {literal(ANONYMOUS)} ELSE {_bind(_strip('fn'), picked)} END"


def _module_body() -> str:
    cleaned = (
        f"regexp_replace(replace({_strip('path')}, {literal(chr(92))}, '/'), "
        f"{literal(f'(?d){URL_SCHEME}|{QUERY_OR_HASH}|{PACKAGE_VERSION}')}, '')"
    )
    package = literal(PACKAGE_DIR)
    cases = [
        f"WHEN startswith(v, {literal(NODE_BUILTIN)}) THEN v",
        f"WHEN contains(v, {package}) THEN concat({package}, substring_index(v, {package}, -1))",
        *[f"WHEN contains(v, {literal(m)}) THEN substr(v, locate({literal(m)}, v) + 1)" for m in APP_MARKERS],
    ]
    picked = f"CASE {' '.join(cases)} ELSE ltrim('/', v) END"
    return f"CASE WHEN path IS NULL OR path = '' THEN {literal(UNKNOWN_MODULE)} ELSE {_bind(cleaned, picked)} END"


FUNCTIONS = {
    "normalize_message": ("msg STRING", "STRING", _message_body),
    "normalize_function": ("fn STRING", "STRING", _function_body),
    "normalize_module": ("path STRING", "STRING", _module_body),
    "fingerprint_of": ("components ARRAY<STRING>", "STRING", lambda: r"sha1(array_join(components, '\u000a'))"),
}


def register(spark: SparkSession) -> list[str]:
    """create the temporary SQL functions in this session and return their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body()}")
    return list(FUNCTIONS)
