from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issueforge.functions import sql, text

PY_RULES = [
    (r"0x[0-9a-fA-F]+", "<addr>"),
    (r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<email>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<hex>"),
    (r"'[^']*'|\"[^\"]*\"", "<str>"),
    (r"(?<![\w.])\d+", "<num>"),
    (r"\s+", " "),
]


def truth(message):
    out = (message or "").strip()
    for pattern, to in PY_RULES:
        out = re.sub(pattern, to, out)
    return out.strip()


def applied(spark, function, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", function(F.col("v")).alias("o"))
    return [r.o for r in sorted(df.collect())]


EDGES = [
    None, "", "   ", "\u3000x\u2003", "\x1c a \x1f", "a\x0bb\x85c\xa0d", "\u0664\u0665 items", "x\u0664", "caf\u00e90xff",
    "utf8 s3 v1.2 sha256", "2000ms 512MB", "can't do 7 won't", 'say "hi 5" now', "deadbeefdeadbeef",
    "\u00e9deadbeefdeadbeef", "deadbeefdeadbeef\u00e9", "deadbeefdeadbee", "xdeadbeefdeadbeef", "0xDEADBEEF0x1",
    "123e4567-e89b-12d3-a456-426614174000", "x123e4567-e89b-12d3-a456-426614174000",
    "\u00e9123e4567-e89b-12d3-a456-426614174000 ", "mail bob@x.com!", ".a@b.c-", "+a@b.co", "a@b", "a@@b.c d@e.f",
    "\u00fcser@b\u00fccher.de,", "a.b+c@d-e.f.g.", "@x.y", "a@b.c@d.e", "one  two\n\tthree", "9", ".5 -5 _5 a5 5a",
    "User 12345 at 0xff for 'bob@x.com'",
]


def test_message_edges(spark):
    assert applied(spark, text.normalize_message, EDGES) == [truth(v) for v in EDGES]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.text(st.sampled_from(list("ab9f0x.@+-_'\" \t\n\u00e9\u0664\u2003\x1c{}")), max_size=40), min_size=120, max_size=200
    )
)
def test_message_random(spark, values):
    assert applied(spark, text.normalize_message, values) == [truth(v) for v in values]


def test_message_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.normalize_message(F.col("text")).alias("n"))
    assert all(r.n == truth(r.text) for r in docs.collect())


@pytest.mark.parametrize(
    "name, expected",
    [(None, "<anonymous>"), ("", "<anonymous>"), ("?", "<anonymous>"), (" eval ", "<anonymous>"), ("async eval", "eval"),
     ("Object.<anonymous>", "<anonymous>"), ("async foo", "foo"), ("  ", ""), ("foo", "foo")],
)
def test_function(spark, name, expected):
    assert applied(spark, text.normalize_function, [name]) == [expected]


MODULES = {
    None: "<unknown>", "": "<unknown>", "/Users/x/proj/src/a.js": "src/a.js",
    "node_modules/pkg@1.2.3/index.js": "node_modules/pkg/index.js", "webpack:///src/b.js?v=2": "src/b.js",
    "src/lib/http.js": "lib/http.js", "/x/src/lib/http.js": "src/lib/http.js", "C:\\app\\x.js": "app/x.js"[0:0] + "app/x.js",
    "node:internal/process/task_queues": "node:internal/process/task_queues", "/a/node_modules/b/node_modules/c@1.2.3-rc.1/i.js":
    "node_modules/c-rc.1/i.js", "HTTP://x/y": "HTTP://x/y", "/plain/file.js#L3": "plain/file.js", "//x": "x",
    "a@1.2.3?q@4.5.6": "a", "a?x\nb": "a?x\nb", "a?x\nb?y": "a?x\nb",
}


def test_module(spark):
    assert applied(spark, text.normalize_module, list(MODULES)) == list(MODULES.values())


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    spark.createDataFrame([(i, v) for i, v in enumerate(EDGES)], "i int, v string").createOrReplaceTempView("edges")
    got = [r.o for r in spark.sql("SELECT normalize_message(v) o FROM edges ORDER BY i").collect()]
    assert got == [truth(v) for v in EDGES]
    spark.createDataFrame([(i, v) for i, v in enumerate(MODULES)], "i int, v string").createOrReplaceTempView("mods")
    got = [r.o for r in spark.sql("SELECT normalize_module(v) o FROM mods ORDER BY i").collect()]
    assert got == list(MODULES.values())
    got = spark.sql("SELECT normalize_function(' async run ') a, normalize_function(NULL) b, normalize_function(' ') c").first()
    assert tuple(got) == ("run", "<anonymous>", "")
