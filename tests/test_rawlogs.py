from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from issueforge.functions.stack import parse_stack
from issueforge.operators import rawlogs
from issueforge.schema import BREADCRUMB_TYPE

SAMPLE = """TypeError: Cannot read properties of undefined (reading 'name')
    at renderUserCard (/app/src/components/UserCard.js:48:17)
    at renderProfile (/app/src/components/Profile.js:112:9)
    at handleRequest (/app/src/server/handler.js:30:5)
    at Layer.handle (/app/node_modules/express/lib/router/layer.js:95:5)
    at processTicksAndRejections (node:internal/process/task_queues:95:5)"""


def frames(spark, stack, root="/app"):
    df = spark.createDataFrame([(stack, root)], "s string, r string")
    return df.select(parse_stack(F.col("s"), F.col("r")).alias("f")).first().f


def test_sample(spark):
    got = frames(spark, SAMPLE)
    assert len(got) == 5
    top = got[-1]
    assert (top.function, top.filename, top.lineno, top.colno, top.in_app) == ("renderUserCard", "src/components/UserCard.js", 48, 17, True)
    assert [f.filename for f in got if f.function == "handleRequest"] == ["src/server/handler.js"]
    assert [f.in_app for f in got] == [False, False, True, True, True]
    assert got[0].filename == "node:internal/process/task_queues" and "node_modules" in got[1].filename


CASES = [
    ("E: x\n    at /app/src/a.js:5:1\n    at Object.<anonymous> (/app/src/b.js:1:1)", "/app",
     [("<anonymous>", "src/b.js", True), ("<anonymous>", "src/a.js", True)]),
    ("E: x\n    at async processPayment (/app/src/pay.js:8:3)\r", "/app//", [("async processPayment", "src/pay.js", True)]),
    ("  at f (file:///srv/x.js:1:2)", "/app", [("f", "/srv/x.js", False)]),
    ("  at f (/app2/x.js:1:2)", "/app", [("f", "2/x.js", True)]),
    ("  at f (C:\\w\\x.js:1:2)", "/app", [("f", "C:\\w\\x.js", False)]),
    ("  at f (rel/x.js:1:2)", "/app", [("f", "rel/x.js", True)]),
    ("  at f (/x.js:1:2)", "", [("f", "/x.js", True)]),
    ("  at f (events.js:1:2)\n  at new Foo (timers.js:3:4)", "/", [("new Foo", "timers.js", False), ("f", "events.js", False)]),
    ("  at native\n  at f (native)", "/app", []),
    (None, "/app", []),
]


@pytest.mark.parametrize("stack, root, expected", CASES)
def test_cases(spark, stack, root, expected):
    assert [(f.function, f.filename, f.in_app) for f in frames(spark, stack, root)] == expected


def test_envelopes(spark):
    schema = "client string, kind string, name string, message string, stack string, app_root string, level string, project string, release string, environment string, server_name string, tags map<string,string>, seq bigint, received_us bigint"
    row = lambda seq, kind, name, msg, stack, level=None, project=None: ("c", kind, name, msg, stack, "/app", level, project, "r", "e", None, None, seq, seq)
    raw = spark.createDataFrame(
        [row(0, "captured", "TypeError", "boom", SAMPLE), row(1, "uncaught", "", None, None), row(2, "unhandled", None, "x", None, project="p"),
         row(3, "message", None, "cache miss", None), row(4, "message", None, "m", None, "warning")], schema)
    got = rawlogs.build_envelopes(raw, "src").orderBy("seq").collect()
    assert [r.level for r in got] == ["error", "fatal", "error", "info", "warning"]
    assert [r.project for r in got] == ["default", "default", "p", "default", "default"]
    assert [r.exception and r.exception["values"][0].type for r in got] == ["TypeError", "Error", "Error", None, None]
    assert got[1].exception["values"][0].value == "" and got[1].exception["values"][0].stacktrace.frames == []
    assert got[3].message == "cache miss" and got[0].message is None and len({r.event_id for r in got}) == 5
    again = rawlogs.build_envelopes(raw, "src").orderBy("seq").collect()
    assert [r.event_id for r in again] == [r.event_id for r in got]


def crumb():
    return F.struct(F.lit(0.0).alias("timestamp"), F.lit("c").alias("category"), F.col("m").alias("message"), F.lit("info").alias("level"),
                    F.parse_json(F.lit("{}")).alias("data"))


@pytest.mark.parametrize("last", [0, 1, 3, 50])
def test_breadcrumbs(spark, last):
    rng = random.Random(last)
    rows = [(f"c{0 if rng.random() < 0.5 else rng.randrange(4)}", i, rng.random() < 0.6) for i in range(400)]
    rows += [("quiet", 1000, False), ("only", 1001, True)]
    buffers, expected = {}, {}
    for client, seq, is_crumb in rows:
        kept = buffers.setdefault(client, [])
        if is_crumb:
            kept.append(f"m{seq}")
            del kept[: max(0, len(kept) - last)]
        else:
            expected[seq] = list(kept) if last else []
    df = spark.createDataFrame(rows, "client string, seq bigint, is_crumb boolean")
    crumbs = df.filter("is_crumb").withColumn("m", F.concat(F.lit("m"), F.col("seq").cast("string"))).withColumn("c", crumb())
    events = df.filter("NOT is_crumb").select("client", "seq")
    got = rawlogs.attach_breadcrumbs(events, crumbs.select("client", "seq", "c"), F.col("c"), last)
    assert got.schema["breadcrumbs"].dataType.simpleString() == f"array<{BREADCRUMB_TYPE}>"
    assert {r.seq: [c.message for c in r.breadcrumbs] for r in got.collect()} == expected
