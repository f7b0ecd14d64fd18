from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from issueforge.sources import envelopes

from .rows import envelope, frame, lines


def reasons(spark, docs):
    rows = envelopes.validated(lines(spark, docs)).select("seq", "reasons").collect()
    return [r.reasons for r in sorted(rows)]


def without(doc, *keys):
    return {k: v for k, v in doc.items() if k not in keys}


def test_rejects(spark):
    ok = envelope(frames=[frame("a", "src/a.js")])
    docs = [
        ok,
        {**ok, "event_id": "not-hex"}, {**ok, "event_id": "A" * 32}, {**ok, "event_id": "a" * 32 + "\n"},
        without(ok, "exception"), {**ok, "level": "explode"}, {**ok, "level": "Error"}, {**ok, "timestamp": 0},
        {**ok, "timestamp": -5}, without(ok, "event_id"), without(ok, "timestamp"), {**ok, "project": None},
        without(ok, "project", "level", "platform", "tags", "breadcrumbs", "extra"), "{\"a\": ", "[1]", "7", "null",
        {**without(ok, "exception"), "message": " \u3000\n"}, {**ok, "exception": {"values": []}}, {**ok, "exception": {}},
        {**ok, "exception": None, "message": "m"}, {**ok, "tags": None}, {**ok, "unknown": 1},
        {**ok, "level": "explode", "timestamp": 0},
    ]
    expected = [
        [], ["event_id"], ["event_id"], [], ["payload"], ["level"], ["level"], ["timestamp"], ["timestamp"],
        ["event_id missing"], ["timestamp missing"], ["type:project"], [], ["json"], ["json"], ["json"], ["json"],
        ["payload"], ["payload"], ["payload"], [], ["type:tags"], [], ["timestamp", "level"],
    ]
    assert reasons(spark, docs) == expected


TYPES = [
    # field path, value, accepted?, typed value
    ("timestamp", "12.5", True, 12.5), ("timestamp", " 7 ", True, 7.0), ("timestamp", "1_000", True, 1000.0),
    ("timestamp", True, True, 1.0), ("timestamp", "12x", False, None), ("timestamp", "1.5f", False, None),
    ("timestamp", [], False, None), ("timestamp", None, False, None), ("timestamp", 10**20, True, 1e20),
    ("level", 3, False, None), ("message", 5, False, None), ("message", None, True, None), ("release", {}, False, None),
    ("lineno", 3, True, 3), ("lineno", 3.0, True, 3), ("lineno", 3.5, False, None), ("lineno", "42", True, 42),
    ("lineno", "42.0", True, 42), ("lineno", "4.5", False, None), ("lineno", "+7", True, 7), ("lineno", True, True, 1),
    ("lineno", None, True, None), ("lineno", "", False, None), ("lineno", "1e3", False, None),
    ("in_app", True, True, True), ("in_app", 1, True, True), ("in_app", 0.0, True, False), ("in_app", "YES", True, True),
    ("in_app", "off", True, False), ("in_app", 2, False, None), ("in_app", "maybe", False, None), ("in_app", None, True, None),
    ("function", 1, False, None), ("function", None, True, None), ("context_line", "x", True, "x"),
]


def placed(path, value):
    if path in ("timestamp", "level", "message", "release"):
        return envelope(frames=[frame("a", "b")], **{path: value})
    return envelope(frames=[{**frame("a", "b"), path: value}])


def test_type_matrix(spark):
    docs = [placed(path, value) for path, value, *_ in TYPES]
    # message replaces the exception in the builder, so put one back
    for doc, (path, *_rest) in zip(docs, TYPES):
        if path == "message":
            doc["exception"] = envelope(frames=[])["exception"]
    rows = sorted(envelopes.parsed(lines(spark, docs)).collect(), key=lambda r: r.seq)
    for row, (path, value, fine, result) in zip(rows, TYPES):
        assert (row["_wrong"] == []) is fine, (path, value, row["_wrong"])
        if fine:
            got = row[path] if path in row.asDict() else row.exception["values"][0].stacktrace.frames[0][path]
            assert got == result, (path, value, got)


@pytest.mark.parametrize(
    "field, bad",
    [("exception", {"values": None}), ("exception", {"values": [1]}), ("exception", {"values": [{"type": 1}]}),
     ("exception", {"values": [{"stacktrace": {"frames": None}}]}), ("exception", {"values": [{"stacktrace": {"frames": ["x"]}}]}),
     ("exception", []), ("exception", "x"), ("tags", {"a": 1}), ("tags", []), ("breadcrumbs", None), ("breadcrumbs", [None]),
     ("breadcrumbs", [{"timestamp": "x"}]), ("breadcrumbs", [{"data": None}]), ("extra", []), ("extra", None)],
)
def test_nested_types(spark, field, bad):
    assert reasons(spark, [envelope(frames=[], **{field: bad})]) == [[f"type:{field}"]]


def test_split_keeps_every_row(spark):
    docs = [envelope(frames=[]), "{", {**envelope(frames=[]), "breadcrumbs": [{"message": "m", "data": {"a": [1]}}], "extra": {"z": None}}]
    checked = envelopes.validated(lines(spark, docs))
    good, bad = envelopes.accepted(checked), envelopes.quarantined(checked)
    assert good.count() == 2 and [(r.raw, r.reasons) for r in bad.collect()] == [("{", ["json"])]
    row = good.filter("seq = 2").selectExpr("breadcrumbs[0].message m", "to_json(breadcrumbs[0].data) d", "to_json(extra) x").first()
    assert row.m == "m" and json.loads(row.d) == {"a": [1]} and json.loads(row.x) == {"z": None}
    report = {r.reason: r.rows for r in envelopes.validation_report(checked).collect()}
    assert report == {"valid": 2, "json": 1}


def test_exception_in_one_cast_equals_field_by_field(spark):
    frame = '{"function":"f","filename":"a.js","lineno":1,"colno":null,"in_app":true}'
    traces = [
        "null", "{}", '{"frames":null}', '{"frames":[]}', '{"frames":[null]}', '{"frames":[' + frame + "]}", "7", "[]",
        '{"frames":[' + frame + ',null]}', '{"frames":[{"lineno":"7"}]}', '{"frames":[{"lineno":1.0}]}', '{"frames":{}}',
        '{"frames":[{"lineno":1,"lineno":2}]}', '{"frames":[{"in_app":1}]}', '{"frames":[{"other":1,"module":"m"}]}',
        '{"frames":[{"function":5}]}', '{"frames":[{"lineno: BIGINT, colno":1}]}', '{"frames":[[]]}',
    ]
    values = [f'{{"type":"T","stacktrace":{t}}}' for t in traces] + ["null", "{}", '{"type":3}', '{"value":"v"}', "[]", '"x"']
    lists = [f"[{v}]" for v in values] + [f"[{v},{w}]" for v in values for w in (values[3], values[5], values[2])]
    docs = [f'{{"values":{v}}}' for v in lists + ["null", "[]", "{}"]] + ["null", "{}", "[]", "1", '{"values":[],"more":1}']
    x = F.try_parse_json("raw")
    rows = spark.createDataFrame([(d,) for d in docs], "raw string").select("raw", x.alias("x"))
    got = rows.select("raw", envelopes._exception(F.col("x")).alias("a"), envelopes._exception_by_field(F.col("x")).alias("b"))
    assert got.filter("not (a <=> b)").collect() == []
    assert {r["ok"] for r in got.select("a.ok").collect()} == {True, False}
