from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from issueforge.functions.fingerprint import GroupingRules, with_fingerprint

from .rows import envelope, frame, typed


def prints(spark, docs, rules=GroupingRules()):
    rows = with_fingerprint(typed(spark, docs), rules).orderBy("seq").collect()
    return [r.fingerprint for r in rows], rows


PAIRS = [
    # (same group?, one, other)
    (True, dict(frames=[frame("render", "src/a.js", 10, 3)]), dict(frames=[frame("render", "src/a.js", 42, 99)])),
    (True, dict(etype="RangeError", value="near 0xdeadbeef", frames=[frame("walk", "src/tree.js", 5)]),
     dict(etype="RangeError", value="near 0xcafef00d", frames=[frame("walk", "src/tree.js", 7)])),
    (True, dict(message="User 12345 not found in region 'us-east'"), dict(message="User 67890 not found in region 'eu-west'")),
    (True, dict(frames=[frame("processPayment", "src/pay.js")]), dict(frames=[frame("async processPayment", "src/pay.js")])),
    (True, dict(frames=[frame("h", "node_modules/express@4.18.2/r.js", in_app=False), frame("auth", "src/auth.js")]),
     dict(frames=[frame("h", "node_modules/express@4.19.0/r.js", in_app=False), frame("auth", "src/auth.js")])),
    (True, dict(frames=[frame("a", "node_modules/x/l.js", in_app=False), frame("m", "src/h.js")]),
     dict(frames=[frame("b", "node_modules/y/o.js", in_app=False), frame("m", "src/h.js")])),
    (False, dict(frames=[frame("renderUserCard", "src/UserCard.js")]), dict(frames=[frame("formatPrice", "src/money.js")])),
    (False, dict(frames=[frame("handle", "src/h.js"), frame("applyDiscount", "src/c.js")]),
     dict(frames=[frame("handle", "src/h.js"), frame("formatPrice", "src/m.js")])),
    (False, dict(etype="TypeError", frames=[frame("f", "src/x.js")]), dict(etype="ReferenceError", frames=[frame("f", "src/x.js")])),
    (False, dict(message="disk is full"), dict(message="permission denied")),
    (False, dict(frames=[frame("a", "node_modules/x/l.js", in_app=False)]), dict(frames=[frame("b", "node_modules/y/l.js", in_app=False)])),
    # an exception with nothing in it falls through to the (empty) message
    (True, dict(etype=None, value=None), dict(etype="", value="", frames=[])),
]


def test_pairs(spark):
    docs = [envelope(**side) for _, *sides in PAIRS for side in sides]
    hashes, _ = prints(spark, docs)
    for i, (same, *_sides) in enumerate(PAIRS):
        assert (hashes[2 * i] == hashes[2 * i + 1]) is same, PAIRS[i]
    assert prints(spark, docs)[0] == hashes


def test_custom_rules(spark):
    docs = [envelope(frames=[frame("v", "vendor/lib.js", in_app=None), frame("app", "src/app.js", in_app=None)])]
    _, rows = prints(spark, docs, GroupingRules(in_app_exclude=("vendor/",)))
    assert rows[0].components == ["type:TypeError", "src/app.js:app"]
    _, rows = prints(spark, docs, GroupingRules(in_app_exclude=("vendor/", "src/"), in_app_include=("vendor/lib",)))
    assert rows[0].components == ["type:TypeError", "vendor/lib.js:v"]


def test_parts_titles_and_culprits(spark):
    chain = {"values": [{"type": "Inner", "value": "x"}, {"type": "Outer", "value": " y ", "stacktrace": None}]}
    docs = [
        envelope(exception=chain),
        envelope(etype=None, value="failed 12 times"),
        envelope(etype="E", value="  ", frames=[frame("", "", module="m.js"), frame("  ", "x.js", in_app=None)]),
        envelope(message="  " + "z" * 300, transaction="GET /"),
        envelope(message="m", transaction=""),
        envelope(etype="E", value="caf\u00e9 'x'"),
    ]
    hashes, rows = prints(spark, docs)
    assert rows[0].components == ["type:Outer", "value:y"] and rows[0].title == "Outer: y" and rows[0].culprit == "Outer"
    assert rows[1].components == ["type:<none>", "value:failed <num> times"]
    assert rows[1].title == "<unknown error>" and rows[1].culprit == "<unknown>"
    assert rows[2].components == ["type:E", "m.js:<anonymous>", "x.js:"] and rows[2].title == "E"
    assert rows[2].culprit == " (x.js)" and rows[2].kind == "stacktrace"
    assert rows[3].title == "z" * 200 and rows[3].culprit == "GET /" and rows[3].kind == "message"
    assert rows[4].culprit == "<message>" and rows[4].components == ["message:m"]
    for value, row in zip(hashes, rows):
        assert value == hashlib.sha1("\n".join(row.components).encode()).hexdigest()


def test_exclusion_is_a_substring_test(spark):
    docs = [envelope(frames=[frame("a", "src/internal/x.js", in_app=None), frame("b", "node:fs", in_app=None)])]
    _, rows = prints(spark, docs)
    assert rows[0].components == ["type:TypeError", "node:fs:b"]
    assert with_fingerprint(typed(spark, docs)).select(F.size("components")).first()[0] == 2
