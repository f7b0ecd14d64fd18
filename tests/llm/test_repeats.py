from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from issueforge.llm import repeats


def brute(rows, window=200):
    """Every 200-byte string of every row counted; bytes under a string counted twice or more go."""
    data = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] >= 2:
                gone[i : i + window] = [True] * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    assert df.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r[:5]) for r in df.collect()), key=repr)


def fixture():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(i, text(rnd.randint(10, 200))) for i in range(40)]
    rows += [(100, text(50) + " " + shared + " " + text(30)), (101, shared + " ü€ " + text(80)), (102, text(20) + shared[:199] + text(5))]
    rows += [(103, "a" * 1000), (104, "b" * 199 + "c" + "b" * 199), (105, None), (106, ""), (None, text(100))]
    rows += [(107, rows[3][1]), (107, rows[3][1]), (108, "x" * 100_000), (109, text(40) + " " + text(40)[:5])]
    same = text(45)
    rows += [(110, same + " middle " + same)]
    return rows


def test_fixture_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = result(repeats.repeated_strings(docs))
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by[103][2] == 1000 and by[110][2] > 0 and by[100][2] >= 200 and by[105][1:4] == (0, 0, 0)


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = result(repeats.repeated_strings(docs))
    assert got == brute(rows) and any(r[2] for r in got)


def test_anchors_shared_by_equal_strings():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        piece = bytes(rnd.integers(97, 100, 200, dtype=np.uint8))  # few letters: many tied grams
        a = bytes(rnd.integers(0, 256, rnd.integers(0, 300), dtype=np.uint8)) + piece
        b = piece + bytes(rnd.integers(0, 256, rnd.integers(0, 300), dtype=np.uint8))
        at_a, h_a = repeats.anchors_of(a)
        at_b, h_b = repeats.anchors_of(b)
        off, reach = len(a) - 200, repeats.WINDOW - repeats.GRAM
        inside_a = {(p - off, h) for p, h in zip(at_a, h_a) if off <= p <= off + reach}
        inside_b = {(p, h) for p, h in zip(at_b, h_b) if p <= reach}
        assert inside_a & inside_b


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.repeated_strings(empty).count() == 0
    t = "word " * 80
    clash = spark.createDataFrame([(1, t, 5, "x", 3), (2, t, 6, "y", 4)], "doc_id bigint, text string, _row long, _text string, at int")
    assert result(repeats.repeated_strings(clash)) == brute([(1, t), (2, t)])


def test_near_copies_store_neighbourhoods_not_strings(spark, monkeypatch):
    rnd = random.Random(11)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    base, part = text(150), text(30)
    rows = [(i, base) for i in range(6)] + [(i, f"{text(20)} {base[: 40 * i]} {text(3)} {base[40 * i :]}") for i in range(6, 20)]
    rows += [(i, text(10) + part + text(10)) for i in range(20, 30)] + [(30, base[:250]), (31, base[-230:])]
    written = {}
    keep = repeats.stage
    monkeypatch.setattr(repeats, "stage", lambda df, name, **options: written.setdefault(name, keep(df, name, **options)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert result(repeats.repeated_strings(docs)) == want
    n_strings = sum(max(len(t) - 199, 0) for _, t in rows)
    assert max(df.count() for name, df in written.items() if name != "repeats-docs") < n_strings / 8
    written.clear()
    assert result(repeats.repeated_strings(docs, group=2)) == want  # the counted way
    assert written["repeats-counted"].count()


def test_very_wide_anchors_look_up_few_strings(spark, monkeypatch):
    """Many texts that share the strings of a passage's end: blocks of strings are found, the rest looked up."""
    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(9)} {passage} {text(40)}"[rnd.randint(0, 9) :]) for i in range(40)]
    rows += [(i, passage[-rnd.randint(200, 300) :] + text(30)) for i in range(40, 80)] + [(80, passage[:215]), (81, passage[-207:])]
    written = {}
    keep = repeats.stage
    monkeypatch.setattr(repeats, "stage", lambda df, name, **options: written.setdefault(name, keep(df, name, **options)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(repeats.repeated_strings(docs, group=2)) == brute(rows)
    ones = lambda name: sum((r["low"] % 2**64).bit_count() + (r["high"] % 2**64).bit_count() for r in written[name].collect())
    found, rest = ones("repeats-blocks"), ones("repeats-strings")
    assert found > 4 * rest > 0
