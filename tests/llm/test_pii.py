from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from issueforge.llm import pii
from issueforge.llm.tagger import ALPHABET, Tagger


def brute(text):
    """The patterns as given, by plain regular expressions."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and pii._luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    return sorted(
        ((*m.span(), k) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m[0])), key=lambda s: (s[0], s[2])
    )


def test_base_spans_match_plain_patterns():
    rng = random.Random(5)
    alphabet = ["a", "B", "@", ".", ".", "1", "2", "55", "256", "0", "-", " ", "+", "(", ")", "é", "_", "4111111111111111", "x@y.z"]
    for _ in range(6000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 60_000, "a" * 100_000 + "@b" * 1000):
        pii.base_spans(text)


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    tagger = Tagger(5, hidden=3)
    ids, tags = rng.integers(0, ALPHABET, (4, 7)), rng.integers(0, 5, (4, 7))
    tagger.p["trans"], tagger.p["start"] = rng.normal(size=(5, 5)), rng.normal(size=5)
    _, grads = tagger.loss(ids, tags)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            if name.endswith("W"):
                at = (ids[rng.integers(4), rng.integers(7)], at[1])
            kept, step = tagger.p[name][at], 1e-5
            values = []
            for sign in (1, -1):
                tagger.p[name][at] = kept + sign * step
                values.append(tagger.loss(ids, tags)[0])
            tagger.p[name][at] = kept
            assert abs((values[0] - values[1]) / (2 * step) - g[at]) < 1e-6, name


def test_best_path_is_the_most_likely_one():
    rng = np.random.default_rng(1)
    tagger = Tagger(3, hidden=2)
    tagger.p["trans"] = rng.normal(size=(3, 3))
    ids = rng.integers(0, ALPHABET, (1, 4))
    paths = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1).T
    best = min(paths, key=lambda p: tagger.loss(ids, p[None, :])[0])
    path, sure = tagger.decode(ids)
    assert path[0].tolist() == best.tolist() and ((sure > 0) & (sure <= 1)).all()


def test_spans_cross_windows():
    text = "x" * 20 + "1" * 60 + "y" * 40
    starts = pii.cores(text)
    tags = pii.tagged(text, [(20, 80, 2)])
    padded = np.concatenate([np.zeros(16, np.int64), tags, np.zeros(64, np.int64)])
    paths = np.stack([padded[s : s + pii.WINDOW] for s in starts])
    assert pii.reconciled(starts, paths, np.ones(paths.shape), len(text)) == [(20, 80, 2, 1.0)]


def test_detection(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = {5000: None, 5001: "", 5002: "7" * 50_000, 5003: "é +1 (217) 555-0142 日 a@b.co", 5004: "Call (217) 555-0142 now."}
    texts |= odd
    rows = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, marked int")
    got = {r["doc_id"]: r for r in pii.detect(rows, pii.train(docs)).collect()}
    assert set(got) == set(texts)
    added = 0
    for doc, text in texts.items():
        base = brute(text) if doc != 5002 and text else []
        r = got[doc]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)
        added += len(spans) - len(base)
    assert "phone:5:19" in got[5004]["spans"] and added < 60
    empty = pii.detect(rows.limit(0), pii.train(rows.limit(0)))
    assert empty.count() == 0


def test_held_out_accuracy(spark, sf_dir):
    """The tagger alone finds the spans the patterns find in documents it was not trained on."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet").filter("doc_id < 5000")
    tagger = pii.train(docs.filter("doc_id % 2 = 0"))
    hit = missed = 0
    for r in docs.filter("doc_id % 2 = 1 and text rlike '[0-9@]'").collect():
        base = [s for s in pii.base_spans(r["text"]) if s[2] != 2]
        starts = pii.cores(r["text"])
        paths, sure = tagger.decode(pii.windows(r["text"], starts))
        found = {s[:3] for s in pii.reconciled(starts, paths, sure, len(r["text"]))}
        hit += sum(s in found for s in base)
        missed += sum(s not in found for s in base)
    assert hit > 20 and hit / (hit + missed) > 0.9, (hit, missed)
