from __future__ import annotations

import random

import numpy as np

from issueforge.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain, bad, worse = ([f"{p}{i}" for i in range(k)] for p, k in (("w", 80), ("bad", 6), ("worse", 6)))
    rows = []
    for i in range(n):
        grade = rng.choices([0, 1, 2], [6, 3, 2])[0]
        words = rng.choices(plain, k=rng.randint(5, 60))
        words += rng.choices(bad, k=3) if grade == 1 else rng.choices(worse, k=3) if grade == 2 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words).title(), grade))
    return rows


def test_grades_are_learned_and_ordered(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    labels = docs.select("doc_id", "grade").filter("doc_id % 2 = 0")
    model = toxicity.train(docs.drop("grade"), labels)
    assert (np.diff(model.thresholds) >= 0).all() and len(model.words) < 60
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    held = [(got[d], g) for d, _, g in rows if d % 2]
    assert np.mean([r["grade"] == g for r, g in held]) > 0.95
    means = [np.mean([r["expected_severity"] for r, g in held if g == k]) for k in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    assert all(0 <= r["expected_severity"] <= 2 and r["rejected"] == (r["expected_severity"] >= 0.3) for r in got.values())


def test_gradient_is_right():
    """One-feature fit without penalty reaches the likelihood's optimum found by a grid."""
    rng = np.random.default_rng(0)
    x = rng.random(400) < 0.5
    grade = (rng.logistic(size=400) + 2 * x > 0).astype(int) + (rng.logistic(size=400) + 2 * x > 2).astype(int)
    row = np.flatnonzero(x)
    model = toxicity.fit_ordinal(row, np.full(len(row), 7, np.uint64), grade, penalty=0.0, steps=3000)

    def loss(w, th):
        cdf = 1 / (1 + np.exp(-(np.array(th)[None, :] - w * x[:, None])))
        p = np.diff(np.hstack([np.zeros((400, 1)), cdf, np.ones((400, 1))]), axis=1)
        return -np.log(p[np.arange(400), grade]).sum()

    best = loss(model.weights[0], model.thresholds)
    for dw in (-0.05, 0, 0.05):
        for d1 in (-0.05, 0, 0.05):
            for d2 in (-0.05, 0, 0.05):
                assert loss(model.weights[0] + dw, model.thresholds + [d1, d2]) >= best - 1e-3


def test_given_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter("doc_id % 4 > 0"))
    rows = toxicity.severity(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    toxic = [r["rejected"] for r in rows if r["toxic"]]
    clean = [r["rejected"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.03, (np.mean(toxic), np.mean(clean))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (None, "bad0", 1), (3, "bad0 " * 50_000, 2), (3, "bad0", 2)], "doc_id long, text string, grade int"
    )
    model = toxicity.train(
        spark.createDataFrame(corpus(), "doc_id long, text string, grade int"),
        spark.createDataFrame([(d, g) for d, _, g in corpus()] + [(None, 1), (7, None)], "doc_id long, grade int"),
    )
    got = toxicity.severity(docs, model).collect()
    assert len(got) == 5 and [r["rejected"] for r in got] == [False, False, True, True, True]
    none = toxicity.train(docs.limit(0), docs.select("doc_id", "grade").limit(0))
    assert not any(r["rejected"] for r in toxicity.severity(docs, none).collect())
    assert toxicity.severity(docs.limit(0), model).count() == 0
    only = toxicity.train(docs, docs.select("doc_id", F_zero().alias("toxic")))
    assert not any(r["rejected"] for r in toxicity.severity(docs, only).collect())


def F_zero():
    from pyspark.sql import functions as F

    return F.lit(0)
