from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from issueforge.functions.fingerprint import with_fingerprint
from issueforge.operators import evaluate, issues, metrics
from issueforge.sources import generators


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "true_label string, pred_label string").repartition(3)


def brute(pairs):
    tp = fp = fn = tn = 0
    for (t1, p1), (t2, p2) in itertools.combinations(pairs, 2):
        if p1 == p2:
            tp, fp = tp + (t1 == t2), fp + (t1 != t2)
        else:
            fn, tn = fn + (t1 == t2), tn + (t1 != t2)
    return tp, fp, fn, tn


def conditional(pairs, of, given):
    n, joint, margin = len(pairs), Counter(pairs), Counter(p[given] for p in pairs)
    whole = Counter(p[of] for p in pairs)
    h = -sum(c / n * math.log(c / n) for c in whole.values())
    rest = -sum(c / n * math.log(c / margin[pair[given]]) for pair, c in joint.items())
    return 1.0 if h == 0 else 1 - rest / h


@pytest.mark.parametrize("seed, groups, clusters", [(1, 5, 7), (2, 1, 4), (3, 6, 1), (4, 1, 1), (5, 40, 40)])
def test_against_pairs(spark, seed, groups, clusters):
    rng = random.Random(seed)
    pairs = [(f"t{rng.randrange(groups)}", f"p{rng.randrange(clusters)}") for _ in range(150)]
    df = labels(spark, pairs)
    assert tuple(map(int, evaluate.pair_confusion(df).first())) == brute(pairs)
    h, c, v = evaluate.homogeneity_completeness_v(df).first()
    assert h == pytest.approx(conditional(pairs, 0, 1), abs=1e-9) and c == pytest.approx(conditional(pairs, 1, 0), abs=1e-9)
    assert v == pytest.approx(0 if h + c == 0 else 2 * h * c / (h + c), abs=1e-9)
    merged = {(r.pred_label, r.true_label) for r in evaluate.merged_clusters(df).collect()}
    by_pred = {p: {t for t, q in pairs if q == p} for _, p in pairs}
    assert merged == {(p, t) for p, ts in by_pred.items() if len(ts) > 1 for t in ts}


def test_empty_and_single(spark):
    empty = evaluate.pair_prf(labels(spark, []).limit(0)).first()
    assert tuple(empty) == (1.0, 1.0, 1.0)
    assert tuple(evaluate.label_entropy(labels(spark, [("a", "x")])).first()) == (0.0, 0.0)


def test_labelled_set_golden(spark):
    rows = with_fingerprint(generators.labelled_set(spark))
    pairs = rows.select("true_label", F.col("fingerprint").alias("pred_label")).cache()
    r = evaluate.eval_report(pairs).first()
    assert (r.events, r.true_groups, r.predicted_clusters) == (81, 10, 11)
    assert tuple(map(int, (r.tp, r.fp, r.fn, r.tn))) == (287, 0, 16, 2937)
    assert (r.precision, r.recall, r.f1) == (1.0, 0.9472, 0.9729)
    assert (r.homogeneity, r.completeness, r.v_measure) == (1.0, 0.9708, 0.9852)
    assert (r.false_merges, r.false_splits, r.dedupe_ratio) == (0, 1, 7.3636)
    assert [s.true_label for s in evaluate.split_groups(pairs).collect()] == ["G10_webhook_signature"]
    assert evaluate.merged_clusters(pairs).count() == 0


def test_mixed_stream_golden(spark):
    rows = generators.mixed_stream(spark.range(5000).withColumnRenamed("id", "seq")).cache()
    counts = issues.dedupe_ratio(issues.fingerprinted(rows)).first()
    assert tuple(counts) == (5000, 12, 416.67)
    sizes = [r["count"] for r in rows.groupBy("true_label").count().orderBy(F.desc("count")).collect()]
    assert sizes[0] > 3 * sizes[5]
    times = [r.timestamp for r in rows.orderBy("seq").select("timestamp").collect()]
    assert all(0.0099 <= b - a <= 0.501 for a, b in zip(times, times[1:]))


def nearest(values, percent, half_up):
    s = sorted(values)
    exact = percent / 100.0 * (len(s) - 1)
    k = math.floor(exact + 0.5) if half_up else round(exact)
    return s[max(0, min(len(s) - 1, k))]


SHAPES = {
    "uniform": lambda r: r.uniform(-5, 5),
    "ties": lambda r: 7.0 if r.random() < 0.6 else float(r.randrange(3)),
    "band": lambda r: 1.7e9 + r.random(),
    "wide": lambda r: r.choice([-1, 1]) * 10.0 ** r.uniform(-12, 12),
    "tiny": lambda r: r.random() * 1e-9,
}


@pytest.mark.parametrize("half_up", [False, True])
def test_summary_against_sorting(spark, half_up):
    rng = random.Random(3)
    data = {name: [shape(rng) for _ in range(rng.choice([1, 2, 9, 301, 500]))] for name, shape in SHAPES.items()}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in metrics.metric_summary(df, "v", ["g"], half_up, decimals=15).collect()}
    for g, vs in data.items():
        assert got[g].n == len(vs)
        assert (got[g].min, got[g].max) == (pytest.approx(min(vs), rel=1e-12, abs=1e-15), pytest.approx(max(vs), rel=1e-12, abs=1e-15))
        for name, p in metrics.PERCENTILES.items():
            assert got[g][name] == pytest.approx(nearest(vs, p, half_up), rel=1e-12, abs=1e-15), (g, name)
        assert got[g].mean == pytest.approx(sum(vs) / len(vs), rel=1e-9, abs=1e-15)


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert tuple(metrics.metric_summary(empty, "v").first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    approx = metrics.metric_summary_approx(spark.range(1000).selectExpr("double(id) v"), "v").first()
    assert approx.n == 1000 and abs(approx.p95 - 949) <= 2
