"""NULL keys, NaN, repeated JSON keys, scratch folders and late arrivals."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from issueforge import session
from issueforge.operators import evaluate, metrics, rawlogs
from issueforge.plans import skew
from issueforge.sources import envelopes


@pytest.mark.parametrize("limit", [skew.BROADCAST_ROWS, 0])
def test_null_group_is_summarised(spark, monkeypatch, limit):
    monkeypatch.setattr(metrics, "join_by_size", lambda facts, small, keys: skew.join_by_size(facts, small, keys, limit))
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["p50"], r["max"]) for r in metrics.metric_summary(rows, "v", ["k"]).collect()}
    assert got == {"a": (2, 1.0, 2.0), None: (2, 5.0, 7.0)}


def test_nan_is_above_all_numbers(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, math.nan, math.nan, math.nan, math.inf, -math.inf)], "v double")
    r = metrics.metric_summary(rows, "v").first()
    assert r["min"] == -math.inf and r["p50"] == math.inf and math.isnan(r["p95"]) and math.isnan(r["max"])


def test_null_cluster_is_listed(spark):
    rows = spark.createDataFrame([("x", None), ("y", None), ("z", "p")], "true_label string, pred_label string")
    assert [tuple(r) for r in evaluate.merged_clusters(rows).collect()] == [(None, "x", 2), (None, "y", 2)]


def test_null_client_gets_its_crumbs(spark):
    events = spark.createDataFrame([(None, 5), ("c", 6)], "client string, seq long")
    crumbs = spark.createDataFrame([(None, 1, "n"), ("c", 2, "m")], "client string, seq long, text string")
    got = {r["client"]: r["breadcrumbs"] for r in rawlogs.attach_breadcrumbs(events, crumbs, F.col("text")).collect()}
    assert got == {None: ["n"], "c": ["m"]}


def test_last_of_repeated_keys_counts(spark):
    raw = '{"event_id":"%s","level":"info","level":"fatal","timestamp":1,"message":"m"}' % ("a" * 32)
    rows = spark.createDataFrame([(1, 1, raw)], "seq long, received_us long, raw string")
    r = envelopes.validated(rows).first()
    assert r["reasons"] == [] and r["level"] == "fatal"
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        with pytest.raises(ValueError):
            envelopes.validated(rows)
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def test_scratch_needs_a_shared_folder_off_local():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_root(Session())
    Session.sparkContext.master = "local[2]"
    assert session.shared_root(Session())
