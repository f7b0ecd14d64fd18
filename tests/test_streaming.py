from __future__ import annotations

import json
import os
import random

from pyspark.sql import functions as F

from issueforge.operators import alerts, issues
from issueforge.operators.alerts import AlertRules
from issueforge.sources import envelopes, sinks
from issueforge.streaming import ingest

from .rows import envelope, frame

RULES = AlertRules(threshold=3, window_seconds=40e-6)


def deliveries(n=90, seed=7):
    """(seq, received_us, doc) with redeliveries, clock ties, late event times and broken rows."""
    rng, clock, out = random.Random(seed), 0, []
    for seq in range(n):
        clock += rng.choice([0, 1, 5, 30])
        doc = envelope(f"{rng.randrange(int(n * 0.7)):032x}", rng.uniform(1, 9999), f"p{rng.randrange(2)}",
                       frames=[frame(f"f{rng.choice([0, 0, 0, 1, 2])}", "src/a.js", seq)])
        if seq % 23 == 22:
            doc["level"] = "explode"
        out.append((seq, clock, doc))
    return out


def drop(folder, rows, name, at):
    """One collector file; the stream takes files by modification time."""
    os.makedirs(folder, exist_ok=True)
    shuffled = random.Random(name).sample(rows, len(rows))
    path = os.path.join(folder, name)
    with open(path + ".tmp", "w") as out:
        out.writelines(json.dumps({"seq": s, "received_us": t, "body": json.dumps(d)}) + "\n" for s, t, d in shuffled)
    os.utime(path + ".tmp", (at, at))
    os.rename(path + ".tmp", path)


def batch_side(spark, rows):
    df = spark.createDataFrame([(s, t, json.dumps(d)) for s, t, d in rows], "seq bigint, received_us bigint, raw string")
    return envelopes.validated(df)


def same(left, right):
    columns = sorted(right.columns)
    assert sorted(map(str, left.select(*columns).collect())) == sorted(map(str, right.select(*columns).collect()))


def test_ingest(spark, tmp_path):
    rows = deliveries(60)
    for i in range(3):
        drop(str(tmp_path / "in"), rows[i * 20 : i * 20 + 20], f"f{i}.json", 1000 + i)
    session = ingest.streaming_session(spark, 2)
    root = str(tmp_path / "out")
    ingest.start_ingest(session, str(tmp_path / "in"), root, 1).awaitTermination()
    checked = batch_side(spark, rows)
    same(spark.read.parquet(f"{root}/accepted").drop("batch"), issues.fingerprinted(envelopes.accepted(checked)))
    same(spark.read.parquet(f"{root}/quarantine").drop("batch"), envelopes.quarantined(checked))


def test_dedupe_rollup_alerts_with_restart(spark, tmp_path):
    rows = deliveries()
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    session = ingest.streaming_session(spark, 2)
    for i in range(2):
        drop(source, rows[i * 30 : i * 30 + 30], f"f{i}.json", 1000 + i)
    ingest.start_issues(session, source, root, 1, RULES).awaitTermination()
    drop(source, rows[60:], "f2.json", 1002)
    ingest.start_issues(session, source, root, 1, RULES).awaitTermination()

    narrow = issues.fingerprinted(envelopes.accepted(batch_side(spark, rows))).cache()
    same(ingest.read_latest(spark, root, "issues", ingest.SNAPSHOT), issues.rollup_partials(issues.dedupe(narrow)))
    evals, numbered = issues.attributed(narrow), issues.issues_of(narrow)
    feed = alerts.alerts(evals, numbered, RULES)
    assert feed.filter("rule = 'threshold'").count() >= 2
    same(ingest.read_all(spark, root, "alerts", ingest.ALERT), feed)
    counts = alerts.rolling_counts(evals, RULES.window_us)
    streamed = spark.read.parquet(f"{root}/counts").drop("batch")
    same(streamed.select(counts.columns), counts)


def test_tagging(spark, tmp_path):
    rows = deliveries(40, 11)
    for i in range(5):
        drop(str(tmp_path / "in"), rows[i * 8 : i * 8 + 8], f"f{i}.json", 1000 + i)
    root = str(tmp_path / "out")
    ingest.start_dedupe(ingest.streaming_session(spark, 2), str(tmp_path / "in"), root, 1).awaitTermination()
    narrow = issues.fingerprinted(envelopes.accepted(batch_side(spark, rows)))
    tagged = spark.read.parquet(f"{root}/deliveries").drop("batch")
    same(tagged, issues.attributed(narrow))
    assert tagged.filter(~F.col("accepted")).count() > 0
    assert [(r.level, r.first, r.last) for r in ingest.seen_index(spark, root).cover(5)] == [(1, 0, 3), (0, 4, 4)]


def test_ids_never_change_and_batches_replay(spark, tmp_path):
    rows = deliveries(40, 11)
    root, seen = str(tmp_path / "store"), {}
    order = [rows[0:10], rows[20:30], rows[20:30], rows[10:20], rows[30:40]]
    for number, part in zip((0, 1, 1, 2, 3), order):
        ingest.ingest_batch(batch_side(spark, part), root, number, RULES)
        ids = {(r["project"], r["fingerprint"]): r["id"] for r in spark.read.parquet(f"{root}/ids/batch={number}").collect()}
        assert all(ids[k] == v for k, v in seen.items()) and sorted(ids.values()) == list(range(1, len(ids) + 1))
        seen = ids
    events = spark.read.parquet(f"{root}/events").collect()
    assert len(events) == len({r["event_id"] for r in events})
    assert {(r["project"], r["fingerprint"]): r["issue_id"] for r in events}.items() <= seen.items()
    counts = spark.read.parquet(f"{root}/issues/batch=3").agg(F.sum("count")).first()[0]
    assert counts == len(events)


def test_durable_ingest_decodes_once_and_caches_nothing(spark, tmp_path, monkeypatch):
    """The events, narrow and quarantine tables come from one written decoding of the batch."""
    rows = deliveries(60)
    checked = batch_side(spark, rows)
    root = str(tmp_path / "out")

    def cached(*_):
        raise AssertionError("typed envelopes were cached")

    monkeypatch.setattr(type(checked), "persist", cached)
    ingest.ingest_batch(checked, root, 0)
    staged = spark.read.parquet(f"{root}/checked/batch=0")
    assert "exception" not in staged.columns and staged.count() == 60
    assert staged.filter("(size(reasons) > 0) <> (payload is null) or (size(reasons) > 0) <> (raw is not null)").count() == 0
    first = issues.dedupe(issues.fingerprinted(envelopes.accepted(checked)))
    stored = spark.read.parquet(f"{root}/events")
    same(stored.select("event_id", "fingerprint", "project", "level", "timestamp"), first.select("event_id", "fingerprint", "project", "level", "timestamp"))
    whole = envelopes.accepted(checked).select("seq", sinks.payload().alias("payload")).join(first.select("seq"), "seq")
    same(stored.select("payload"), whole.select("payload"))
    same(spark.read.parquet(f"{root}/quarantine").select("seq", "raw", "reasons"), envelopes.quarantined(checked).select("seq", "raw", "reasons"))
