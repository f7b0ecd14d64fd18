from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from issueforge.operators import alerts, browse, issues
from issueforge.operators.alerts import AlertRules
from issueforge.plans import slices

from .rows import envelope, frame, typed

FIELDS = "event_id string, seq bigint, received_us bigint, project string, fingerprint string, level string, timestamp double, type string, culprit string, title string"


def random_deliveries(n, seed, hot=0.0):
    """Narrow deliveries with clock ties and redeliveries."""
    rng = random.Random(seed)
    clock, out = 0, []
    for seq in range(n):
        clock += rng.choice([0, 0, 1, 2, 7, 40])
        event = f"e{rng.randrange(int(n * 0.8))}" if rng.random() > hot else "hot"
        fp = "f0" if rng.random() < 0.34 else f"f{rng.randrange(6)}"
        out.append((event, seq, clock, f"p{rng.randrange(2)}", fp, "error", float(rng.randrange(1000)), "T", "c", f"t{seq}"))
    return out


def sequential(rows, n, window):
    """The rules one delivery at a time."""
    events, found, per_issue, armed = {}, {}, {}, {}
    results, fired = [], []
    for event, seq, at, project, fp, level, ts, etype, culprit, title in rows:
        new = False
        if event not in events:
            key = (project, fp)
            if key not in found:
                found[key] = dict(id=len(found) + 1, first=ts, last=ts, count=0, sample=event, title=title)
                new = True
            issue = found[key]
            issue.update(first=min(issue["first"], ts), last=max(issue["last"], ts), count=issue["count"] + 1)
            events[event] = key
            per_issue.setdefault(key, []).append(at)
        key = events[event]
        count = sum(1 for t in per_issue[key] if t >= at - window)
        rules = ["new_issue"] if new else []
        if count >= n and armed.get(key, True):
            rules.append("threshold")
            armed[key] = False
        elif count < n:
            armed[key] = True
        results.append((seq, event, found[key]["id"], fp, new, ",".join(rules), count))
        fired += [(seq, rule, found[key]["id"]) for rule in rules]
    return results, fired, found


@pytest.mark.parametrize("seed, window, slice_us, hot", [(1, 30, 7, 0.0), (2, 5, 1000, 0.3), (3, 10_000, 13, 0.1), (4, 0, 5, 0.0)])
def test_against_sequential_model(spark, seed, window, slice_us, hot):
    rows, threshold = random_deliveries(1500, seed, hot), 3
    wanted, fired, found = sequential(rows, threshold, window)
    df = spark.createDataFrame(rows, FIELDS).repartition(5).cache()
    evals = issues.attributed(df)
    counts = alerts.rolling_counts(evals, window, slice_us).cache()
    assert [(r.seq, r.window_count) for r in counts.orderBy("seq").collect()] == [(w[0], w[6]) for w in wanted]

    numbered = issues.issues_of(df).cache()
    got = {(r.project, r.fingerprint): (r.id, r.first_seen, r.last_seen, r["count"], r.sample_event_id, r.title) for r in numbered.collect()}
    assert got == {k: (v["id"], v["first"], v["last"], v["count"], v["sample"], v["title"]) for k, v in found.items()}

    rules = AlertRules(threshold=threshold, window_seconds=window / 1e6)
    feed = alerts.firing_order(alerts.alerts(evals, numbered, rules))
    assert [(r.seq, r.rule, r.issue_id) for r in feed.collect()] == fired
    results = issues.delivery_results(evals, numbered, feed).orderBy("seq").collect()
    assert [tuple(r) for r in results] == [w[:6] for w in wanted]


def test_rolling_count_sample(spark):
    times = [0, 1, 1, 5, 10, 30, 31, 32]
    rows = [("p", "f", t, i, True) for i, t in enumerate(times)]
    evals = spark.createDataFrame(rows, "issue_project string, issue_fingerprint string, received_us bigint, seq bigint, accepted boolean")
    counts = alerts.rolling_counts(evals, 5, slice_us=3)
    assert [r.window_count for r in counts.orderBy("seq").collect()] == [1, 2, 3, 4, 2, 1, 2, 3]
    assert [r.seq for r in alerts.crossings(counts, 3).orderBy("seq").collect()] == [2, 7]


def narrow(spark, docs, received=None):
    return issues.fingerprinted(typed(spark, docs, received))


def test_threshold_fires_once(spark):
    docs = [envelope(frames=[frame("a", "src/a.js", i)]) for i in range(5)]
    rows = narrow(spark, docs)
    rules = AlertRules(new_issue=False, threshold=3, window_seconds=3600)
    feed = alerts.alerts(issues.attributed(rows), issues.issues_of(rows), rules).collect()
    assert [(a.seq, a.rule, a.reason) for a in feed] == [(2, "threshold", "3 events in 3600s (>= 3)")]


def test_rule_options_and_outbox(spark):
    for word in ("", "0", "off", " None "):
        assert AlertRules.from_options({"threshold": word}).threshold is None
    rules = AlertRules.from_options({"threshold": "4", "window": "1.5", "new_issue": "false", "url": "http://s"})
    assert rules == AlertRules(False, 4, 1.5, "http://s") and AlertRules.from_options({}) == AlertRules()
    rows = narrow(spark, [envelope(frames=[frame("a", "src/a.js")])])
    on = AlertRules(threshold=None, target_url="http://sink/hook")
    sent = alerts.outbox(alerts.alerts(issues.attributed(rows), issues.issues_of(rows), on), on).collect()
    assert len(sent) == 1 and sent[0].url == "http://sink/hook" and '"rule":"new_issue"' in sent[0].payload
    off = AlertRules(new_issue=False, threshold=None)
    assert alerts.alerts(issues.attributed(rows), issues.issues_of(rows), off).count() == 0


def test_rollup_cases(spark):
    causes = [("f1", 20), ("f2", 15), ("f3", 12), ("f4", 8), ("f5", 5)]
    docs = [envelope(frames=[frame(fn, f"src/{fn}.js", i)]) for fn, n in causes for i in range(n)]
    counts = issues.dedupe_ratio(narrow(spark, docs)).first()
    assert tuple(counts) == (60, 5, 12.0)
    same = [frame("f", "src/x.js")]
    scoped = narrow(spark, [envelope(project="a", frames=same), envelope(project="b", frames=same)])
    found = issues.issues_of(scoped).collect()
    assert len(found) == 2 and len({r.fingerprint for r in found}) == 1
    twice = narrow(spark, [envelope("1" * 32, project="a", frames=same), envelope("1" * 32, project="b", frames=same)])
    assert tuple(issues.store_counts(twice).first()) == (1, 1)
    seen = issues.issues_of(narrow(spark, [envelope(timestamp=2000.0, level="fatal", frames=same), envelope(timestamp=1000.0, frames=same)])).first()
    assert (seen.first_seen, seen.last_seen, seen["count"], seen.level) == (1000.0, 2000.0, 2, "fatal")


def test_dedupe_forms_agree_with_a_hot_id(spark):
    df = spark.createDataFrame(random_deliveries(900, 9, hot=0.4), FIELDS).repartition(6)
    kept = {r.seq for r in issues.dedupe(df).collect()}
    assert kept == {r.seq for r in issues.drop_redelivered(df).collect()}
    assert len(kept) == df.select("event_id").distinct().count()


def test_incremental_equals_one_shot(spark):
    df = spark.createDataFrame(random_deliveries(800, 5), FIELDS).cache()
    cuts = [df.filter(f"seq >= {a} AND seq < {b}") for a, b in ((0, 10), (10, 500), (500, 800))]
    snapshot, stored = issues.rollup_partials(issues.dedupe(cuts[0])), cuts[0].select("event_id")
    for part in cuts[1:]:
        snapshot = issues.merge_partials(snapshot, issues.rollup_partials(issues.unseen(part, stored)))
        stored = stored.unionByName(part.select("event_id"))
    once = issues.rollup_partials(issues.dedupe(df))
    assert sorted(map(str, snapshot.collect())) == sorted(map(str, once.collect()))


def test_status_and_listing(spark):
    docs = [envelope(timestamp=float(100 - i), project=f"p{i % 2}", level="error" if i < 3 else "info", message=f"m {chr(97 + i)}") for i in range(6)]
    found = issues.issues_of(narrow(spark, docs)).cache()
    changes = spark.createDataFrame(
        [(1, "resolved", 1), (1, "ignored", 2), (2, "resolved", 3), (2, "bogus", 4), (99, "resolved", 5)],
        "issue_id bigint, status string, change_seq bigint",
    )
    good, bad = issues.status_changes_checked(changes, found)
    assert good.count() == 3
    assert {(r.issue_id, r.reject) for r in bad.collect()} == {(2, "invalid status"), (99, "issue not found")}
    listed = issues.with_status(found, changes).cache()
    assert {r.id: r.status for r in listed.collect()} == {1: "ignored", 2: "resolved", **{i: "unresolved" for i in (3, 4, 5, 6)}}

    assert [r.id for r in browse.filter_issues(listed, project="p0", level="error", status="").orderBy("id").collect()] == [1, 3]
    assert [r.id for r in browse.filter_issues(listed, status="resolved").collect()] == [2]
    assert [r.id for r in browse.sort_issues(listed, "first_seen", "ASC").collect()] == [6, 5, 4, 3, 2, 1]
    assert [r.id for r in browse.sort_issues(listed, "nonsense", "nonsense").collect()] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        browse.sort_issues(listed, "title", "asc", strict=True)
    for bad_page in (dict(limit=0), dict(limit=1001), dict(offset=-1)):
        with pytest.raises(ValueError):
            browse.page(listed, **bad_page)
    assert [(r.id, r.page_rows) for r in browse.page(listed, "count", "desc", 2, 3).collect()] == [(4, 2), (5, 2)]
    deep = browse._deep_page(listed, "last_seen", "desc", 2, 1).orderBy("id")
    assert [r.id for r in deep.collect()] == [2, 3]
    assert browse.issue_by_id(listed, 3).count() == 1 and browse.issue_by_id(listed, 77).count() == 0


def test_window_counts_have_zeros(spark):
    rows = narrow(spark, [envelope(message="a"), envelope(message="b"), envelope(message="b")], [0, 50, 100])
    accepted = issues.dedupe(rows).cache()
    numbered = issues.issues_of(rows)
    got = {r.issue_id: r.window_count for r in issues.window_counts(accepted, numbered, F.lit(100), 50).collect()}
    assert got == {1: 0, 2: 2}


@pytest.mark.parametrize("seed, window, slice_us, hot", [(5, 30, 7, 0.3), (6, 10_000, 1000, 0.5)])
def test_small_equi_depth_slices_against_sequential_model(spark, seed, window, slice_us, hot):
    rows, threshold = random_deliveries(1500, seed, hot), 3
    wanted, _, _ = sequential(rows, threshold, window)
    evals = issues.attributed(spark.createDataFrame(rows, FIELDS).repartition(5))
    counts = alerts.rolling_counts(evals, window, slice_us, slice_rows=40, seq_block=8)
    assert [(r.seq, r.window_count) for r in counts.orderBy("seq").collect()] == [(w[0], w[6]) for w in wanted]


def test_burst_in_one_microsecond(spark):
    """100,000 deliveries of one issue in one microsecond: slices stay bounded, counts follow seq."""
    n, rows_per_slice, block = 100_000, 10_000, 1024
    burst = spark.range(n).select(
        F.lit("p").alias("issue_project"), F.lit("hot").alias("issue_fingerprint"), F.lit(7).cast("bigint").alias("received_us"),
        (F.col("id") * 3).alias("seq"), (F.col("id") % 10 != 9).alias("accepted"),
    )
    other = spark.range(50).select(
        F.lit("p").alias("issue_project"), F.lit("cold").alias("issue_fingerprint"), (F.col("id") * 2).alias("received_us"),
        (F.col("id") * 3 + 1).alias("seq"), F.lit(True).alias("accepted"),
    )
    evals = burst.unionByName(other)
    points = evals.select("issue_project", "issue_fingerprint", F.col("received_us").alias("_t"), F.lit(0).alias("_leaves"), "seq")
    sliced = slices.equi_depth_slices(points, ["issue_project", "issue_fingerprint"], ["_t", "_leaves", "seq"], 60_000_000, rows_per_slice, block)
    sizes = sliced.groupBy("issue_project", "issue_fingerprint", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= rows_per_slice + block
    assert sizes.filter("issue_fingerprint = 'hot'").count() >= n // (rows_per_slice + block)
    counts = alerts.rolling_counts(evals, 5, slice_rows=rows_per_slice).filter("issue_fingerprint = 'hot'")
    got = counts.select("seq", "window_count", "previous_count").orderBy("seq").collect()
    accepted, previous = 0, None
    for i, r in enumerate(got):
        accepted += i % 10 != 9
        assert (r.seq, r.window_count, r.previous_count) == (3 * i, accepted, previous)
        previous = accepted
