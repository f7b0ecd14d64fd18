"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from issueforge import registry
from issueforge.operators import alerts, browse, evaluate, issues
from issueforge.sources import derived


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return registry.narrow(spark, sf_dir)


def test_no_python_and_no_products(spark, sf_dir, rows):
    narrow = rows.select("event_id", "seq", "received_us", "project", "fingerprint")
    frames = {
        "rollup": issues.rollup_partials(issues.dedupe(rows)),
        "rolling": alerts.rolling_counts(issues.attributed(narrow), 1000),
        "report": evaluate.eval_report(registry.label_pairs(spark, sf_dir)),
        "crumbs": registry.QUERIES["breadcrumbs_asof"](spark, sf_dir),
        "wide": issues.drop_redelivered(derived.deliveries(spark, sf_dir)),
        "checked": registry.checked(spark, sf_dir),
    }
    for name, df in frames.items():
        text = plan(df)
        for node in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "InPandas"):
            assert node not in text, (name, node)
        assert "SinglePartition" not in text or name == "report", name


def test_rollup_aggregates_before_both_shuffles(rows):
    text = plan(issues.rollup_partials(issues.dedupe(rows)))
    assert text.count("partial_min_by") == 2 and text.count("Exchange hashpartitioning") == 2


def test_scan_reads_needed_columns_only(spark, sf_dir, rows):
    scan = re.search(r"ReadSchema: (\S+)", plan(rows.select("fingerprint"))).group(1)
    assert scan == "struct<user_id:bigint,event_type:string,props:string>"
    filtered = plan(derived.table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in filtered


def test_rank_limit_is_applied_before_the_shuffle(rows):
    text = plan(browse.newest_events(issues.dedupe(rows), ["project", "fingerprint"]))
    assert text.count("WindowGroupLimit") == 2


def test_valid_rows_filter_does_not_repeat_the_decoding(spark, sf_dir):
    from issueforge.sources import envelopes

    text = plan(envelopes.accepted(registry.checked(spark, sf_dir)).select("seq", "project"))
    assert text.count("try_parse_json") + text.count("parse_json(raw") <= 4


def test_points_are_shuffled_once(rows):
    narrow = rows.select("event_id", "seq", "received_us", "project", "fingerprint")
    counts = alerts.rolling_counts(issues.attributed(narrow), 1000)
    counts.write.format("noop").mode("overwrite").save()
    done = counts._jdf.queryExecution()
    counts.collect()
    assert "ReusedExchange" in done.executedPlan().toString() or "ReusedExchange" in plan(counts)


def test_hot_issue_is_spread_over_slices(spark):
    """A third of all rows in one issue: no task of the window gets more than its slices."""
    n = 60_000
    df = spark.range(n).select(
        F.lit("p").alias("issue_project"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 1000).cast("string"))).alias("issue_fingerprint"),
        (F.col("id") * 100_000).alias("received_us"), F.col("id").alias("seq"), F.lit(True).alias("accepted"),
    )
    sliced = df.withColumn("_slice", F.floor(F.col("received_us") / 60_000_000))
    biggest = sliced.groupBy("issue_project", "issue_fingerprint", "_slice").count().agg(F.max("count")).first()[0]
    assert biggest <= 600
    counts = alerts.rolling_counts(df, 10**15)
    assert counts.filter("issue_fingerprint = 'hot'").agg(F.max("window_count")).first()[0] == n // 3


def test_lookup_of_one_issue_is_pushed_to_the_scan(spark, tmp_path):
    from issueforge.operators import browse
    from issueforge.sources import sinks

    rows = spark.range(2000).selectExpr(
        "md5(string(id)) event_id", "id % 40 issue_id", "md5(string(id % 40)) fingerprint", "'p' project", "'error' level",
        "cast(id as double) timestamp", "0D received_at", "'{}' payload", "date'2026-01-01' day",
    )
    sinks.append_events(rows, str(tmp_path / "events"))
    events = sinks.read_events(spark, str(tmp_path / "events"))
    issue = spark.createDataFrame([(7, "t")], "id long, title string")
    detail = browse.issue_detail(issue, events, issue_id=7)
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(issue_id,7)" in plan
    assert detail.count() == 50
    one = events.filter("issue_id is not null").select("issue_id").collect()
    assert [r[0] for r in one] == sorted(r[0] for r in one)


def test_events_are_cut_by_rows_not_by_splits(spark, tmp_path, sf_dir):
    one_group = spark.read.parquet(f"{sf_dir}/events.parquet").limit(1000).coalesce(1)
    one_group.write.parquet(str(tmp_path / "events.parquet"))
    parts = derived.spread_rows(spark.read.parquet(str(tmp_path / "events.parquet")), 20).rdd.glom().map(len).collect()
    assert len(parts) == 50 and max(parts) <= 40
    assert "RoundRobinPartitioning" in plan(derived.deliveries(spark, str(tmp_path)))


def test_a_judged_field_does_not_decode_the_others(spark):
    from issueforge.sources import envelopes

    lines = spark.range(2).selectExpr("id AS seq", "id AS received_us", "'{}' AS raw").repartition(2)
    text = plan(envelopes.parsed(lines).select("seq", "level"))
    assert "level" in text and "lineno" not in text and "breadcrumbs" not in text


def test_wide_dedupe_deals_payloads_by_their_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(issues, "WIDE_TASK_ROWS", 20, raising=False)
    wide = derived.deliveries(spark, sf_dir).hint("merge")
    kept = issues.drop_redelivered(wide)
    assert len(re.findall(r"hashpartitioning\(seq#\d+L, 50\)", plan(kept))) == 2
    assert kept.count() == issues.dedupe(wide).count()


def test_collector_files_follow_the_rows(spark, monkeypatch):
    """A large batch is written by more than four tasks, the same number for each batch, none empty."""
    from issueforge import registry

    monkeypatch.setattr(registry.derived, "TASK_ROWS", 40)
    monkeypatch.setattr(registry, "ROWS_TO_FILL_A_FILE", 30)
    rows = spark.range(1200).selectExpr("id seq", "id * 7 received_us", "concat('body ', id) raw").repartition(5)
    path, files = registry.write_lines(spark, rows)
    assert files == 10
    lines = spark.read.text(path).select("_metadata.file_path", F.from_json("value", "seq bigint, received_us bigint, body string").alias("r"))
    per_file = lines.groupBy("file_path").agg(F.min(F.floor(F.col("r.seq") / 400)).alias("low"), F.max(F.floor(F.col("r.seq") / 400)).alias("high")).collect()
    assert len(per_file) == 3 * files and all(f.low == f.high for f in per_file)
    assert sorted(map(tuple, lines.select("r.*").collect())) == sorted(map(tuple, rows.collect()))
