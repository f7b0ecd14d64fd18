from __future__ import annotations

import random

from issueforge.streaming.seen_index import SeenIndex

SCHEMA = "event_id string, issue_project string, issue_fingerprint string"


def test_lookups_exact_and_opened_rows_follow_the_batch(spark, tmp_path):
    rng = random.Random(5)
    index = SeenIndex(spark, str(tmp_path / "index"), SCHEMA, base=64, fanout=4)
    stored, opened, counter = {}, [], 0
    for batch in range(64):
        fresh = [f"{counter + i:032x}" for i in range(12)]
        counter += 12
        again = rng.sample(sorted(stored), min(4, len(stored)))
        ids = spark.createDataFrame([(i,) for i in fresh + again + again[:1]], "event_id string")
        index.compact(batch)
        got = {tuple(r) for r in index.lookup(ids, batch).collect()}
        assert got == {(i, *stored[i]) for i in again}
        paths = index.opened(ids, batch)
        opened.append(spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*paths).count() if paths else 0)
        rows = [(i, f"p{rng.randrange(3)}", f"f{rng.randrange(5)}") for i in fresh]
        if batch == 30:  # a replayed micro-batch writes the same run again
            index.add(spark.createDataFrame(rows, SCHEMA), batch)
        index.add(spark.createDataFrame(rows, SCHEMA), batch)
        stored.update({r[0]: r[1:] for r in rows})
    assert len(stored) == 64 * 12
    early, late = sum(opened[8:16]) / 8, sum(opened[48:64]) / 16
    assert late <= 2 * early + 8, (early, late, opened)
    assert max(opened[48:]) < 0.1 * len(stored)
    assert max(r.level for r in index.runs()) >= 2
    assert sum(1 for r in index.runs() if r.level == 0) <= 4  # the last ones, merged when the next micro-batch starts


def test_replay_sees_the_same_ids_and_point_lookup(spark, tmp_path):
    index = SeenIndex(spark, str(tmp_path / "index"), SCHEMA, base=4, fanout=2)
    for batch in range(5):
        index.compact(batch)
        index.add(spark.createDataFrame([(f"id{batch}", "p", f"f{batch}")], SCHEMA), batch)
    ids = spark.createDataFrame([(f"id{i}",) for i in range(6)], "event_id string")
    index.compact(5)
    before = sorted(tuple(r) for r in index.lookup(ids, 4).collect())
    assert before == [(f"id{i}", "p", f"f{i}") for i in range(4)]
    assert sorted(tuple(r) for r in index.lookup(ids, 5).collect()) == [(f"id{i}", "p", f"f{i}") for i in range(5)]
    assert [tuple(r) for r in index.find("id3", 5).collect()] == [("id3", "p", "f3")]
    assert index.find("id9", 5).count() == 0
    empty = SeenIndex(spark, str(tmp_path / "none"), SCHEMA)
    assert empty.lookup(ids, 3).count() == 0 and empty.cover(3) == []
