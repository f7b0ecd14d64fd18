from __future__ import annotations

import random
import re
from collections import Counter

from issueforge.llm import decontaminate


def grams(text):
    words = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(docs, items, similarity=0.8):
    """Best similarity of every document and item over all windows of the item's size."""
    out = {}
    for d, text in docs:
        own = grams(text)
        for item, t in items:
            want = grams(t)
            n = len(want)
            if d is None or item is None or not n:
                continue
            counts = Counter(want)
            if sum(g in counts for g in own) < similarity * n:
                continue
            for s in range(len(own)):
                window = own[s : s + n]
                both = sum((Counter(window) & counts).values())
                j = both / (len(window) + n - both)
                if j >= similarity - 1e-9:
                    out[(d, item)] = max(out.get((d, item), 0), j)
    return out


def check(spark, docs, items):
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, start int, n int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(table, bench).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    leaked = {d for d, _ in want}
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(d or -1 for d, _ in docs if d not in leaked)
    return want


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 70)))) for i in range(25)]
    items += [(100, "same same same same same same same same x y z"), (101, "too short"), (102, None), (103, "")]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        for _ in range(rng.choice([0, 1, 1, 3])):
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                part = part[: int(len(part) * 0.9)]
            at = rng.choice([0, len(words), rng.randint(0, len(words))])
            words[at:at] = part
        docs.append((d + 1, rng.choice([" ", ", ", "\n"]).join(words).upper() if d % 5 == 0 else " ".join(words)))
    return docs, items


def test_leaks_match_brute_force(spark):
    for seed in (1, 2):
        assert len(check(spark, *make(seed))) > 20


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    check(spark, *make(3))


def test_given_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    assert check(spark, *rows)


def test_odd_rows(spark):
    docs, items = make(4)
    item = items[0][1]
    docs = [(None, item), (1, None), (2, ""), (3, "a b"), (4, item), (4, item), (5, "x " * 30_000 + item), (6, (item + " ") * 50)]
    assert {d for d, _ in check(spark, docs, items)} == {4, 5, 6}
    check(spark, docs, [])
    check(spark, [], items)


def test_index_finds_every_item_within_the_radius(spark):
    rng = random.Random(0)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(20)]
    rows = []
    for n, fp in enumerate(base):
        for d in range(decontaminate.RADIUS + 1):
            other = fp
            for b in rng.sample(range(64), d):
                other ^= 1 << b
            rows.append((n, signed(fp), signed(other)))
    df = spark.createDataFrame(rows, "n int, a long, b long")
    met = df.select(decontaminate.block_keys("a", True).alias("x"), decontaminate.block_keys("b").alias("y"))
    assert met.selectExpr("arrays_overlap(x, y) as hit").filter("not hit").count() == 0
