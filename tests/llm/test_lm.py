from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from issueforge.llm import lm


def brute(rows):
    words = {i: (t or "").encode().lower().split() for i, (_, t) in enumerate(rows)}
    held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
    count = Counter()
    for i, h in enumerate(held):
        if not h:
            count.update([*words[i], b""])
    n, v = sum(count.values()), len(count)
    out = []
    for i, (d, _) in enumerate(rows):
        tokens = [*words[i], b""]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((d, held[i], len(tokens), sum(count[w] > 0 for w in tokens), n, base))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key long, hash string")
    got = lm.language_model_scores(docs, **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows), key=key)
    have = sorted(map(tuple, got), key=key)
    assert len(want) == len(have)
    for w, h in zip(want, have):
        assert w[:5] == h[:5] and math.isclose(w[5], h[5], rel_tol=1e-9, abs_tol=1e-9)
        assert h[6] <= 0 and math.isfinite(h[6])
    return got


def test_base_is_exact_and_model_better_on_unseen_texts(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = check(spark, rows, frequent=500)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # which words are broadcast does not matter
    other = check(spark, rows, frequent=1 << 18)
    a, b = ({(r["doc_id"]): r["score"] for r in x} for x in (got, other))
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_odd_rows(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "b a a"), (2, None), (3, ""), (None, "é x"), (5, "w" * 200_000), (9, " \n")]
    rows += [(i, "new words here") for i in range(20, 40)]
    check(spark, rows)
    check(spark, [(i, "x y") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2])  # nothing to train on
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.language_model_scores(empty).count() == 0


def test_probabilities_sum_to_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.fit(docs, sweeps=3, burn_in=1)
    sums = (10.0 ** lm._top(model, 1 << 20)[2]).sum(axis=0) + 10.0**model.unknown
    assert np.allclose(sums, 1, atol=1e-9)


def test_seating_follows_the_restaurant():
    def one_by_one(c, new, d, rng):
        t = 1
        for n in range(1, c):
            t += rng.random() < new / (n - d * t + new)
        return t

    rng = np.random.default_rng(0)
    for c, base in ((5, 0.2), (40, 0.01), (3000, 0.3)):
        d, total = 0.6, 50
        want = np.mean([one_by_one(c, (1 + d * total) * base, d, rng) for _ in range(300)])
        seeds = rng.integers(0, 2**63, 3000).astype(np.uint64)
        got = lm.seat(np.full(3000, c), base, total, 1.0, d, seeds)
        assert abs(got.mean() - want) < 0.05 * want + 0.1
        assert (got >= 1).all() and (got <= c).all()
    assert lm.seat(np.array([0, 1]), 0.5, 3, 1.0, 0.5, np.array([1, 2], dtype=np.uint64)).tolist() == [0, 1]


def test_the_word_before_counts(spark):
    """Words of one length and class, told apart by the word before them alone."""
    train = spark.createDataFrame([("lamp glow fire burn",), ("fire burn lamp glow",)] * 20, "text string")
    model = lm.fit(train)
    texts = ["lamp glow", "lamp burn", "fire burn", "fire glow"]
    docs = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    for frequent in (2, 1 << 17):
        score = {r["doc_id"]: r["score"] for r in lm.score(docs, model, frequent).collect()}
        assert score[0] > score[1] + 1 and score[2] > score[3] + 1


def test_word_contexts_sum_to_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.fit(docs)
    hashes, _, lp, weight = lm._top(model, 1 << 20)
    gains = dict(zip(*(x.tolist() for x in lm._top_pairs(model, 1 << 22))))
    common = model.words.orderBy("c", ascending=False).limit(40).collect()
    classes = {}
    for batch in docs.select("text").toArrow().to_batches():
        context, _, kinds, _ = lm._tokens(found := lm.scan(batch.column("text")), found.hashes())
        classes |= dict(zip(context.tolist(), kinds.tolist()))
    contexts = [(h, w) for h, w in ((r["hash"] % 2**64, r["weight"]) for r in common) if h] + [(1, model.start)]
    for h, w in contexts:
        k = classes[h]
        pairs = lm.pair_hashes(np.full(len(hashes), h, np.uint64), hashes)
        gain = np.array([gains.get(x, 0.0) for x in pairs.tolist()])
        assert w < 0 and (gain > 0).any()
        assert math.isclose((10.0 ** (lp[:, k] + gain)).sum() + 10.0 ** model.unknown[k], 10.0**-w, rel_tol=1e-6)


def test_pairs_are_those_of_the_texts(spark):
    texts = ["a b a", None, "B a", "", "a b"]
    found = lm.scan(lm.pa.array(texts))
    context, word, _, row = lm._tokens(found, found.hashes())
    a, b = lm.scan(lm.pa.array(["a b"])).hashes().tolist()
    want = [(0, 1, a), (0, a, b), (0, b, a), (0, a, 0), (1, 1, 0), (2, 1, b), (2, b, a), (2, a, 0), (3, 1, 0), (4, 1, a), (4, a, b), (4, b, 0)]
    assert sorted(zip(row.tolist(), context.tolist(), word.tolist())) == sorted(want)
