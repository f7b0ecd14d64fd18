from __future__ import annotations

import re
from collections import Counter

import numpy as np

from issueforge.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [None, "", " \n\n\t", "a", "a b c a b c", "a a a a", "É ß 日本\r\nÉ ß 日本\r\n", "x #*\nx #*\nx #* ", "a b\nc\na b\n\n\nc\nc d", "<|>" * 50_000, "w x y z"]


def test_base_counts_match_brute_force(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_words int")
    texts, got = dict(rows), quality.quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_labelled_junk_goes_and_clean_stays(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert np.mean([not r["kept"] for r in rows if r["quality"] == 0]) > 0.9


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(3)
    mix = np.array([[1.0, 0.6], [0.0, 0.8]])
    good = rng.normal(size=(4000, 2)) @ mix.T + [3, -2]
    bad = rng.normal(size=(800, 2)) * 0.3 + [12, 9]
    rows = [("a", None, float(x), float(y)) for x, y in np.vstack([good, bad])]
    rows += [("b", "s", float(x), float(y)) for x, y in good[:500] * 2]
    vectors = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double")
    got = {r["lang"]: r for r in quality.estimates(vectors, floors=(0.01, 0.01)).collect()}
    assert np.allclose(got["a"]["mean"], [3, -2], atol=0.15) and np.allclose(got["b"]["mean"], [6, -4], atol=0.4)
    covariance = np.linalg.inv(np.reshape(got["a"]["precision"], (2, 2)))
    assert np.allclose(covariance, mix @ mix.T, atol=0.5)
    away = bad - got["a"]["mean"]
    assert (np.einsum("ni,ij,nj->n", away, np.linalg.inv(covariance), away) > 30).all()


def test_small_and_empty_inputs(spark):
    schema = "doc_id long, text string, lang string, source string"
    few = spark.createDataFrame([(1, "w " * 60, "en", "s"), (None, " ".join(f"w{i}" for i in range(60)), None, "s")], schema)
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in quality.quality(few).collect()) == [(0, True), (1, False)]
    assert quality.quality(few.limit(0)).count() == 0
