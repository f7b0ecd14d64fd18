from __future__ import annotations

import corpus_pipeline
from issueforge.llm import line_dedup, toxicity
from issueforge.llm.stages import stage
from tests.llm import test_decontaminate, test_line_dedup, test_packing
from issueforge.llm import packing


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_copies(rows, similarity=0.8):
    """Ids with a smaller id in their connected group of similar documents, equal or blank ones included."""
    sets = [(d, shingles(t or "")) for d, t in sorted(rows)]
    parent = {d: d for d, _ in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if len(a & b) >= similarity * len(a | b):
                x, y = sorted((top(d), top(e)))
                parent[y] = x
    return {d for d in parent if top(d) != d}


def test_stages_against_brute_force(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, docs = first.columns, first
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, None, None)], first.schema)
    docs = docs.unionByName(extra)
    after = {}
    for name, function in corpus_pipeline.STAGES:
        after[name] = stage(function(spark, docs, sf_dir), f"test-{name}")
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        texts = dict(rows)
        if name == "packing":
            break
        assert after[name].columns == columns
        kept = {r["doc_id"]: r["text"] for r in after[name].collect()}
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = {r["doc_id"] for r in toxicity.severity(docs, model).collect() if not r["rejected"]}
            assert set(kept) == want and len(want) < len(rows)
        elif name == "line_dedup":
            gone = test_line_dedup.brute(rows, least=line_dedup.EVERY_LINE)
            assert set(kept) == set(texts) and gone
            for d, t in texts.items():
                assert kept[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone))
        elif name == "near_dedup":
            assert set(kept) == set(texts) - brute_copies(rows)
        else:
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(kept) == set(texts) - {d for d, _ in test_decontaminate.brute(rows, bench)}
        docs = after[name]
    assert test_packing.check(packing.with_crc32(after["packing"]).collect(), texts) < 0.05
    assert corpus_pipeline.run(spark, sf_dir).columns == after["packing"].columns
