from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from issueforge.llm import packing
from issueforge.llm.tokens import PartEncoder, word_bpe_path

TEXTS = ["a <|endoftext|> b", "<|ENDOFTEXT|>.", "x.<|startoftext|>y", "It's  don 't x　y", "e ́x", "İstanbul ΑΣ ΑΣ, x\u0085y", "​  a", " ", "", None, "42 x42"]


def test_part_encoder_equals_whole_text():
    whole, parts = Tokenizer.from_file(word_bpe_path()), PartEncoder(word_bpe_path(), limit=3)
    texts = TEXTS + [" ".join(t or "" for t in TEXTS)]
    for _ in range(2):
        ids, offsets = parts.encode(pa.array(texts))
        for text, a, b in zip(texts, offsets, offsets[1:]):
            assert ids[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_part_encoder_on_random_texts():
    rng = random.Random(3)
    whole, parts = Tokenizer.from_file(word_bpe_path()), PartEncoder(word_bpe_path())
    signs = "aBcé×÷ßÀ日ıİ'sdtre.,!…\u0301 \u00a0\n12½-_<|>\u200bΣ"
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)]
    ids, offsets = parts.encode(pa.array(texts))
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_cut_covers_everything():
    for n in range(1, 5000):
        pieces = packing.cut(n)
        assert sum(length for _, length in pieces) == n and len(pieces) <= n // 2048 + 5
        assert all(m == 16 or length <= 2048 // m for m, length in pieces)


def check(rows, texts):
    whole = Tokenizer.from_file(word_bpe_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = whole.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + p["length"]], dtype="<u4")
            assert p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    tokens = sum(r["length"] for r in rows)
    return 1 - tokens / (2048 * len(by_sequence))


def test_round_trip_and_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    many = docs.repartition(7, "doc_id")
    assert check(packing.with_crc32(packing.pack(many)).collect(), texts) < 0.02


def test_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "word " * 40_000)]
    rows += [(200 + i, " ".join(rng.choices(["alpha", "beta"], k=rng.randrange(3000)))) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, klass string, offset long")
    assert check(packing.with_crc32(packing.pack(docs)).collect(), dict(rows)) < 0.02
    assert packing.pack(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r["length"] for r in packing.pack(twice).collect()) == [1, 3, 3]
