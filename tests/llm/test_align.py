from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from issueforge.llm import align


def brute(rows):
    """Tokens one document at a time, ranges by laying bytes end to end, links by comparing every pair of ranges."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = align._byte_level()
    docs = []
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        if not text:
            docs.append((doc, None))
            continue
        ta = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
            docs.append((doc, None))
            continue

        def ranges(ts):
            out, at = [], 0
            for i, x in ts:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        docs.append((doc, (ranges(ta), ranges(tb))))
    counts = Counter()
    links_of = []
    for doc, t in docs:
        links = [] if t is None else [(i, j) for i, s, e in t[0] for j, u, v in t[1] if s < v and u < e]
        counts.update(links)
        links_of.append(links)
    top = Counter()
    for (i, j), c in counts.items():
        top[j] = max(top[j], c)
    out = []
    for (doc, t), links in zip(docs, links_of):
        if t is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        ra, rb = t
        cuts = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
        groups, ia, ib = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(ra) and ra[ia][2] <= c:
                ga.append(ra[ia][0])
                ia += 1
            while ib < len(rb) and rb[ib][2] <= c:
                gb.append(rb[ib][0])
                ib += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        best = sum(1 for i, j in links if counts[(i, j)] == top[j])
        out.append((doc, len(ra), len(rb), len(cuts), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    assert df.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[:8]) for r in df.collect()), key=repr)


TEXTS = [
    "Hello wörld  €x <|endoftext|> 日本語🙂 </s> <s> <unk>",
    "a\tb\nc  spaced   out ",
    "ﬁx ﬂow",
    "the the the the cat",
    "x" * 20000,
    None,
    "",
    " ",
    "Ünïcödé, naïve café; 𝔘𝔫𝔦",
    "the cat",
]


def test_fixture_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = result(align.cross_tokenizer_alignment(docs))
    assert got == brute(rows)
    assert sum(1 for r in got if r[1]) >= 7


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(align.cross_tokenizer_alignment(docs, pair_rows=0)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.cross_tokenizer_alignment(empty).count() == 0
    clash = spark.createDataFrame([(1, "the cat", 1, 2, "x"), (2, "the dog", 3, 4, "y")], "doc_id bigint, text string, a long, _row long, count string")
    assert result(align.cross_tokenizer_alignment(clash)) == brute([(1, "the cat"), (2, "the dog")])


PIECES = ["a", "the", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "ё", "日", "🙂", "\u00a0", "\u2003", "\u0085", "\u2581", "'s", "12", "<|endoftext|>", "</s>", "\u200b", "\0", "”", "\u0301", "."]


def test_parts_give_the_tokens_of_whole_texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(align.cross_tokenizer_alignment(docs)) == brute(rows)


def test_repeated_words_are_tokenized_once():
    parts, given = align.Parts(align.Aligner()), []
    tokens = parts.aligner.tokens
    parts.aligner.tokens = lambda texts, inner: given.extend(texts) or tokens(texts, inner)
    words = ["Wort", "mañana", "the", "x9,", "l'été"]
    spaced = pa.array([" " + " ".join(words[i:] + words[:i]) + "\n" + words[i] for i in range(5)] * 400, pa.large_string())
    data = align.np.frombuffer(spaced.buffers()[2], dtype=align.np.uint8)
    found = parts.aligner.parts(data, align.np.frombuffer(spaced.buffers()[1], dtype=align.np.int64))
    assert parts.of(found)["spelled"].all() and len(found.start) == 2000 * 7
    assert sum(map(len, given)) < 200
