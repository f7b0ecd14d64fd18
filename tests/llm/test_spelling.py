from __future__ import annotations

import re
import zlib
from collections import Counter

from issueforge.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(rows, ratio=10, shortest=7, least=2):
    """One word at a time: runs, the deletion rule, counts, all pairs one edit apart, forms and roots."""
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            word = low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low
            if len(word) >= shortest:
                counts[word] += 1
    vocab = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        s, t = (a, b) if len(a) < len(b) else (b, a)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    out = {}
    for w, n in vocab.items():
        nb = [v for v in vocab if v != w and near(w, v)]
        best = min(nb, key=lambda v: (-vocab[v], v), default=None)
        form = best if best is not None and vocab[best] >= ratio * n else None
        out[w] = [form, None, n, len(nb), None if form is None else vocab[form]]
    for w in out:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        out[w][1] = r
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    assert df.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_fixture_against_brute_force(spark):
    common = ["colourful"] * 30 + ["colorful"] * 3 + ["colourfull"] * 2 + ["colourfol"] * 2 + ["Colourful"]
    texts = [" ".join(common), "coloourful colourfuls colourfuls aabbbccc aabbccc aabbccc aabbbccc", None, "", "Ünïcödéd Ünïcödéd ünïcödéd ünïcödéd"]
    texts += ["x" * 5000 + " " + "abcdefgh " * 40 + "abcdefg " * 3, "abcdefgh", "abcdefgh"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[1]), (None, "nullidword nullidword")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = result(spelling.spelling_variants(docs))
    want = brute(rows)
    assert got == want
    assert got["colorful"][0] == "colourful" and got["colourfull"][1] == "colourful"


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = result(spelling.spelling_variants(docs))
    assert got == brute(rows) and got


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(empty).count() == 0
    clash = spark.createDataFrame(
        [(1, "abcdefgh abcdefgh", "x", 1, "y"), (2, "abcdefgh abcdefgi", "z", 2, "w")], "doc_id bigint, text string, word string, n int, key string"
    )
    assert result(spelling.spelling_variants(clash)) == brute([(1, "abcdefgh abcdefgh"), (2, "abcdefgh abcdefgi")])
