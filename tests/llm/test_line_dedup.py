from __future__ import annotations

import random

from issueforge.llm import line_dedup


def brute(rows, similarity=0.8, least=5):
    lines = []
    for doc, text in rows:
        if doc is None or text is None:
            continue
        for n, line in enumerate(text.split("\n")):
            words = line.encode().lower().split()
            if len(words) >= least:
                lines.append((doc, n, frozenset(words)))
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for i, (doc, n, words) in enumerate(lines):
        if any(len(words & o) >= similarity * len(words | o) - 1e-9 for _, _, o in lines[:i]):
            gone.add((doc, n))
    return gone


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, line int, a string")
    gone = brute(rows)
    got = [tuple(r) for r in line_dedup.removed_lines(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == gone
    return docs, gone


def random_rows(seed, docs=60):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(300)]
    pool = [rng.choices(common, k=rng.randint(0, 12)) + rng.choices(rare, k=rng.randint(0, 30)) for _ in range(90)]
    rows = []
    for d in range(docs):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(rare)
            rng.shuffle(words)
            lines.append(rng.choice([" ", "\t "]).join(words))
        rows.append((rng.randrange(10_000) * 100 + d, "\n".join(lines)))
    return rows


def test_removed_lines_match_brute_force(spark):
    for seed in (1, 2):
        check(spark, random_rows(seed))


def test_many_variants_of_one_line(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[: i % 40] + [f"x{i}"] + base[i % 40 + 1 :])) for i in range(150)]
    check(spark, rows)


def test_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs, gone = check(spark, rows)
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for doc, text in rows:
        lines = [line for n, line in enumerate(text.split("\n")) if (doc, n) not in gone]
        assert kept[doc]["text"] == "\n".join(lines) and kept[doc]["a"] == "x"
    report = line_dedup.line_report(docs).collect()
    assert len(report) == len(rows) and sum(r["n_removed"] for r in report) == len(gone)


def test_odd_rows(spark):
    line = "one two three four five six"
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, line), (4, line + "\n" + line.upper()), (5, "a b c d\n" + line), (6, line + "\r"),
            (7, "word " * 30_000 + "\n" + "\n" * 500 + line), (8, " ".join(f"u{i}" for i in range(20_000))),
            (9, " ".join(f"u{i}" for i in range(1, 20_001)))]
    docs, gone = check(spark, rows)
    assert gone == {(4, 1), (5, 1), (6, 0), (7, 501), (9, 0)}
    assert line_dedup.removed_lines(docs.limit(0)).count() == 0
    assert line_dedup.dedup_lines(docs).count() == len(rows)


def test_short_lines_of_the_registered_query(spark, tmp_path):
    from issueforge.llm import queries

    rows = random_rows(3, 20) + [(1, "a\nb c\n\na b c d\nx y z"), (2, "A\nc b\n \na b c d e\nx y w"), (3, "a a\nz y x\nd c b a\nb"), (4, "q")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], n) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect() for n in r["removed"]}
    assert got == brute(rows, least=1)
    # equal sets, and four words of five
    assert {(2, 0), (2, 1), (2, 3), (3, 0), (3, 1), (3, 2)} <= got and not {(2, 4), (3, 3), (4, 0)} & got


def test_clashing_column_names(spark):
    text = "one two three four five six\nalpha beta gamma delta epsilon\none two three four five six"
    rows = [(1, text, 5, "x", "y"), (2, text, None, None, "z"), (3, None, 1, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int, _doc string, _Gone_ string")
    got = {r["doc_id"]: tuple(r) for r in line_dedup.dedup_lines(docs).collect()}
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    gone = brute([(d, t) for d, t, *_ in rows])
    for d, t, *rest in rows:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
        assert got[d] == (d, want, *rest)
