from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from issueforge.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **options):
    schema = "conv_id long, turn long, role string, text string, window int, carried string"
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    windows = chat.format_conversations(table, **options)
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    assert set(got) == set(turns)
    by_conv = defaultdict(list)
    for w in windows.collect():
        by_conv[w["conv_id"]].append(w)
    for c, own in turns.items():
        said = "".join(x for r, x in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))
        assert r["formatted_chars"] == sum(len(w["text"]) for w in by_conv[c])
        at = 0
        for n, w in enumerate(sorted(by_conv[c], key=lambda w: w["window"])):
            shown = chat.parse(w["text"])
            head = 1 if n and own[0][0] == "system" else 0
            assert w["window"] == n and shown[head:] == own[at - (w["carried"] - head) : at + w["n_new"]]
            assert not head or shown[0] == own[0]
            assert w["tokens"] <= options.get("budget", chat.BUDGET) or w["n_new"] == 1
            at += w["n_new"]
        assert at == len(own)
    return by_conv


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(1, 20)
        for t, role in enumerate(roles):
            rows.append((c, t, role, "".join(rng.choices(["word ", "##", "#", "\\", "</turn>", "<", "/", "\n", "é", ": ", "### user: "], k=rng.randint(0, 120)))))
    rng.shuffle(rows)
    return rows


def test_round_trip_and_budget(spark):
    for budget, history in ((1024, 256), (120, 60), (60, 0), (1, 1)):
        by_conv = check(spark, random_rows(budget), budget=budget, history=history)
    assert sum(map(len, by_conv.values())) > 500


def test_history_is_repeated_but_masked(spark):
    rows = [(1, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"turn {t} " + "word " * 20) for t in range(30)]
    windows = sorted(check(spark, rows, budget=120, history=60)[1], key=lambda w: w["window"])
    assert len(windows) > 5 and all(w["carried"] >= 2 for w in windows[1:])
    assert sum(len(w["loss_start"]) for w in windows) == 14


def test_odd_rows(spark):
    own = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", own), (-7, 1, "assistant", own), (1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""),
            (None, 3, "a: b\n### x", "</turn>"), (2, 0, "system", "s " * 5000), (2, 1, "assistant", "long " * 50_000), (2, 2, "user", "<")]
    check(spark, rows)
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_given_conversations(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    check(spark, rows)


def test_markers_cannot_occur_in_escaped_texts():
    rng = random.Random(0)
    for _ in range(5000):
        text = "".join(rng.choices("#</turn>\\ a", k=rng.randrange(20)))
        out = chat.escape(text)
        assert "##" not in out and "</" not in out and chat.unescape(out) == text
