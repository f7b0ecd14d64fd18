from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash

from issueforge.llm import near_dup
from issueforge.llm.textvec import SPACE, scan, shingles


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(rows))


def sample_rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 160):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, "\t".join(words).upper() if i % 3 else " ".join(words)))
    rows += [(160, None), (161, " \n"), (162, ""), (163, "Éa ß x"), (3, base[3]), (3, base[3])]
    rows.append((164, "long " * 30_000 + "tail"))
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_components_match_brute_force(spark):
    rows = sample_rows()
    for limit in (4096, 1):  # tree way and neighbourhood way
        got = near_dup.near_duplicate_components(frame(spark, rows), limit=limit).collect()
        assert sorted(map(tuple, got)) == brute_components(rows)


def test_extra_columns_and_empty_table(spark):
    rows = [(1, "a b c", "x", 3), (2, "a b c", None, 4)]
    docs = frame(spark, rows, "doc_id long, text string, fp string, component_id long")
    assert [r["component_id"] for r in near_dup.near_duplicate_components(docs).collect()] == [1, 1]
    assert near_dup.near_duplicate_components(frame(spark, [])).count() == 0


def test_forest_spans_the_radius_graph():
    rng = random.Random(1)
    values = list({rng.getrandbits(6) | rng.getrandbits(2) << 40 for _ in range(120)})
    for radius in (1, 2, 4):
        links = near_dup._forest(values, radius)
        assert all((values[a] ^ values[b]).bit_count() <= radius for a, b in links)
        groups = lambda pairs: {frozenset(g) for g in _groups(len(values), pairs)}
        every = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius]
        assert groups(links) == groups(every)


def _groups(n, pairs):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[top(a)] = top(b)
    out = {}
    for i in range(n):
        out.setdefault(top(i), []).append(i)
    return out.values()


def test_groups_match_jaccard(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, truth = [], set()
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        rows.append((2 * i, " ".join(words)))
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
            rows.append((2 * i + 1, " ".join(words)))
    grams = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                truth |= {(a, a), (b, a)}
    rows += [(900, None), (901, ""), (902, "one two"), (903, " one  TWO\n")]
    truth |= {(900, 900), (901, 900), (902, 902), (903, 902)}
    got = {tuple(r) for r in near_dup.near_duplicate_groups(frame(spark, rows)).collect()}
    assert got == truth
    assert near_dup.near_duplicate_groups(frame(spark, [])).count() == 0


def test_scan_and_shingles():
    texts = pa.array(["Ab  cd\te", None, "", "x", "Ab cd e f"])
    found = scan(texts, SPACE)
    assert [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end)] == "ab cd e x ab cd e f".split()
    assert found.doc.tolist() == [0, 0, 0, 3, 4, 4, 4, 4]
    hashes = found.hashes()
    assert (hashes[:3] == hashes[4:7]).all() and len(np.unique(hashes)) == 5
    grams, doc = shingles(hashes, found.doc, 5, 3)
    assert doc.tolist() == [0, 3, 4, 4] and grams[0] == grams[2] != grams[3]


def brute_groups(rows, k=5, similarity=0.8):
    grams = {}
    for d, t in rows:
        words = t.split()
        grams[d] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    ids = sorted(grams)
    close = [
        (i, j) for i in range(len(ids)) for j in range(i)
        if len(grams[ids[i]] & grams[ids[j]]) >= similarity * len(grams[ids[i]] | grams[ids[j]]) - 1e-9
    ]
    return {(ids[i], ids[min(g)]) for g in _groups(len(ids), close) if len(g) > 1 for i in g}


def family(seed, variants=60):
    """Variants of one text, most pairs below 0.8, each with a copy near 0.9."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for v in range(variants):
        words = list(base)
        for n, i in enumerate(rng.sample(range(0, 300, 6), 7)):
            words[i] = f"x{v}-{n}"
        rows.append((v, " ".join(words)))
        words[rng.randrange(300)] = f"y{v}"
        words[rng.randrange(300)] = f"z{v}"
        rows.append((1000 + v, " ".join(words)))
    return rows


def test_copies_within_a_family_of_variants(spark, monkeypatch):
    rows = family(5)
    want = brute_groups(rows)
    assert len({g for _, g in want}) > 20
    assert {tuple(r) for r in near_dup.near_duplicate_groups(frame(spark, rows)).collect()} == want
    monkeypatch.setattr(near_dup, "SHARD_LIMIT", 16)  # the same in pairs of chunks
    assert {tuple(r) for r in near_dup.near_duplicate_groups(frame(spark, rows)).collect()} == want


def test_repeats_and_radius_lose_no_pair(spark):
    rng = random.Random(2)
    rows = []
    for i in range(8):  # equal sets, one phrase repeated
        a, b = (" ".join(f"{i}{side}{k}" for k in range(7)) for side in "ab")
        rows += [(10 * i, f"{a} {a} {b} {b}"), (10 * i + 1, " ".join([a] * 40 + [b, b])), (10 * i + 2, " ".join([a, a] + [b] * 40))]
    for i in range(100, 500):  # just above the threshold
        words = [f"{i}w{k}" for k in range(200)]
        rows.append((10 * i, " ".join(words)))
        for k in rng.sample(range(5, 195, 10), 4):
            words[k] = "new"
        rows.append((10 * i + 1, " ".join(words)))
    want = brute_groups(rows)
    assert len(want) == 8 * 3 + 400 * 2
    assert {tuple(r) for r in near_dup.near_duplicate_groups(frame(spark, rows)).collect()} == want


def test_shards_are_searched_in_a_tree():
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 1 << 62, 120).astype(np.uint64), np.arange(40, dtype=np.uint64)])
    values = np.concatenate([values, values[:60] ^ np.uint64(1 << 40)])
    distinct = np.unique(values)
    for radius in (2, 23):
        near, visited = near_dup._searched(distinct, near_dup._levels(distinct), values, radius)
        assert (near == (np.bitwise_count(values[:, None] ^ distinct) <= radius)).all()
        pairs = [(i, j) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= radius]
        root = near_dup._partners(values, radius)
        assert {tuple(np.flatnonzero(root == r)) for r in root} == {tuple(g) for g in _groups(len(values), pairs)}
        assert radius > 2 or visited.mean() < 0.7  # edges beyond the radius are not followed
