"""SimHash near-duplicate groups found with BK-trees.

Fingerprints are spread over shards such that any two within the radius share a shard.  In each
shard a BK-tree (children keyed by their integer Hamming distance to the parent) is searched
following only edges whose distance lies within the radius of the query's distance; its links are a
spanning forest, so a shard of n fingerprints yields fewer than n links.  Trees travel to the tasks
by shuffle, as their total size has no bound that would allow a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.llm.components import connected_components
from issueforge.llm.textvec import scan, shingles, slices
from issueforge.llm.stages import stage, with_ids

SHARD_LIMIT = 4096  # fingerprints in one tree; larger shards take the exact neighbourhood way
QUERIES = 256  # searched in a tree at once
PIECE_BYTES = 8 << 20  # of texts whose shingle sets are compared in one task


# fingerprints


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit is set if set in over half of a row's hashes; rows without hashes get zero."""
    out = np.zeros(len(counts), dtype=np.uint64)
    begin = np.cumsum(counts) - counts
    rows = np.flatnonzero(counts)
    at = 0
    while at < len(rows):  # about half a million hashes at once
        upto = max(at + 1, int(np.searchsorted(begin[rows] + counts[rows], begin[rows[at]] + 500_000, side="right")))
        some = rows[at:upto]
        part = hashes[begin[some[0]] : begin[some[-1]] + counts[some[-1]]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, begin[some] - begin[some[0]], axis=0, dtype=np.int32)
        over = (2 * sums > counts[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
        at = upto
    return out


def _xx_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the UTF-8 shingles of one text, in order."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    pieces = map(joined.__getitem__, map(slice, begins, ends[words - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(parts) - words + 1)


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp BIGINT): SimHash over all word shingles of the whole text, repeats included.

    Only A-Z are lower-cased.  Null or blank text has fingerprint zero; fewer than ``words`` words
    form one shingle.  One row per input row; further columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                each = [_xx_hashes(t, words) for t in part.column("text").to_pylist()]
                counts = np.array([len(x) for x in each], dtype=np.int64)
                fp = _majority(np.concatenate(each), counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, fp bigint")


# shards and trees


def block_shards(radius: int) -> list[str]:
    """SQL of the shard keys of ``fp``: all pairs out of radius + 2 blocks of its bits.

    Two fingerprints within the radius differ in at most ``radius`` blocks and so agree on two.
    """
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [
        f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L)" if b - a < 64 else "fp" for a, b in zip(edges, edges[1:])
    ]
    return [f"xxhash64({n}, {x}, {y})" for n, (x, y) in enumerate(combinations(blocks, 2))]


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (positions) within the radius that span the groups of one shard, by a BK-tree."""
    children: list[dict[int, int]] = [{}]
    parent = list(range(len(values)))
    links = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(1, len(values)):
        value, stack = values[i], [0]
        while stack:
            node = stack.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                a, b = top(i), top(node)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((i, node))
            kids = children[node]
            if len(kids) <= 2 * radius + 1:
                stack += [k for d, k in kids.items() if -radius <= d - distance <= radius]
            else:
                stack += [kids[d] for d in range(distance - radius, distance + radius + 1) if d in kids]
        node = 0
        while True:
            distance = (values[node] ^ value).bit_count()
            if distance not in children[node]:
                children[node][distance] = i
                children.append({})
                break
            node = children[node][distance]
    return links


def _tree_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards in batches sorted by shard; a shard may cross batches."""

    def linked(keys, ids, fps):
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        left, right = [], []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                for i, j in _forest(fps[a:b].tolist(), radius):
                    left.append(ids[a + i])
                    right.append(ids[a + j])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        columns = [np.asarray(batch.column(i)) for i in range(3)]
        columns[2] = columns[2].view(np.uint64)
        now = [np.concatenate(x) for x in zip(held, columns)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        yield linked(*(x[:last] for x in now))
        held = [x[last:] for x in now]
    yield linked(*held)


def shard_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between ids within the radius; nodes has (shard, id, fp), ids distinct in a shard."""
    placed = nodes.repartition("shard").sortWithinPartitions("shard", "id").select("shard", "id", "fp")
    return placed.mapInArrow(lambda batches: _tree_links(batches, radius), "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, radius: int = 2, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within the radius, exactly.

    Shards of one fingerprint are dropped by a pre-aggregated count.  Shards over ``limit`` are not
    searched by tree: their fingerprints are expanded to all values within half the radius.  Two
    that are within the radius share such a value, and all that share one are within the radius, so
    linking each to the smallest of its value needs no pairs and no large group.
    """
    shards = fps.select("fp", F.explode(F.array(*map(F.expr, block_shards(radius)))).alias("shard"))
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    placed = stage(shards.join(sizes, "shard").select("shard", F.col("fp").alias("id"), "fp", "n"), "shards")
    cold = shard_links(placed.filter(F.col("n") <= limit), radius)
    if radius % 2:
        raise ValueError("the radius must be even")
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    masks = [0]
    for n in range(1, radius // 2 + 1):
        masks += [int(np.bitwise_xor.reduce(np.array(c, dtype=np.int64))) for c in combinations(bits, n)]
    hot = placed.filter(F.col("n") > limit).select("fp").distinct()
    spread = hot.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    spread = spread.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    # at most len(masks) fingerprints share a value
    met = spread.groupBy("value").agg(F.sort_array(F.collect_set("fp")).alias("all")).filter("size(all) > 1")
    near = met.select(F.element_at("all", 1).alias("a"), F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("b"))
    return cold.unionByName(near.distinct())


def near_duplicate_components(
    docs: DataFrame, words: int = 3, radius: int = 2, limit: int = SHARD_LIMIT
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Fingerprints at most ``radius`` bits apart are linked; ``component_id`` is the smallest doc_id
    reachable, itself included.  Null or blank texts all have fingerprint zero and are linked like
    any other.  Repeated rows each keep a row.  A null doc_id never names a component unless its
    component has no other.  No rows give no rows; further columns are ignored.
    """
    rows = stage(fingerprints(docs, words), "fingerprints")
    least = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = stage(connected_components(fingerprint_links(least.select("fp"), radius, limit)), "components")
    rooted = least.join(found, least["fp"] == found["node"]).select("fp", "root", "least")
    # a component of many fingerprints: its minimum is pre-aggregated, the root is not a join key with rows of text
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(lowest, "root").select("fp", "component_id")
    alone = least.filter("n > 1").join(found, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("least").alias("component_id"))
    named = stage(linked.unionByName(alone), "named")
    return rows.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


# similarity of whole documents on longer shingles


def _sketched(batches: Iterator[pa.RecordBatch], words: int, samples: int, depth: int) -> Iterator[pa.RecordBatch]:
    seeds = (np.arange(samples, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for part in slices(batch, "text"):
            found = scan(part.column("text"))
            hashes, doc = shingles(found.hashes(), found.doc, part.num_rows, words)
            begin = np.searchsorted(doc, np.arange(part.num_rows + 1))
            # sets, as the similarity compares: a repeated shingle has no more weight in the fingerprint
            sets = [np.unique(hashes[a:b]) for a, b in zip(begin, begin[1:])]
            fp = _majority(np.concatenate(sets), np.array([len(own) for own in sets], dtype=np.int64))
            keys = np.zeros((part.num_rows, samples), dtype=np.uint64)
            for row, own in enumerate(sets):
                if not len(own):
                    continue
                with np.errstate(over="ignore"):
                    for s, seed in enumerate(seeds):
                        ranked = (own ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                        ranked = ranked ^ (ranked >> np.uint64(32))
                        least = np.sort(np.partition(ranked, depth - 1)[:depth]) if len(own) > depth else np.sort(ranked)
                        keys[row, s] = np.bitwise_xor.reduce(least * (np.arange(len(least), dtype=np.uint64) * np.uint64(2) + seed | np.uint64(1)))
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * samples, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), lists], ["doc_id", "fp", "keys"])


def _levels(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """BK-tree of distinct values, a level at a time: (nodes, parents, distances to the parents), all as positions."""
    items, children, rows = values.tolist(), [{} for _ in values], [[(0, 0, 0)]]
    for i in range(1, len(items)):
        node, depth = 0, 1
        while True:
            distance = (items[node] ^ items[i]).bit_count()
            if distance not in children[node]:
                break
            node, depth = children[node][distance], depth + 1
        children[node][distance] = i
        if depth == len(rows):
            rows.append([])
        rows[depth].append((i, node, distance))
    return [tuple(np.array(r, dtype=np.int64).T) for r in rows]


def _searched(values: np.ndarray, levels: list, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(near, visited) by query and value: edges are followed whose distance lies within the radius of the query's."""
    visited = np.zeros((len(queries), len(values)), dtype=bool)
    distance = np.zeros((len(queries), len(values)), dtype=np.int16)
    visited[:, 0] = True
    distance[:, 0] = np.bitwise_count(queries ^ values[0])
    for nodes, parents, edges in levels[1:]:
        query, edge = np.nonzero(visited[:, parents] & (np.abs(distance[:, parents] - edges.astype(np.int16)) <= radius))
        visited[query, nodes[edge]] = True
        distance[query, nodes[edge]] = np.bitwise_count(queries[query] ^ values[nodes[edge]])
    return visited & (distance <= radius), visited


def _partners(values: np.ndarray, radius: int) -> np.ndarray:
    """Smallest position connected to each position by values within the radius, found in the shard's BK-tree."""
    distinct, place = np.unique(values, return_inverse=True)
    levels = _levels(distinct)
    root = np.arange(len(values))
    for start in range(0, len(values), QUERIES):
        near, _ = _searched(distinct, levels, values[start : start + QUERIES], radius)
        for i in range(max(start, 1), min(start + QUERIES, len(values))):
            before = root[:i]
            met = np.unique(before[near[i - start, place[:i]]])
            if len(met):
                root[i] = met[0]
            if len(met) > 1:
                before[np.isin(before, met)] = met[0]
    return root


def _members(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(cluster, id) of the ids with a fingerprint within the radius in their shard, from rows sorted by shard and id."""

    def found(keys, ids, fps):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        root = np.arange(len(keys))
        for a, b in zip(cuts, cuts[1:]):
            if b - a == 2:
                root[a + 1] -= (int(fps[a]) ^ int(fps[a + 1])).bit_count() <= radius
            elif b - a > 2:
                root[a:b] = a + _partners(fps[a:b], radius)
        met = np.bincount(root, minlength=len(keys))[root] > 1
        # named by its smallest id: members that meet in several shards mostly stay one cluster
        return pa.RecordBatch.from_arrays([pa.array(ids[root[met]]), pa.array(ids[met])], ["cluster", "id"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        columns = [np.asarray(batch.column(i)) for i in range(3)]
        columns[2] = columns[2].view(np.uint64)
        now = [np.concatenate(x) for x in zip(held, columns)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        yield found(*(x[:last] for x in now))
        held = [x[last:] for x in now]
    yield found(*held)


def _similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that span the groups of sets of at least that Jaccard similarity; no pair is left out."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")  # by shingle, then by set
    value, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    begin = np.repeat(first, np.diff(np.append(first, len(value))))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    ends = np.cumsum(sizes)
    root, links = np.arange(len(sets)), []
    for i in range(1, len(sets)):
        at = place[ends[i] - sizes[i] : ends[i]]
        lengths = at - begin[at]  # earlier sets with the shingle
        total = int(lengths.sum())
        if not total:
            continue
        each = np.repeat(begin[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        both = np.bincount(owner[each], minlength=i)
        before = root[:i]
        met = np.unique(before[both >= similarity * (sizes[:i] + sizes[i] - both) - 1e-9])
        links += [(i, int(m)) for m in met]
        if len(met):
            root[i] = met[0]
        if len(met) > 1:
            before[np.isin(before, met)] = met[0]
    return links


def _jaccard(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between the ids of each piece, from rows (piece, id, text) sorted by piece."""

    def linked(ids, sets):
        links = _similar(sets, similarity) if len(sets) > 1 else []
        ends = ([ids[k[side]] for k in links] for side in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    piece, ids, sets = None, [], []
    for batch in batches:
        for part in slices(batch, "text"):
            found = scan(part.column("text"))
            hashes, doc = shingles(found.hashes(), found.doc, part.num_rows, words)
            begin = np.searchsorted(doc, np.arange(part.num_rows + 1))
            for row, (p, i) in enumerate(zip(part.column("piece").to_pylist(), part.column("id").to_pylist())):
                if p != piece:
                    yield linked(ids, sets)
                    piece, ids, sets = p, [], []
                ids.append(i)
                sets.append(np.unique(hashes[begin[row] : begin[row + 1]]))
    yield linked(ids, sets)


def near_duplicate_groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 23, samples: int = 12, depth: int = 3
) -> DataFrame:
    """(doc_id, group_id) of the documents that have an exact or near copy; group_id is the smallest id.

    At a Jaccard similarity of 0.8 the 64-bit SimHashes differ by about 10 bits, which no split of
    the bits into blocks can index.  Shards are therefore consistent samples: the ``depth`` smallest
    shingles under each of ``samples`` orders, shared with probability similarity ** depth each
    (0.9998 in all at 0.8; the radius loses 1 in 100,000 there).  Each shard's fingerprints form a BK-tree that
    is searched within the radius; texts that find a partner there become
    members of clusters, which only choose what is compared: of each cluster all pairs of whole
    shingle sets are, and only similar ones are joined.  Equal texts are grouped by hash beforehand,
    so a large group of copies is one node.  Ids must be distinct.  Null and blank texts are copies of each
    other.  Rows with null ids are left out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    words_only = F.trim(F.regexp_replace(F.expr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), r"[\x20\x09-\x0D]+", " "))
    hashed = stage(rows.select("doc_id", F.sha2(words_only, 256).alias("same")), "same-text")
    first = stage(hashed.groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "first-texts")
    # every text is sketched where it is read; the narrow sketches of later equal texts are dropped
    every = rows.mapInArrow(lambda b: _sketched(b, words, samples, depth), "doc_id bigint, fp bigint, keys array<bigint>")
    sketch = stage(every.join(first.select(F.col("least").alias("doc_id")), "doc_id", "left_semi"), "sketches")
    placed = sketch.select(F.col("doc_id").alias("id"), "fp", F.posexplode("keys").alias("sample", "key"))
    placed = placed.filter("key <> 0").select(F.xxhash64("sample", "key").alias("shard"), "id", "fp")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    # tasks stay bounded: hot shards and clusters are cut into chunks, each pair of chunks once
    cold = _bounded(placed.join(sizes, "shard"), F.col("n") / SHARD_LIMIT, "shard", "id", "fp")
    cold = cold.repartition("shard").sortWithinPartitions("shard", "id").select("shard", "id", "fp")
    members = stage(cold.mapInArrow(lambda b: _members(b, radius), "cluster bigint, id bigint").distinct(), "candidates")
    texts = with_ids(rows, members.select("id"), "left_semi").select(F.col("doc_id").alias("id"), "text")
    texts = stage(texts.withColumn("bytes", F.octet_length("text").cast("bigint")), "linked-texts")
    weighed = members.join(texts.select("id", "bytes"), "id")
    weights = weighed.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    load = F.greatest(F.col("n") / SHARD_LIMIT, F.col("bytes") / PIECE_BYTES)
    pieces = _bounded(members.join(weights, "cluster"), load, "cluster", "id").withColumnRenamed("cluster", "piece")
    full = pieces.join(texts.drop("bytes"), "id").repartition("piece").sortWithinPartitions("piece", "id").select("piece", "id", "text")
    sure = full.mapInArrow(lambda b: _jaccard(b, words, similarity), "a bigint, b bigint")
    found = stage(connected_components(sure), "components")
    root = first.join(found, F.col("least") == F.col("node"), "left").select("same", "n", "node", F.coalesce("root", "least").alias("group_id"))
    named = root.filter("n > 1 or node is not null").select("same", "group_id")
    return hashed.join(named, "same").select("doc_id", "group_id")


def _bounded(placed: DataFrame, load: Column, key: str, *columns: str) -> DataFrame:
    """(key, columns): groups of a load over 1 are cut into all pairs of chunks of half a load, spread over tasks."""
    hot = load > 1
    chunks = F.ceil(load * 2).cast("int")
    own = F.pmod(F.xxhash64("id"), F.greatest(chunks, F.lit(1))).cast("int")
    meets = F.when(hot, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.lit(0)))
    spread = placed.withColumn("_hot", hot).withColumn("own", own).withColumn("other", F.explode(meets))
    pair = F.when(F.col("_hot"), F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col(key))
    return spread.select(pair.alias(key), *columns).distinct()
