"""Near-duplicate line removal by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity: a global order by the frequency of
their hash bucket (counted over all text, a table of fixed size) and then their hash.  Sets of
Jaccard similarity t share a word among their rarest, so only prefixes are joined; length and
positional filters and a parity bitmap (its Hamming distance bounds the symmetric difference from
below) leave few candidates, which are verified on the whole sets.  Equal sets are merged
beforehand.  In each group of a shared word only the members of connected candidates go on, one row
each, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.llm.stages import stage
from issueforge.llm.textvec import _mixed, scan, slices

SIMILARITY = 0.8
LEAST_WORDS = 5  # of the functions' default; shorter lines are never removed
EVERY_LINE = 1  # as least: all lines with a word
BUCKETS = 1 << 18
CHUNK = 1 << 12
N_MOST = (1 << 20) - 1  # set sizes from here on skip the size filters
POSITION_MOST = (1 << 12) - 1
BROADCAST_ROWS = 200_000  # narrow rows, counted before a broadcast


# word frequencies


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            counts += np.bincount(_bucket(scan(part.column("text")).hashes()), minlength=BUCKETS)
    parts = [c.tobytes() for c in counts.reshape(-1, CHUNK)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b.as_py(), np.int64) for b in table.column("counts")], axis=0)
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of every word bucket, rarest first, over all texts; BUCKETS numbers whatever the input."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_bucket_counts, "chunk int, counts binary")
    rows = found.groupBy("chunk").applyInArrow(_added, "chunk int, counts binary").collect()
    counts = np.zeros((BUCKETS // CHUNK, CHUNK), dtype=np.int64)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    rank = np.empty(BUCKETS, dtype=np.uint64)
    rank[np.argsort(counts.ravel(), kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return rank


# lines


class _Sets:
    """Word sets of the lines of some texts, each in order of rarity."""

    def __init__(self, texts: pa.Array, rank: np.ndarray, least: int):
        found = scan(texts)
        hashes = found.hashes()
        newlines = np.flatnonzero(found.data == 10)
        line = np.searchsorted(newlines, found.start) + found.doc  # grows with every line and row
        key, line = np.unique(line, return_inverse=True)
        words = np.bincount(line, minlength=len(key))
        keep = (words >= least)[line]
        # line, rank of the bucket, other bits of the hash: one sort orders and brings equal words together
        order = (rank[_bucket(hashes)] << np.uint64(24)) | (hashes >> np.uint64(40))
        at = np.flatnonzero(keep)
        if len(key) < 1 << 22:
            at = at[np.argsort((line[at].astype(np.uint64) << np.uint64(42)) | order[at])]
        else:
            at = at[np.lexsort((order[at], line[at]))]
        line, hashes = line[at], hashes[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        self.line, self.word = line[new], hashes[new]
        lines, self.begin, self.size = np.unique(self.line, return_index=True, return_counts=True)
        # row and number of each line
        some = np.minimum.reduceat(at, np.flatnonzero(np.diff(line, prepend=-1))) if len(at) else at
        self.doc = found.doc[some]
        self.number = np.searchsorted(newlines, found.start[some]) - np.searchsorted(newlines, found.offsets[self.doc])
        self.owner = np.repeat(np.arange(len(lines)), self.size)
        with np.errstate(over="ignore"):
            self.a = _summed(_mixed(self.word), self.begin)
            self.b = _summed(_mixed(self.word ^ np.uint64(0x9E3779B97F4A7C15)), self.begin)
        # 128 parities of words, in two halves
        place = _mixed(self.word + np.uint64(1)) >> np.uint64(57)
        bit, low = np.uint64(1) << (place & np.uint64(63)), place < 64
        self.parity = [
            np.bitwise_xor.reduceat(half, self.begin) if len(lines) else half for half in (np.where(low, bit, 0), np.where(low, 0, bit))
        ]


def _summed(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin) if len(begin) else values


LINE_DDL = "doc_id bigint, line int, a bigint, b bigint, n int, low bigint, high bigint, prefix array<int>"


def _prefix_sizes(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def _partnered(n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a set of n words can be similar to another one than itself; equal sets are merged without a join."""
    return (np.ceil(similarity * n - 1e-9) < n) | (np.floor(n / similarity + 1e-9) > n)


def lines_of(docs: DataFrame, rank: np.ndarray, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """One row per line of at least ``least`` words: its set's identity (a, b), size and rarest words."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _Sets(part.column("text"), ranks.value, least)
                some = np.where(_partnered(sets.size, similarity), _prefix_sizes(sets.size, similarity), 0)
                place = np.arange(len(sets.word)) - sets.begin[sets.owner]
                short = sets.word[place < some[sets.owner]]
                prefix = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some)]), pa.int32()),
                    pa.array((short >> np.uint64(13)).astype(np.uint32).view(np.int32)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(sets.doc)), pa.array(sets.number, pa.int32()), pa.array(sets.a.view(np.int64)),
                        pa.array(sets.b.view(np.int64)), pa.array(sets.size, pa.int32()),
                        *(pa.array(half.astype(np.uint64).view(np.int64)) for half in sets.parity), prefix,
                    ],
                    ["doc_id", "line", "a", "b", "n", "low", "high", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, LINE_DDL)


# candidates


def _near(word, n, position, parity: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of one word that pass the filters; rows are sorted by word and size."""
    left, right = [], []
    alive = np.arange(len(word) - 1)
    for step in range(1, len(word)):
        alive = alive[alive + step < len(word)]
        i, j = alive, alive + step
        same = (word[i] == word[j]) & ((n[i] >= similarity * n[j] - 1e-9) | (n[j] >= N_MOST))
        alive = i = alive[same]  # sizes ascend: beyond the first too long one all are
        if not len(alive):
            break
        j = i + step
        least = similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9  # of shared words
        open_ended = n[j] >= N_MOST
        positional = 1 + np.minimum(n[i] - position[i], n[j] - position[j]) - 1 >= least
        apart = sum(np.bitwise_count((half[i] ^ half[j]).view(np.uint64)).astype(np.int64) for half in parity)
        near = (positional & (n[i] + n[j] - apart >= 2 * least)) | open_ended
        left.append(i[near])
        right.append(j[near])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _groups(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position connected to each of n positions."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all() and (root[left] == root[right]).all():
            break
    return root


def _candidates(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(cluster, set) of the sets that have a candidate partner, from rows sorted by word and size."""

    def found(key, a, *parity):
        word, n, position = key >> 32, key >> 12 & N_MOST, key & POSITION_MOST
        left, right = _near(word, n, position, parity, similarity)
        different = a[left] != a[right]
        left, right = left[different], right[different]
        root = _groups(len(key), left, right)
        members = np.unique(np.concatenate([left, right]))
        # named by its smallest set: members that meet under several words stay one cluster
        least = a.copy()
        np.minimum.at(least, root, a)
        return pa.RecordBatch.from_arrays([pa.array(least[root[members]]), pa.array(a[members])], ["cluster", "a"])

    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        now = [np.concatenate([h, np.asarray(batch.column(i))]) for i, h in enumerate(held)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0] >> 32, now[0][-1] >> 32))
        yield found(*(x[:last] for x in now))
        held = [x[last:] for x in now]
    yield found(*held)


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Sets with an earlier similar set, from members sorted by cluster and first place."""

    def later(rows):
        # sets that matched none are the likely partners of later ones and are tried first
        out, leaders, others = [], [], []
        for a, words in rows:
            words = frozenset(words)
            for other in chain(leaders, others):
                n, m = len(words), len(other)
                if min(n, m) >= similarity * max(n, m) - 1e-9:
                    both = len(words & other)
                    if both >= similarity * (n + m - both) - 1e-9:
                        out.append(a)
                        others.append(words)
                        break
            else:
                leaders.append(words)
        return out

    held, cluster = [], None
    for batch in batches:
        out = []
        for c, a, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != cluster:
                out += later(held)
                held, cluster = [], c
            held.append((a, words))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["a"])
    yield pa.RecordBatch.from_arrays([pa.array(later(held), pa.int64())], ["a"])


def _words_of(docs: DataFrame, wanted: DataFrame, rank: np.ndarray, least: int) -> DataFrame:
    """(a, words) of the wanted sets (a, doc_id, line), read again from the line they first occur in."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank)
    asked = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("line", "a")).alias("asked"))
    few = wanted.count() <= BROADCAST_ROWS
    lines = docs.select("doc_id", "text").join(F.broadcast(asked) if few else asked, "doc_id").select(F.split("text", "\n", -1).alias("parts"), "asked")
    one = F.explode(F.transform("asked", lambda x: F.struct(x["a"].alias("a"), F.get("parts", x["line"]).alias("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _Sets(part.column("text"), ranks.value, least)
                lists = pa.ListArray.from_arrays(pa.array(np.append(sets.begin, len(sets.word)), pa.int32()), pa.array(sets.word.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(sets.doc)), lists], ["a", "words"])

    return lines.select(one.alias("one")).select("one.*").mapInArrow(run, "a bigint, words array<bigint>")


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line) of every line that has an earlier similar one; lines count from 0.

    Earlier means by (doc_id, line), over all documents.  A line is split off at each newline; its
    words are runs without ASCII white space, A-Z lower-cased, repeats counted once.  Lines of fewer
    than ``least`` words are never removed, nor compared.  Null texts have no lines, and rows with a
    null doc_id are left alone.  Ids should be distinct: rows that share one are told apart by line
    number only.  Further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("doc_id is not null and text is not null")
    rank = rarity(rows)
    lines = stage(lines_of(rows, rank, similarity, least), "lines")
    first = F.min(F.struct("doc_id", "line", "n", "low", "high", "prefix"))
    firsts = lines.groupBy("a", "b").agg(first.alias("first"), F.count("*").alias("copies"))
    once = stage(firsts.select("a", "b", "copies", "first.*"), "sets")
    sets = once.select("a", "b", "doc_id", "line", "copies")
    key = F.expr(
        f"shiftleft(cast(word as bigint), 32) | shiftleft(cast(least(n, {N_MOST}) as bigint), 12) | least(position, {POSITION_MOST})"
    )
    prefix = once.select("a", "n", "low", "high", F.posexplode("prefix").alias("position", "word")).select(key.alias("key"), "a", "low", "high")
    placed = prefix.repartition(F.expr("shiftright(key, 32)")).sortWithinPartitions("key", "a")
    members = stage(
        placed.mapInArrow(lambda b: _candidates(b, similarity), "cluster bigint, a bigint").distinct(), "candidates"
    )
    wanted = sets.join(members.select("a").distinct(), "a").select("a", "doc_id", "line")
    words = stage(_words_of(rows, wanted, rank, least), "words")
    full = members.join(wanted, "a").join(words, "a").repartition("cluster").sortWithinPartitions("cluster", "doc_id", "line", "a")
    late = stage(
        full.select("cluster", "a", "words").mapInArrow(lambda b: _verified(b, similarity), "a bigint").distinct(), "late-sets"
    )
    # of a late set every line goes, of the others all but the first
    many = sets.filter("copies > 1").select("a", "b", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"))
    again = lines.join(many, ["a", "b"]).filter("doc_id <> first_doc or line <> first_line").select("doc_id", "line")
    lone = sets.join(late, "a", "left_semi").select("doc_id", "line")
    return again.unionByName(lone).distinct()


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without the lines of ``removed_lines``; no row is dropped.

    Columns of any other name are carried unchanged, also ones named like the helper columns.
    """
    gone = removed_lines(docs, similarity, least)
    taken = set(docs.columns)
    lost, doc = (_free(name, taken) for name in ("_gone", "_doc"))
    per_doc = gone.groupBy("doc_id").agg(F.collect_set("line").alias(lost)).withColumnRenamed("doc_id", doc)
    kept = F.expr(f"array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(`{lost}`, i)), '\n')")
    joined = docs.join(per_doc, docs["doc_id"] == per_doc[doc], "left")
    return joined.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(name: str, taken: set[str]) -> str:
    """``name``, with underscores added until no column of the input has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def line_report(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_removed, removed) of every row: how many lines have an earlier similar one, and which."""
    gone = removed_lines(docs, similarity, least)
    per_doc = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(per_doc, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"),
    )
