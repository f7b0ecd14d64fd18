"""Harmonic packing of token sequences.

A document's ids are cut into pieces of reciprocal-capacity classes: class m holds pieces of just
under capacity / m tokens, and a bin of class m holds exactly m of them.  A document's rest is cut at
the largest class size it reaches, and its remainder goes on to a smaller class; a rest that nearly
fills a class stays whole.  Rests below the smallest class are laid end to end (the last class of the
harmonic scheme is packed next-fit) and cut at bin edges, so they need no padding.

Each task fills its own bins.  What its last, unfinished bins hold is numbered over all tasks by
prefix sums of per-task counts, so leftovers fill bins too, with no task seeing them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issueforge.llm.textvec import slices
from issueforge.llm.tokens import encoder, word_bpe_path
from issueforge.llm.stages import stage

CAPACITY = 2048
CLASSES = 16  # the last is the class of short rests
SLACK = 0.03  # a piece of at least (1 - SLACK) of its class's size is not cut
END_ID = 1
SLICE = 1 << 20

PIECE = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
        ("klass", pa.int32()), ("worker", pa.int64()), ("place", pa.int64()), ("before", pa.int64()),
    ]
)
PIECE_DDL = (
    "doc_id bigint, start bigint, length bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, klass int, worker bigint, place bigint, before bigint"
)


def cut(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[tuple[int, int]]:
    """(class, length) of a document's pieces in order."""
    pieces = [(1, capacity)] * (tokens // capacity)
    rest = tokens % capacity
    while rest > capacity // classes:
        m = capacity // rest
        if rest >= (1 - slack) * (capacity // m):
            pieces.append((m, rest))
            rest = 0
        else:
            m = -(-capacity // rest)
            pieces.append((m, capacity // m))
            rest -= capacity // m
    if rest:
        pieces.append((classes, rest))
    return pieces


class _Worker:
    """Bins of one task.  ``emit`` gets (doc, start, length, doc_tokens, ids, sequence, offset, class, place, before)."""

    def __init__(self, number: int, capacity: int, classes: int, slack: float):
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.next_id = number << 32
        self.open: dict[int, list] = {}
        self.filled = 0  # tokens in the open bin of short rests
        self.rows: list[tuple] = []

    def _close(self, pieces: list, m: int) -> None:
        offset = 0
        for doc, start, length, total, ids in pieces:
            self.rows.append((doc, start, length, total, ids, self.next_id, offset, m, None, None))
            offset += length
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        for m, length in cut(total, self.capacity, self.classes, self.slack):
            if m < self.classes:
                held = self.open.setdefault(m, [])
                held.append((doc, start, length, total, ids[start : start + length]))
                if len(held) == m:
                    self._close(self.open.pop(m), m)
                start += length
                continue
            while length:
                held = self.open.setdefault(m, [])
                part = min(length, self.capacity - self.filled)
                held.append((doc, start, part, total, ids[start : start + part]))
                self.filled += part
                start, length = start + part, length - part
                if self.filled == self.capacity:
                    self._close(self.open.pop(m), m)
                    self.filled = 0

    def leave(self) -> None:
        for m, held in self.open.items():
            before = 0
            for place, (doc, start, length, total, ids) in enumerate(held):
                self.rows.append((doc, start, length, total, ids, None, None, m, place, before))
                before += length
        self.open = {}

    def take(self, number: int) -> pa.RecordBatch:
        doc, start, length, total, ids, sequence, offset, m, place, before = zip(*self.rows)
        self.rows = []
        values = pa.array(np.concatenate(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), values)
        columns = [doc, start, length, lists, total, sequence, offset, m, [number] * len(doc), place, before]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE
        )


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, classes: int, slack: float) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()
    worker = _Worker(number, capacity, classes, slack)
    end = np.array([END_ID], dtype=np.int32)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            ids, offsets = encoder(path).encode(part.column("text"))
            for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                worker.add(doc, np.concatenate([ids[a:b], end]))
            if worker.rows:
                yield worker.take(number)
    worker.leave()
    if worker.rows:
        yield worker.take(number)


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece.

    ``docs`` has doc_id and text; each text's ids are followed by the id 1.  Null and empty texts
    are that id alone.  Every id lies in exactly one piece, pieces lie in their sequence without
    gaps, and a sequence never exceeds ``capacity``.  Repeated rows are packed each on their own; a
    null doc_id is kept.  No rows give no rows; further columns are ignored.
    """
    path = tokenizer or word_bpe_path()
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = stage(narrow.mapInArrow(lambda b: _packed(b, path, capacity, classes, slack), PIECE_DDL), "pieces")
    out = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    full = done.filter("sequence_id is not null").select(*out)
    left = done.filter("sequence_id is null").drop("sequence_id", "offset")

    # prefix sums over tasks: one row per task and class
    per_task = left.groupBy("klass", "worker").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    earlier = Window.partitionBy("klass").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("klass")
    bases = per_task.select(
        "klass",
        "worker",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base_tokens"),
        F.sum("n").over(whole).alias("total"),
    )
    placed = left.join(bases, ["klass", "worker"]).withColumn("rank", F.col("base") + F.col("place"))
    in_bin = (F.col("klass") < classes) & (F.col("rank") < F.expr("total - total % klass"))
    binned = placed.filter(in_bin).withColumn(
        "sequence_id", F.expr(f"shiftleft({1 << 20}L + klass, 40) + rank div klass")
    )
    before = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*out)

    # fewer than ``classes`` squared / 2 pieces fill no bin of their class; they follow the short rests
    rests = placed.filter(F.col("klass") == classes).withColumn("at", F.col("base_tokens") + F.col("before"))
    short = per_task.filter(F.col("klass") == classes).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    few = placed.filter(~in_bin & (F.col("klass") < classes))
    order = Window.partitionBy(F.lit(0)).orderBy("klass", "rank").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("at", F.coalesce(F.sum("length").over(order), F.lit(0)) + F.lit(short))
    stream = rests.unionByName(few).withColumn(
        "slot", F.explode(F.expr(f"sequence(at div {capacity}, (at + length - 1) div {capacity})"))
    )
    first, last = F.greatest(F.lit(0), F.expr(f"slot * {capacity} - at")), F.least("length", F.expr(f"(slot + 1) * {capacity} - at"))
    stream = stream.withColumns({"from": first, "upto": last}).select(
        "doc_id",
        (F.col("start") + F.col("from")).alias("start"),
        (F.col("upto") - F.col("from")).alias("length"),
        F.slice("ids", (F.col("from") + 1).cast("int"), (F.col("upto") - F.col("from")).cast("int")).alias("ids"),
        "doc_tokens",
        F.expr(f"shiftleft({1 << 21}L, 40) + slot").alias("sequence_id"),
        F.expr(f"at + from - slot * {capacity}").alias("offset"),
    )
    return full.unionByName(binned).unionByName(stream)


def with_crc32(pieces: DataFrame) -> DataFrame:
    """Adds ids_crc32: CRC-32 of the piece's little-endian unsigned 32-bit ids; drops the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            kept = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sums, pa.int64())], [*kept.schema.names, "ids_crc32"])

    rest = [f"`{n}` {t}" for n, t in pieces.dtypes if n != "ids"]
    return pieces.mapInArrow(run, ", ".join([*rest, "ids_crc32 bigint"]))
