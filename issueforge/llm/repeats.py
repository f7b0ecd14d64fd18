"""Exact removal of repeated byte strings: every byte under a 200-byte string that starts anywhere else too.

The named method sorts all suffixes of the corpus (a distributed suffix array) and reads the
repeats off neighbouring suffixes whose common prefix reaches 200 bytes.  Sorting all suffixes
exchanges at least a position and a comparable prefix per input byte, which is far beyond the
disk and shuffle budget of this job (see README).  This module finds the same bytes with the
same exactness argument made on content-chosen anchors, so that only strings near a repeat are
ever exchanged:

1. Anchors (winnowing).  Per document, every 100-byte gram gets a 64-bit hash; in every run of
   101 consecutive grams (exactly one 200-byte string) each gram of least hash is an anchor, the
   string's own anchor.  It depends on the string's bytes alone, so two occurrences of one
   string always have anchors of equal hash at the same offset.
2. Anchors whose hash occurs at least twice are kept (a native count with map-side combining,
   then a semi join that adaptive execution splits where one hash is hot).
3. Neighbourhoods.  Every string over a kept gram as its own anchor lies within 100 bytes before
   and after it, so one 128-bit fingerprint of those bytes stands for all of them.  Neighbourhoods
   are counted (natively, with map-side combining): where one occurs at least twice, all its
   strings are repeats, and no single string is listed.
4. Neighbourhoods met once may still share strings with others of the same anchor.  Only their
   anchors' distinct neighbourhoods are exchanged, as bytes, and compared string by string in the
   task that holds the anchor; each gets a 101-bit mask of the strings it shares.  An anchor of over
   GROUP neighbourhoods is not gathered: the bytes under BLOCK neighbouring strings are counted natively
   (where they occur twice, all these strings are repeats), then the strings, of which only those in
   blocks met once are looked up.
5. Masks go back to the places by a join and are gathered per document, which is bounded by the
   document's length: the removed bytes, their maximal runs and the digest of what is left.

Strings and neighbourhoods are taken as equal when their 128-bit fingerprints are: over n of them
a false match has probability below n^2 / 2^128.  Each input row is one document, repeated rows
included (a repeated row's strings all start elsewhere too).  Python runs per document in
Arrow batches; counting, joining and grouping are Spark's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.llm.stages import stage

# Fixed value of the contract: the length of a repeated string, in bytes.
WINDOW = 200
GRAM = 100  # bytes of an anchor gram; WINDOW - GRAM + 1 grams make one string
REACH = WINDOW - GRAM  # a string over an anchor starts at most so far before it
GROUP = 4096  # distinct neighbourhoods of one anchor compared in a task
BLOCK = 10  # neighbouring strings counted as one where an anchor has more

_B1, _B2, _BG = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9  # odd bases of the polynomial hashes
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _hashes(b: np.ndarray, base: int, size: int) -> np.ndarray:
    """Mixed polynomial hash of each ``size``-byte string of ``b`` (by start), modulo 2^64."""
    n = len(b)
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(b.astype(np.uint64) * powers, dtype=np.uint64, out=prefix[1:])
    starts = n - size + 1
    return _mix((prefix[size:] - prefix[:starts]) * inverse[:starts])


def _ranges(b: np.ndarray, base: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Polynomial hash, not mixed, of the bytes ``low`` to ``high`` of ``b``, modulo 2^64."""
    n = len(b)
    powers = np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64)), dtype=np.uint64)
    inverse = np.cumprod(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)), dtype=np.uint64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(b.astype(np.uint64) * powers[:n], dtype=np.uint64, out=prefix[1:])
    return (prefix[high] - prefix[low]) * inverse[low]


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) value of every run of ``w`` entries, by start (van Herk / Gil-Werman)."""
    fill = np.iinfo(np.uint64).max if least else 0
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, fill, dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, w)
    op = np.minimum if least else np.maximum
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(x) - w + 1
    return op(behind[:count], ahead[w - 1 : w - 1 + count])


def anchors_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the anchors of one document; none when it is shorter than WINDOW."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _hashes(b, _BG, GRAM)
    span = WINDOW - GRAM + 1
    least = _sliding(grams, span, True)  # per 200-byte string
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    reached = _sliding(padded, span, False)  # per gram: the greatest least value of a string over it
    at = np.flatnonzero(reached == grams)
    return at.astype(np.int64), grams[at]


def _text_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8") for t in column.to_pylist()]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, offsets, hashes = [], [], []
        for row, data in zip(batch.column("_row").to_pylist(), _text_bytes(batch.column("_text"))):
            at, h = anchors_of(data)
            rows.append(np.full(len(at), row, np.int64))
            offsets.append(at)
            hashes.append(h.view(np.int64))
        if rows:
            yield pa.record_batch([pa.array(np.concatenate(rows)), pa.array(np.concatenate(offsets)), pa.array(np.concatenate(hashes))], names=["_row", "pos", "h"])


def places_of(data: bytes, anchors: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, hashes, n1, n2) of some anchors of one document: the gram's hash and its neighbourhood's fingerprint."""
    b, at = np.frombuffer(data, dtype=np.uint8), np.asarray(anchors, dtype=np.int64)
    low, high = np.maximum(at - REACH, 0), np.minimum(at + WINDOW, len(b))
    shape = ((at - low) * 1024 + high - low).astype(np.uint64)  # how the document's ends cut it
    return at, _hashes(b, _BG, GRAM)[at], *(_mix(_ranges(b, base, low, high) + shape) for base in (_B1, _B2))


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for row, data, at in zip(batch.column("_row").to_pylist(), _text_bytes(batch.column("_text")), batch.column("at").to_pylist()):
            found = places_of(data, at)
            parts.append([np.full(len(at), row, np.int64), *(x.view(np.int64) for x in found)])
        if parts:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["_row", "pos", "h", "n1", "n2"])


def _neighbourhood_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the asked places, one row each; ``before`` are the bytes in front of the gram."""
    for batch in batches:
        asked, near = batch.column("asked"), []
        flat = asked.flatten()
        ends = np.cumsum(pa.compute.list_value_length(asked).to_numpy())
        before = np.minimum(np.asarray(flat.field("pos")), REACH)
        for data, positions in zip(_text_bytes(batch.column("_text")), np.split(np.asarray(flat.field("pos")), ends[:-1])):
            near += [data[max(p - REACH, 0) : p + WINDOW] for p in positions.tolist()]
        yield pa.record_batch(
            [*(flat.field(c) for c in ("h", "n1", "n2", "k", "m")), pa.array(before), pa.array(near, pa.binary())],
            names=["h", "n1", "n2", "k", "m", "before", "near"],
        )


def strings_of(before: np.ndarray, near: pa.Array, block: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside, h1, h2) of the strings of some neighbourhoods, by neighbourhood and bytes in front of the gram (0 to REACH).

    With ``block``: of the bytes under so many strings next to each other, a column each.
    """
    width = REACH + WINDOW
    sizes = np.asarray(pa.compute.binary_length(near), dtype=np.int64)
    ends = np.cumsum(sizes)
    first = np.arange(len(near)) * width + REACH - before  # grams lie under each other
    data = np.frombuffer(b"".join(near.to_pylist()), dtype=np.uint8)
    laid = np.zeros(len(near) * width, dtype=np.uint64)
    laid[np.arange(len(data)) + np.repeat(first - (ends - sizes), sizes)] = data
    laid = laid.reshape(-1, width)
    least, most = _blocks(block)
    low, high = REACH - most, REACH - least + WINDOW
    hashes = []
    for base in (_B1, _B2):
        powers = np.cumprod(np.append(np.uint64(1), np.full(width - 1, base, dtype=np.uint64)), dtype=np.uint64)
        back = np.cumprod(np.append(np.uint64(1), np.full(REACH, pow(base, -1, 1 << 64), dtype=np.uint64)), dtype=np.uint64)
        prefix = np.zeros((len(near), width + 1), dtype=np.uint64)
        np.cumsum(laid * powers, axis=1, dtype=np.uint64, out=prefix[:, 1:])
        hashes.append(_mix((prefix[:, high] - prefix[:, low]) * back[low]))
    inside = (most <= before[:, None]) & (WINDOW - least <= (sizes - before)[:, None])
    return inside, *hashes


def _blocks(block: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes in front of the gram, of each block of strings."""
    least = np.arange(0, REACH + 1, block)
    return least, np.minimum(least + block - 1, REACH)


def _masks(block: int) -> tuple[list[int], list[int]]:
    """The two halves of the mask of each block of strings."""
    bits = [((2 << int(b)) - (1 << int(a))) for a, b in zip(*_blocks(block))]
    halves = [np.array([x >> shift & (1 << 64) - 1 for x in bits], dtype=np.uint64).view(np.int64).tolist() for shift in (0, 64)]
    return halves[0], halves[1]


def _twice(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each of the 128-bit values occurs more than once."""
    order = np.argsort(h1)
    same = h1[order[1:]] == h1[order[:-1]]
    if (same & (h2[order[1:]] != h2[order[:-1]])).any():  # equal first halves must be told apart
        order = np.lexsort((h2, h1))
        same = h1[order[1:]] == h1[order[:-1]]
    same &= h2[order[1:]] == h2[order[:-1]]
    out = np.zeros(len(h1), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n1, n2, low, high): strings that neighbourhoods met once share with others of their anchor; rows are sorted by h."""

    def shared(rows: pa.RecordBatch) -> pa.RecordBatch:
        h = np.asarray(rows.column("h"))
        group = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
        inside, h1, h2 = strings_of(np.asarray(rows.column("before")), rows.column("near"))
        at, ahead = np.nonzero(inside)
        place = (group[at] * (REACH + 1) + ahead).astype(np.uint64)  # only strings of one anchor and offset are compared
        hits = np.zeros(inside.shape, dtype=bool)
        hits[at, ahead] = _twice(_mix(h1[at, ahead] ^ _mix(place)), h2[at, ahead])
        some = np.flatnonzero((np.asarray(rows.column("k")) == 1) & hits.any(axis=1))
        bit = np.uint64(1) << (np.arange(REACH + 1, dtype=np.uint64) & np.uint64(63))
        set_bits = np.where(hits[some], bit, np.uint64(0))
        masks = [np.bitwise_or.reduce(half, axis=1).view(np.int64) for half in (set_bits[:, :64], set_bits[:, 64:])]
        columns = [rows.column(c).take(pa.array(some)) for c in ("h", "n1", "n2")]
        return pa.record_batch([*columns, *map(pa.array, masks)], names=["h", "n1", "n2", "low", "high"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = np.asarray(now.column("h"))
        last = int(np.searchsorted(h, h[-1]))
        start = 0
        while start < last:  # whole anchors, about GROUP rows at once
            stop = min(int(np.searchsorted(h, h[min(start + GROUP, last) - 1], side="right")), last)
            yield shared(now.slice(start, stop - start))
            start = stop
        held = now.slice(last)
    if held is not None:
        yield shared(held)


def _string_rows(block: int):
    """The fingerprints of all strings (or blocks of them) of neighbourhoods, one row each.

    ``asks``: whether the verdict is wanted, as the neighbourhood was met once and ``low``, ``high`` do not name them.
    """
    masks = [np.array(x, dtype=np.int64) for x in _masks(block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                rows = batch.slice(start, GROUP)
                inside, h1, h2 = strings_of(np.asarray(rows.column("before")), rows.column("near"), block)
                at, place = np.nonzero(inside)
                told = [np.asarray(rows.column(c))[at] & m[place] for c, m in zip(("low", "high"), masks)]
                asks = (np.asarray(rows.column("k"))[at] == 1) & (told[0] | told[1] == 0)
                columns = [rows.column(c).take(pa.array(at)) for c in ("h", "n1", "n2")]
                values = [pa.array(place), *(pa.array(x[at, place].view(np.int64)) for x in (h1, h2))]
                yield pa.record_batch([*columns, pa.array(asks), *values], names=["h", "n1", "n2", "asks", "place", "h1", "h2"])

    return run


def starts_of(positions: list[int], low: list[int], high: list[int], size: int) -> np.ndarray:
    """Starts of the strings that masks name at places of a document of ``size`` bytes."""
    at = np.asarray(positions, dtype=np.int64)
    masks = np.stack([np.asarray(low, dtype=np.int64), np.asarray(high, dtype=np.int64)], axis=1)
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : REACH + 1]
    place, ahead = np.nonzero(bits)
    starts = at[place] - ahead
    return starts[(starts >= 0) & (starts + WINDOW <= size)]


def removal(data: bytes, starts: np.ndarray) -> tuple[int, int, int, str]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of one document given the starts of its repeated strings."""
    b = np.frombuffer(data, dtype=np.uint8)
    step = np.bincount(starts, minlength=len(b) + 1) - np.bincount(starts + WINDOW, minlength=len(b) + 1)
    gone = np.cumsum(step)[: len(b)] > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(b) > 0 and gone[0]))
    return len(b), int(gone.sum()), spans, hashlib.sha256(b[~gone].tobytes()).hexdigest()


def _report_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data, found in zip(_text_bytes(batch.column("_text")), batch.column("found")):
            masks = [np.asarray(found.values.field(c)) for c in ("pos", "low", "high")] if found.is_valid else [[], [], []]
            out.append(removal(data, starts_of(*masks, len(data))))
        yield pa.record_batch(
            [batch.column("_doc"), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.string())],
            names=["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _counted(near: DataFrame, names: list[str]) -> DataFrame:
    """The masks of ``_shared_rows`` for anchors of very many neighbourhoods: their strings counted by Spark."""
    key = ["h", "place", "h1", "h2"]

    def shared(rows: DataFrame, block: int) -> DataFrame:
        columns = "h long, n1 long, n2 long, asks boolean, place long, h1 long, h2 long"
        strings = rows.mapInArrow(_string_rows(block), columns)  # read twice, as they would take more room than their bytes
        again = strings.groupBy(*key).count().filter("count > 1").select(*key)
        hits = strings.filter("asks").join(again, key, "left_semi")
        half = lambda masks: F.bit_or(F.element_at(F.array(*(F.lit(x).cast("long") for x in masks)), F.col("place").cast("int") + 1))
        low, high = _masks(block)
        return hits.groupBy(*names).agg(half(low).alias("low"), half(high).alias("high"))

    none = F.lit(0).cast("long")
    blocks = stage(shared(near.withColumn("low", none).withColumn("high", none), BLOCK), "repeats-blocks")
    told = near.join(blocks, names, "left").withColumn("low", F.coalesce("low", none)).withColumn("high", F.coalesce("high", none))
    strings = stage(shared(stage(told, "repeats-wide", compression="zstd"), 1), "repeats-strings")
    return blocks.unionByName(strings).groupBy(*names).agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))


def repeated_strings(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept_sha256 (string): one row per input row.

    Texts are UTF-8 bytes (null: empty); a byte is removed when a 200-byte string over it also
    starts at another offset of the same or another document (overlapping ones included).
    n_spans counts maximal removed runs; kept_sha256 is the lowercase hex SHA-256 of the bytes
    left.  Texts shorter than 200 bytes lose nothing.  Null doc_ids stay null; repeated rows are
    separate documents; an empty table gives no rows; only doc_id and text are read.  Anchors of more
    than ``group`` different neighbourhoods take another way to the same rows.
    """
    own = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    own = stage(own, "repeats-docs", compression="zstd")
    # computed twice, as all anchors would take much room and most are dropped
    anchors = own.select("_row", "_text").mapInArrow(_anchor_rows, "_row long, pos long, h long")
    twice = stage(anchors.groupBy("h").count().filter("count >= 2").select("h"), "repeats-anchors")
    kept = anchors.join(twice, "h", "left_semi").groupBy("_row").agg(F.collect_list("pos").alias("at"))
    texts = own.select("_row", "_text")
    names = ["h", "n1", "n2"]
    places = stage(texts.join(kept, "_row").mapInArrow(_place_rows, "_row long, pos long, h long, n1 long, n2 long"), "repeats-places")
    near = places.groupBy(*names).agg(F.count("*").alias("k"), F.first("_row").alias("_row"), F.first("pos").alias("pos"))
    near = stage(near, "repeats-neighbourhoods")
    # neighbourhoods met once are compared with all others of their anchor, one copy of each
    mixed = near.groupBy("h").agg(F.count("*").alias("m"), F.min("k").alias("least")).filter("m > 1 and least = 1").select("h", "m")
    around = "h long, n1 long, n2 long, k long, m long, before long, near binary"
    asked = near.join(mixed, "h").groupBy("_row").agg(F.collect_list(F.struct("pos", *names, "k", "m")).alias("asked"))
    # neighbourhoods of one document overlap and are written next to each other, which zstd makes small
    compared = stage(texts.join(asked, "_row").mapInArrow(_neighbourhood_rows, around), "repeats-compared", compression="zstd")
    by_anchor = compared.filter(F.col("m") <= group).repartition("h").sortWithinPartitions("h")
    masks = stage(by_anchor.mapInArrow(_shared_rows, "h long, n1 long, n2 long, low long, high long"), "repeats-shared")
    wide = compared.filter(F.col("m") > group)
    if not wide.isEmpty():
        masks = masks.unionByName(stage(_counted(wide, names), "repeats-counted"))
    all_of = F.lit(-1).cast("long")
    verdicts = near.filter("k > 1").select(*names, all_of.alias("low"), all_of.alias("high")).unionByName(masks)
    found = places.join(verdicts, names).groupBy("_row").agg(F.collect_list(F.struct("pos", "low", "high")).alias("found"))
    found = stage(found, "repeats-found")
    columns = "_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    # one join, so that the texts are shuffled once; documents without repeats have no masks
    reported = own.join(found, "_row", "left").select("_doc", "_text", "found").mapInArrow(_report_rows, columns)
    return reported.withColumnRenamed("_doc", "doc_id")
