"""Personal data: fixed patterns, and spans found by a character-level BiLSTM-CRF.

The tagger is trained in numpy on windows labelled by the patterns, a bounded sample; some phone
numbers lose their country prefix there, so that it learns the forms the patterns miss.  It reads
overlapping windows around every digit and at sign of a text, as each kind contains one.  Each
place takes the tag of the window in which it lies in the middle, and spans are read off the joined
tags of the whole text, so a span may cross windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.llm.tagger import Tagger, encode
from issueforge.llm.textvec import slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, CORE = 64, 32
SAMPLE = 4000  # windows the tagger is trained on
SURE = 0.9  # least posterior of every character of an added span
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind

# fixed patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, at sign and dotted domain, found from the at signs: linear on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns in code points, by start and kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


# windows


def cores(text: str) -> list[int]:
    """Starts of the stretches of CORE characters that cover all places near a trigger."""
    marks = {m.start() // CORE for m in _TRIGGER.finditer(text)}
    most = (len(text) - 1) // CORE
    return [c * CORE for c in sorted({n for m in marks for n in (m - 1, m, m + 1) if 0 <= n <= most})]


def windows(text: str, starts: list[int]) -> np.ndarray:
    """The window around each core: half a core more on either side."""
    return np.stack([encode(text, s - (WINDOW - CORE) // 2, WINDOW) for s in starts]) if starts else np.zeros((0, WINDOW), np.int64)


def tagged(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tag of every character; where spans overlap the first one counts."""
    tags = np.zeros(len(text), dtype=np.int64)
    for a, b, k in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
    return tags


def reconciled(starts: list[int], paths: np.ndarray, sure: np.ndarray, size: int) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, least posterior) of the spans in the joined middles of a text's windows."""
    edge = (WINDOW - CORE) // 2
    out, open_span = [], None
    last = None
    for n, start in enumerate(starts):
        if last is not None and start != last and open_span:
            out.append(open_span)
            open_span = None
        last = start + CORE
        for i, (tag, p) in enumerate(zip(paths[n, edge : edge + CORE].tolist(), sure[n, edge : edge + CORE].tolist())):
            place, kind = start + i, (tag - 1) // 2
            if place >= size:
                break
            if tag and tag % 2 == 0 and open_span and open_span[2] == kind:
                open_span = (open_span[0], place + 1, kind, min(open_span[3], p))
                continue
            if open_span:
                out.append(open_span)
            open_span = (place, place + 1, kind, p) if tag else None
    return out + [open_span] * (open_span is not None)


def found_spans(text: str, starts: list[int], paths: np.ndarray, sure: np.ndarray, base: list, least: float) -> list[tuple[int, int, int]]:
    """Base spans and the sure ones of the tagger that touch none of them."""
    taken = np.zeros(len(text) + 1, dtype=bool)
    for a, b, _ in base:
        taken[a:b] = True
    added = []
    for a, b, kind, p in reconciled(starts, paths, sure, len(text)):
        if p >= least and not taken[a:b].any() and _TRIGGER.search(text, a, b) and b - a >= 7:
            added.append((a, b, kind))
    return base + added


# training


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids, tags = [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            shift = hashlib.blake2b(text.encode(), digest_size=8).digest()
            if shift[0] % 3 == 0:  # a phone number without its country prefix is one all the same
                for a, b, k in reversed(spans):
                    cut = text.find(" ", a, b) + 1 if k == 3 else 0
                    if cut and b - cut >= 8:
                        text = text[:a] + text[cut:]
                        spans = [(x - (cut - a) * (x > a), y - (cut - a) * (y > a), z) for x, y, z in spans]
            starts = cores(text)
            own = tagged(text, spans)
            for n, (s, w) in enumerate(zip(starts, windows(text, starts))):
                first = s - (WINDOW - CORE) // 2
                t = np.zeros(WINDOW, dtype=np.int8)
                a, b = max(first, 0), min(first + WINDOW, len(text))
                t[a - first : b - first] = own[a:b]
                keys.append(hashlib.blake2b(shift + n.to_bytes(8, "little"), digest_size=8).digest())
                ids.append(w.astype(np.uint8).tobytes())
                tags.append(t.tobytes())
        kind = pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(ids, kind), pa.array(tags, kind)], ["key", "ids", "tags"])


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = 400) -> Tagger:
    """Fits the tagger on at most ``sample`` windows of ``docs`` (text), first in order of a hash.

    Half of them hold a pattern's span and half none, as far as there are so many.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text rlike '[0-9@]'")
    found = texts.mapInArrow(_labelled, "key binary, ids binary, tags binary").distinct()
    some = F.hex("tags").rlike("[1-9A-F]")
    rows = []
    for part in (found.filter(some), found.filter(~some)):
        rows += part.orderBy("key", "ids").limit(sample // 2).collect()
    tagger = Tagger(TAGS)
    if rows:
        ids = np.stack([np.frombuffer(r["ids"], np.uint8) for r in rows]).astype(np.int64)
        tags = np.stack([np.frombuffer(r["tags"], np.int8) for r in rows]).astype(np.int64)
        tagger.fit(ids, tags, steps)
    else:
        tagger.p["bias"] = np.concatenate([[50.0], np.zeros(TAGS - 1)])  # nothing seen, nothing found
    return tagger


def detect(docs: DataFrame, tagger: Tagger, least: float = SURE) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and all spans of every row.

    Offsets are code points, ends exclusive; null text is empty.  Repeated rows keep a row each;
    further columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                marked = part.column("marked").to_pylist()
                texts = [t.as_py() if m else "" for t, m in zip(part.column("text"), marked)]
                bases = [base_spans(t) if t else [] for t in texts]
                starts = [cores(t) if t else [] for t in texts]
                spans = [list(b) for b in bases]
                at = 0
                while at < len(texts):  # about 4,000 windows at once, a text's together
                    upto, n = at, 0
                    while upto < len(texts) and (n == 0 or n + len(starts[upto]) <= 4000):
                        n += len(starts[upto])
                        upto += 1
                    if n:
                        own = [i for i in range(at, upto) if starts[i]]
                        paths, sure = _decoded(known.value, texts, starts, own)
                        row = 0
                        for i in own:
                            m = len(starts[i])
                            spans[i] = found_spans(texts[i], starts[i], paths[row : row + m], sure[row : row + m], bases[i], least)
                            row += m
                    at = upto
                counts = np.zeros((len(texts), len(KINDS)), dtype=np.int64)
                for i, b in enumerate(bases):
                    for _, _, k in b:
                        counts[i, k] += 1
                digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(digests), pa.array([joined(s) for s in spans])],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("marked", F.col("text").rlike("[0-9@]"))
    ddl = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, ddl)


def _decoded(tagger: Tagger, texts: list[str], starts: list[list[int]], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([windows(texts[i], starts[i]) for i in own])
    parts = [tagger.decode(ids[a : a + 1000]) for a in range(0, len(ids), 1000)]
    return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])
