"""Cross-tokenizer alignment: where two tokenizers' tokens of one text share byte boundaries, and which ids overlap.

Tokenizer A is a byte-level BPE (``tokenizers``), fed a space and the text; tokenizer B is a
sentencepiece BPE with byte fallback, fed the text (it adds the space itself).  Spans come from
the libraries: A's character offsets and B's proto spans (byte offsets into the text) give each
token a coarse range.  Where a character is split over several tokens (byte-level pieces of a
multibyte character, ``<0xHH>`` fallback pieces), the coarse ranges overlap or cover the whole
character; there the range is refined by the token's decoded bytes, laid end to end.  A text
whose joined decoded bytes differ from space+text (for either side) is not aligned.

Texts are parted before a space and around a newline where a character that is no white space stands
next to it: there both tokenizers end a token whatever surrounds it (A's pattern splits there, and no
piece of B holds a space after another character, or a newline; ``Aligner`` checks the files for it).
So a part's tokens and groups are those it has inside any text.  A Python worker aligns each distinct
part once, keeps a bounded number of them, told apart by 64-bit hashes, and puts texts together.

Per document a Python task (Arrow batches) tokenizes and cuts, and emits the distinct linked id
pairs with their multiplicity, not one row per link.  Spark counts pairs corpus-wide (map-side
combining), finds each B id's highest count, and joins the counts back: broadcast when the
counted pair table has at most ``PAIR_ROWS`` rows, by a shuffle join otherwise.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.llm.stages import stage
from issueforge.llm.textvec import Words
from issueforge.llm.tokens import _ragged

# Tokenizer files: parameters of the operator, never copied into the repository.
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PAIR_ROWS = 2_000_000  # counted (a, b) pairs of about 20 bytes, broadcast below this
CHUNK_BYTES = 1 << 20  # text tokenized at once by a Python worker
CACHED = 600_000  # parts kept per Python worker; all are dropped when there are more
BLOCK_BYTES = 1 << 15  # of parts tokenized as one text

# bytes that end or begin a character that is no white space: ASCII, and the leads of U+00C0 to U+07FF
_SHOWN = np.zeros(256, dtype=bool)
_SHOWN[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True


def _byte_level() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 upwards in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown, extra = {b: b for b in own}, 0
    for b in range(256):
        if b not in shown:
            shown[b], extra = 256 + extra, extra + 1
    return {chr(c): b for b, c in shown.items()}


class Aligner:
    """Both tokenizers and their token bytes, loaded once per Python worker."""

    def __init__(self, folder: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        if folder is None:
            import public_tokenizers

            a_path, b_path = public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)
        else:
            a_path, b_path = f"{folder}/{A_FILE}", f"{folder}/{B_FILE}"
        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        back = _byte_level()
        a_vocab = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in back for c in t)}
        self.a_table = _Table([a_vocab.get(i, b"") for i in range(max(a_vocab) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_vocab = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                b_vocab.append(bytes([int(piece[3:5], 16)]))
            else:
                b_vocab.append(piece.replace("▁", " ").encode("utf-8"))
        self.b_table = _Table(b_vocab)
        state = json.loads(self.a.to_str())
        splits = state["pre_tokenizer"] or {}
        self.parted = (
            state["normalizer"] is None
            and splits.get("type") == "ByteLevel"
            and splits.get("use_regex", False)
            and not splits.get("add_prefix_space", True)
            and not any(b" " in p.lstrip(b" ") or b"\n" in p[:-1] for p in b_vocab)
            and self.b.encode("\n", out_type=str) == ["▁", "<0x0A>"]
        )

    def tokens(self, texts: list[str], inner: bool = False) -> list[tuple | None]:
        """Per text: (a_ids, a_ends, a_refined, b_ids, b_ends, b_refined) with byte ends, or None if tokens spell another text.

        Texts begin with the space that B adds by itself, or are ``inner`` parts: those follow a newline for B,
        whose tokens are dropped.
        """
        a_all = self.a.encode_batch(texts, add_special_tokens=False)
        b_all = self.b.encode([("\n" + t) if inner else t[1:] for t in texts], return_type="proto", num_threads=1)
        out = []
        for text, a, b in zip(texts, a_all, b_all):
            whole = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            a_ids = np.asarray(a.ids, dtype=np.int64)
            spans = np.array([(p.id, p.begin, p.end) for p in b.pieces], dtype=np.int64).reshape(-1, 3)[2 if inner else 0 :]
            b_ids = spans[:, 0]
            if not (self.a_table.spells(a_ids, whole) and self.b_table.spells(b_ids, whole)):
                out.append(None)
                continue
            # byte offset of every character of the text, and of its end
            chars = np.append(np.flatnonzero((whole & 0xC0) != 0x80), len(whole))
            offsets = np.asarray(a.offsets, dtype=np.int64).reshape(-1, 2)
            shift = -1 if inner else 1
            b_lo = spans[:, 1] + shift
            if not inner:
                b_lo[:1] = 0  # the space sentencepiece adds belongs to its first piece
            a_ends, a_refined = _refine(chars[offsets[:, 0]], chars[offsets[:, 1]], self.a_table.sizes[a_ids])
            b_ends, b_refined = _refine(b_lo, spans[:, 2] + shift, self.b_table.sizes[b_ids])
            out.append((a_ids, a_ends, a_refined, b_ids, b_ends, b_refined))
        return out

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Parts of texts, each text with its space in front, none empty."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        if self.parted and len(data) > 2:
            ends = _SHOWN[data]
            ends[1:] |= _LEAD[data[:-1]]
            starts = _SHOWN[data] | _LEAD[data]
            cut[1:-1] |= ends[:-1] & ((data[1:] == 32) | (data[1:] == 10))
            cut[2:-1] |= ends[:-2] & (data[1:-1] == 10) & starts[2:]
        start = np.flatnonzero(cut[:-1])
        return Words(data, offsets, start, np.append(start[1:], len(data)), np.searchsorted(offsets, start, side="right") - 1)


class _Table:
    """Token bytes of a vocabulary in one buffer, for vectorized lengths and spelling checks."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(pieces) or b"\0", dtype=np.uint8)

    def spells(self, ids: np.ndarray, whole: np.ndarray) -> bool:
        """Whether the tokens' bytes, joined, are exactly ``whole``; unknown or empty tokens spell nothing."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            return False
        sizes = self.sizes[ids]
        if sizes.sum() != len(whole) or (len(ids) and sizes.min() == 0):
            return False
        ends = np.cumsum(sizes)
        at = np.arange(len(whole)) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[ids], sizes)
        return bool(np.array_equal(self.buffer[at], whole))


def _refine(lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of tokens: the coarse range where it holds exactly the token's bytes at its place, else the decoded bytes laid on.

    Returns the ends and which tokens needed the decoded bytes.  As the joined bytes equal the
    text, laying every token on gives the same ends; the coarse ranges are the first word.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    coarse = (lo == starts) & (hi - lo == sizes)
    ends = np.where(coarse, hi, starts + sizes)
    return ends, ~coarse


_COUNTS = ("n_a", "n_b", "n_groups", "n_refined")


def alignments(tokens: tuple, part_ends: np.ndarray) -> tuple[dict[str, np.ndarray], bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's parts (by their byte ends, where tokens of both sides end): counts, the groups' text with a ``;``
    after each group, how much of it each part has, the linked id pairs of all links, and how many each part has."""
    a_ids, a_ends, a_refined, b_ids, b_ends, b_refined = tokens
    n = len(part_ends)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group = np.searchsorted(cuts, a_ends)
    b_group = np.searchsorted(cuts, b_ends)
    # every group has tokens of both sides: A ids joined by ',', '|', B ids joined by ',', then ';'
    a_tail = np.where(np.append(a_group[1:] == a_group[:-1], False), ",", "|")
    b_tail = np.where(np.append(b_group[1:] == b_group[:-1], False), ",", ";")
    words = [f"{i}{t}" for i, t in zip(a_ids.tolist(), a_tail.tolist())] + [f"{i}{t}" for i, t in zip(b_ids.tolist(), b_tail.tolist())]
    order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
    text = "".join([words[k] for k in order.tolist()]).encode()
    # the pieces between consecutive ends of either side: each lies in one A and one B token
    pieces = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    pieces = pieces[np.diff(pieces, prepend=-1) > 0]
    keys = a_ids[np.searchsorted(a_ends, pieces)] * 65536 + b_ids[np.searchsorted(b_ends, pieces)]
    a_part, b_part = np.searchsorted(part_ends, a_ends), np.searchsorted(part_ends, b_ends)
    counts = {
        "n_a": np.bincount(a_part, minlength=n),
        "n_b": np.bincount(b_part, minlength=n),
        "n_groups": np.bincount(np.searchsorted(part_ends, cuts), minlength=n),
        "n_refined": np.bincount(a_part[a_refined], minlength=n) + np.bincount(b_part[b_refined], minlength=n),
    }
    sizes = np.bincount(np.concatenate([a_part, b_part]), [len(w) for w in words], n).astype(np.int64)
    return counts, text, sizes, keys, np.bincount(np.searchsorted(part_ends, pieces), minlength=n)


class Parts:
    """Alignments of the parts that a worker has met, by their hashes."""

    def __init__(self, aligner: Aligner, limit: int = CACHED):
        self.aligner, self.limit = aligner, limit
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes
        names = (*_COUNTS, "spelled", "text_at", "text_size", "links_at", "n_links")
        self.columns = {c: np.zeros(0, dtype=np.int64) for c in names}
        self.pools = {"text": (np.zeros(1 << 20, dtype=np.uint8), 0), "links": (np.zeros(1 << 18, dtype=np.int64), 0)}

    def _kept(self, pool: str, values: np.ndarray) -> int:
        """Adds to a pool; returns where."""
        held, used = self.pools[pool]
        if used + len(values) > len(held):
            held = np.concatenate([held, np.zeros(max(len(held), len(values)), dtype=held.dtype)])
        held[used : used + len(values)] = values
        self.pools[pool] = held, used + len(values)
        return used

    def _blocks(self, parts: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
        """Parts to tokenize as one text: those with a space in front, those to put on lines of their own, and single ones."""
        spaced, lines, alone = [], [], []
        for i, p in enumerate(parts):
            closed = len(p) > 1 and (_SHOWN[p[-1]] or _LEAD[p[-2]])
            into = alone if not closed else spaced if p[0] == 32 else lines if _SHOWN[p[0]] or _LEAD[p[0]] else alone
            into.append(i)
        return self._cut(parts, spaced), self._cut(parts, lines), [[i] for i in alone]

    def _cut(self, parts: list[bytes], some: list[int]) -> list[list[int]]:
        """Consecutive ones of about BLOCK_BYTES."""
        block = np.cumsum([len(parts[i]) for i in some]) // BLOCK_BYTES
        return [x.tolist() for x in np.split(np.array(some, dtype=np.int64), np.flatnonzero(np.diff(block)) + 1) if len(x)]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        new = {c: np.zeros(len(parts), dtype=np.int64) for c in self.columns}
        parted = self.aligner.parted
        spaced, lines, alone = self._blocks(parts) if parted else ([], [], [[i] for i in range(len(parts))])
        for blocks, inner, glue in ((spaced, False, b""), (lines, True, b"\n"), (alone, parted, b"")):
            while blocks:
                some, blocks = blocks[:64], blocks[64:]
                found = self.aligner.tokens([glue.join([parts[i] for i in block]).decode("utf-8") for block in some], inner)
                for block, tokens in zip(some, found):
                    if tokens is None:  # a part that its tokens do not spell hides its neighbours
                        alone += [[i] for i in block] if len(block) > 1 else []
                        continue
                    step = 1 + len(glue)  # every newline between parts is a part of its own
                    sizes = np.full(len(block) * step - step + 1, 1)
                    sizes[::step] = [len(parts[i]) for i in block]
                    counts, text, text_size, links, n_links = alignments(tokens, np.cumsum(sizes))
                    for c in _COUNTS:
                        new[c][block] = counts[c][::step]
                    new["spelled"][block] = 1
                    new["text_size"][block], new["n_links"][block] = text_size[::step], n_links[::step]
                    new["text_at"][block] = self._kept("text", np.frombuffer(text, dtype=np.uint8)) + (np.cumsum(text_size) - text_size)[::step]
                    new["links_at"][block] = self._kept("links", links) + (np.cumsum(n_links) - n_links)[::step]
        at = np.searchsorted(self.known, hashes)  # hashes are sorted and new
        self.known = np.insert(self.known, at, hashes)
        self.columns = {c: np.insert(old, at, new[c]) for c, old in self.columns.items()}

    def of(self, parts: Words) -> dict[str, np.ndarray]:
        """Columns of all parts, in order."""
        unique, first, place = np.unique(parts.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._clear()
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            raw, which = parts.data.tobytes(), first[new]
            self._learn(unique[new], [raw[a:b] for a, b in zip(parts.start[which].tolist(), parts.end[which].tolist())])
            at = np.searchsorted(self.known, unique)
        return {c: values[at][place] for c, values in self.columns.items()}


_PARTS: Parts | None = None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _PARTS
    if _PARTS is None:
        _PARTS = Parts(Aligner())
    for whole in batches:
        for batch in _pieces(whole):
            yield from _aligned(batch)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about CHUNK_BYTES of text: a library's token objects take far more memory than the text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def _aligned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The document rows of a slice, then its link rows (distinct id pairs with multiplicity)."""
    n = batch.num_rows
    text = batch.column("_text").cast(pa.large_string()).fill_null("")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset : spaced.offset + n + 1]
    data = np.frombuffer(spaced.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    parts = _PARTS.aligner.parts(data, offsets)
    of = _PARTS.of(parts)
    told = (np.diff(offsets) > 1) & (np.bincount(parts.doc, of["spelled"] == 0, n) == 0)  # the others have no tokens
    sums = {c: np.where(told, np.bincount(parts.doc, of[c], n), 0).astype(np.int64) for c in (*_COUNTS, "n_links", "text_size")}
    groups = memoryview(_PARTS.pools["text"][0][_ragged(of["text_at"], of["text_size"])])
    ends = np.cumsum(np.bincount(parts.doc, of["text_size"], n)).astype(np.int64)
    digests = [hashlib.sha256(groups[e - s : e - 1]).hexdigest() if t else "" for e, s, t in zip(ends.tolist(), sums["text_size"].tolist(), told.tolist())]
    yield pa.record_batch(
        [batch.column("_row"), batch.column("_doc"), *(pa.nulls(n, pa.int64()) for _ in range(3))]
        + [pa.array(sums[k]) for k in ("n_a", "n_b", "n_groups", "n_links", "n_refined")]
        + [pa.array(digests, pa.string())],
        schema=_SCHEMA,
    )
    some = told[parts.doc]
    links = _PARTS.pools["links"][0][_ragged(of["links_at"][some], of["n_links"][some])]
    if len(links):
        # (row, a, b) of a link in one integer: b has 16 bits, a 16
        pairs, times = np.unique((np.repeat(parts.doc[some], of["n_links"][some]) << 32) + links, return_counts=True)
        at = pa.array(pairs >> 32)
        row_ids, doc_ids = batch.column("_row").take(at), batch.column("_doc").take(at)
        yield pa.record_batch(
            [row_ids, doc_ids, pa.array((pairs >> 16) & 0xFFFF), pa.array(pairs & 0xFFFF), pa.array(times.astype(np.int64))]
            + [pa.nulls(len(pairs), pa.int64()) for _ in range(5)]
            + [pa.nulls(len(pairs), pa.string())],
            schema=_SCHEMA,
        )


_SCHEMA = pa.schema(
    [("_row", pa.int64()), ("_doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("mult", pa.int64())]
    + [(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links", "n_refined")]
    + [("groups_sha256", pa.string())]
)
_DDL = "_row long, _doc long, a long, b long, mult long, n_a long, n_b long, n_groups long, n_links long, n_refined long, groups_sha256 string"


def cross_tokenizer_alignment(docs: DataFrame, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 (string), n_refined (long).

    Groups: tokens between consecutive byte offsets where an A token and a B token both end,
    written ``a1,a2|b1;a3|b2,b3`` and hashed (lowercase hex SHA-256).  Links: A-B token pairs
    whose byte ranges overlap; an id pair's count is its number of links corpus-wide; n_best
    counts the document's links whose count is the highest of their B id (ties included);
    count_sum sums their counts.  Null, empty or unalignable texts: zeros and '' (unhashed).
    Each row is a document (repeated rows count twice); null doc_ids stay null; an empty table
    gives no rows; only doc_id and text are read.  n_refined: tokens whose coarse span was
    refined by decoded bytes.
    """
    own = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    tokens = stage(own.mapInArrow(_rows, _DDL), "align-tokens")
    links = tokens.filter("a IS NOT NULL").select("_row", "a", "b", "mult")
    pairs = links.groupBy("a", "b").agg(F.sum("mult").alias("count"))
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))
    pairs = stage(pairs.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best")), "align-pairs")
    side = F.broadcast(pairs) if pairs.count() <= pair_rows else pairs
    per_doc = links.join(side, ["a", "b"]).groupBy("_row").agg(
        F.sum(F.col("mult") * F.col("best")).alias("n_best"), F.sum(F.col("mult") * F.col("count")).alias("count_sum")
    )
    found = tokens.filter("a IS NULL").join(per_doc, "_row", "left")
    return found.select(
        F.col("_doc").alias("doc_id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
        "n_refined",
    )
