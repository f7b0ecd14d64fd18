"""Token ids of texts with a tokenizer file, through a bounded cache of word parts."""

from __future__ import annotations

import os
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from issueforge.llm.textvec import IDLE, Words, scan

CACHED = 600_000  # parts kept per Python worker; the cache is emptied when full

_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")]] = True
_SAFE = np.zeros(256, dtype=bool)  # an ASCII letter or digit
_SAFE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class PartEncoder:
    """Encodes with a tokenizer that lower-cases, ends tokens at white space and drops it (word_bpe_49k.json).

    Ids equal those of encoding the whole text.  A chunk between ASCII white space is parted before
    its closing punctuation where a letter or digit stands there, as this tokenizer never joins the
    two.  Parts are looked up by a 64-bit hash; those not met before are encoded many at a time:
    parts of letters alone have one word end each, by which their ids are told apart.
    """

    def __init__(self, path: str, limit: int = CACHED):
        # Spark runs a worker per core; threads of the tokenizer's own would each keep memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes
        self.start = self.size = np.zeros(0, dtype=np.int64)  # their ids in the pool
        self.pool, self.used = np.zeros(1 << 16, dtype=np.int32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in order, and how many each has."""
        texts = [p.decode("utf-8") for p in parts]
        sizes = np.zeros(len(parts), dtype=np.int64)
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        alone = [i for i, t in enumerate(texts) if not t.isalpha()]
        flat, owners = [], []
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            ids = np.array(self._encode([" ".join([texts[i] for i in some])])[0], dtype=np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                sizes[some] = np.diff(ends, prepend=0)
                flat.append(ids)
                owners += some
            else:  # letters that lower-casing turns into letters and marks
                alone += some
        for at in range(0, len(alone), 1000):
            some = alone[at : at + 1000]
            each = self._encode([texts[i] for i in some])
            sizes[some] = [len(ids) for ids in each]
            flat.append(np.array([i for ids in each for i in ids], dtype=np.int32))
            owners += some
        # back to the order of the parts
        found = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        owners = np.array(owners, dtype=np.int64)
        begin = np.zeros(len(parts), dtype=np.int64)
        begin[owners] = np.cumsum(sizes[owners]) - sizes[owners]
        return found[_ragged(begin, sizes)], sizes

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        ids, sizes = self._ids(parts)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)  # hashes are sorted and new
        self.known, self.start, self.size = (
            np.insert(old, at, new) for old, new in ((self.known, hashes), (self.start, starts), (self.size, sizes))
        )

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them), without special tokens; null is empty."""
        found = scan(texts)
        data, start, end = found.data, found.start, found.end
        # part each chunk before its closing punctuation
        last = np.maximum.accumulate(np.where(_CLOSING[data], 0, np.arange(1, len(data) + 1)))
        core = np.clip(last[end - 1], start, end) if len(end) else end
        tail = core - 1
        latin = (core - start >= 2) & (data[tail - 1] == 0xC3) & (data[tail] >= 0x80) & (data[tail] & 0x5F != 0x17) if len(end) else _SAFE[:0]
        core = np.where((core > start) & (_SAFE[data[tail]] | latin), core, end)
        start, end = np.stack([start, core], axis=1).ravel(), np.stack([core, end], axis=1).ravel()
        some = end > start
        parts = Words(data, found.offsets, start[some], end[some], np.repeat(found.doc, 2)[some])
        unique, first, place = np.unique(parts.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._clear()
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            raw = data.tobytes()
            which = first[new]
            self._learn(unique[new], [raw[a:b] for a, b in zip(parts.start[which].tolist(), parts.end[which].tolist())])
            at = np.searchsorted(self.known, unique)
        start, size = self.start[at][place], self.size[at][place]
        ids = self.pool[_ragged(start, size)]
        per_text = np.bincount(parts.doc, size, len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        return self._with_specials(texts, ids, offsets)

    def _with_specials(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token's string, in any case, are encoded whole."""
        marked = pc.match_substring(texts.fill_null(""), "<|")
        odd = [i for i in np.flatnonzero(np.asarray(marked)) if any(s.lower() in texts[int(i)].as_py().lower() for s in self.specials)]
        if not odd:
            return ids, offsets
        each = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
        for i in odd:
            each[i] = np.array(self._encode([texts[int(i)].as_py()])[0], dtype=np.int32)
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all runs, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


_KEPT: dict[str, PartEncoder] = {}
_LAST = [0.0]
IDLE_SECONDS = 15.0


def encoder(path: str) -> PartEncoder:
    """One encoder for each worker process and tokenizer file, dropped when the worker has other work."""
    _LAST[0] = time.monotonic()
    if path not in _KEPT:
        _KEPT[path] = PartEncoder(path)
    return _KEPT[path]


def _forget() -> None:
    if _KEPT and time.monotonic() - _LAST[0] > IDLE_SECONDS:
        _KEPT.clear()


IDLE.append(_forget)


def word_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
