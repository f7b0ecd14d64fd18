"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector shared by ordered thresholds.  x holds
presence of words (letters and digits, A-Z lower-cased) and of their stems, as inflected forms are
rarely met twice.  The model is fitted in numpy on a bounded
sample of labelled rows by proximal gradient steps with an L1 penalty, which leaves the few words
that carry severity.  Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.llm.textvec import PUNCTUATED, Words, _mixed, scan, slices

SAMPLE = 5000  # most labelled rows the model is fitted on
LEAST_DOCS = 3  # labelled texts a word must occur in
PENALTY = 3e-3
REJECT_AT = 0.3
STEMS = (4, 5)  # bytes
GRADES = 3


@dataclass
class OrdinalModel:
    """Words (sorted hashes) with their weights, and the ordered thresholds between grades."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, eta: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each row and threshold."""
        return _sigmoid(self.thresholds[None, :] - eta[:, None])

    def expected(self, eta: np.ndarray) -> np.ndarray:
        return (1 - self.below(eta)).sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -700, 700)))


def _occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of all words, and of the first bytes of longer words as their stems."""
    found = scan(texts, PUNCTUATED)
    rows, hashes = [found.doc], [found.hashes()]
    for k in STEMS:
        longer = found.end - found.start > k
        start = found.start[longer]
        stem = Words(found.data, found.offsets, start, start + k, found.doc[longer])
        rows.append(stem.doc)
        hashes.append(_mixed(stem.hashes() + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of the distinct words and stems of every text."""
    row, own = _occurrences(texts)
    unique, place = np.unique(own, return_inverse=True)
    if not len(unique):
        return np.zeros(0, np.int64), unique
    pairs = np.unique(row.astype(np.int64) * len(unique) + place)
    return pairs // len(unique), unique[pairs % len(unique)]


def fit_ordinal(
    row: np.ndarray, word: np.ndarray, grade: np.ndarray, penalty: float = PENALTY, steps: int = 200, least: int = LEAST_DOCS
) -> OrdinalModel:
    """Mean negative log likelihood plus penalty * |w|, then refitted on the words kept with a twentieth of it.

    ``grade`` counts from 0.  Thresholds stay ordered.  Without words or rows the model has thresholds only.
    """
    n, levels = len(grade), int(max(grade.max(initial=0) + 1, 2))
    words, column, docs = np.unique(word, return_inverse=True, return_counts=True)
    often = docs >= least
    keep = often[column]
    row, column, words = row[keep], (np.cumsum(often) - 1)[column[keep]], words[often]
    share = np.clip(np.cumsum(np.bincount(grade, minlength=levels))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-6 * np.arange(levels - 1))
    weights = np.zeros(len(words))
    for part in (penalty, penalty / 20):
        if not n or not len(words):
            break
        weights, thresholds = _descend(row, column, weights, start, grade, part, steps)
        kept = weights != 0
        keep = kept[column]
        row, column = row[keep], (np.cumsum(kept) - 1)[column[keep]]
        words, weights, start = words[kept], weights[kept], thresholds
    return OrdinalModel(words, weights, start)


def _descend(row, column, weights, thresholds, grade, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient steps from the given weights and thresholds."""
    n, m, levels = len(grade), len(weights), len(thresholds) + 1
    # columns are scaled by how often they occur, so that frequent words do not set the step size
    scale = 1.0 / np.sqrt(np.bincount(column, minlength=m) / n)
    value = scale[column]
    upper, lower = grade < levels - 1, grade > 0
    above, below = np.minimum(grade, levels - 2), np.maximum(grade - 1, 0)

    def gradient(w, th):
        eta = np.bincount(row, value * w[column], n)
        a = np.where(upper, _sigmoid(th[above] - eta), 1.0)
        b = np.where(lower, _sigmoid(th[below] - eta), 0.0)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        g_eta = (da - db) / p / n
        g_th = np.bincount(above[upper], -(da / p)[upper] / n, levels - 1)
        g_th += np.bincount(below[lower], (db / p)[lower] / n, levels - 1)
        return np.bincount(column, value * g_eta[row], m), g_th

    v, norm = np.ones(m) / np.sqrt(m), 0.0
    for _ in range(15):  # a bound of the largest curvature by power iteration
        u = np.bincount(column, value * np.bincount(row, value * v[column], n)[row], m)
        norm = np.linalg.norm(u)
        v = u / max(norm, 1e-12)
    step = 1.0 / max(0.5 * norm / n, 0.5)
    shrink = step * penalty * scale
    w = w_prev = weights / scale
    th = th_prev = thresholds
    momentum = 1.0
    for _ in range(steps):
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        factor = (momentum - 1) / following
        yw, yt = w + factor * (w - w_prev), th + factor * (th - th_prev)
        gw, gt = gradient(yw, yt)
        w_prev, th_prev, momentum = w, th, following
        w = yw - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0.0)
        th = np.maximum.accumulate(yt - step * gt)
    return w * scale, th


def graded(row: np.ndarray, word: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity grades from yes/no labels: 0 not toxic, 1 toxic, 2 toxic with more marked words than usual.

    A marked word is one at least four times as frequent in toxic as in other labelled texts.  Toxic
    texts whose number of distinct marked words exceeds the median of the toxic ones get grade 2.
    """
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    words, column = np.unique(word, return_inverse=True)
    in_toxic = np.bincount(column, toxic[row].astype(float), len(words))
    in_other = np.bincount(column, (~toxic[row]).astype(float), len(words))
    marked = (in_toxic >= LEAST_DOCS) & ((in_toxic + 0.5) / n1 >= 4 * (in_other + 0.5) / n0)
    count = np.bincount(row, marked[column].astype(float), len(toxic))
    middle = np.median(count[toxic]) if toxic.any() else 0
    return np.where(toxic, np.where(count > middle, 2, 1), 0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> OrdinalModel:
    """Fits on at most ``sample`` labelled rows, the first in order of a hash of the id.

    ``labels`` has doc_id and either ``grade`` (from 0) or ``toxic`` (0/1, graded by ``graded``).
    Rows with null labels or ids are not used; repeated labels count each.
    """
    target = "grade" if "grade" in labels.columns else "toxic"
    chosen = (
        labels.select("doc_id", F.col(target).cast("int").alias("target"))
        .filter("doc_id is not null and target is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "target")
        .limit(sample)
    )
    rows = chosen.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, word = features(part.column("text"))
                sizes = np.bincount(row, minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(word.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("target"), lists], ["doc_id", "target", "words"])

    got = rows.select("doc_id", "target", "text").mapInArrow(run, "doc_id bigint, target int, words array<bigint>")
    got = got.toArrow().sort_by([("doc_id", "ascending"), ("target", "ascending")]).combine_chunks()
    if not got.num_rows:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([700.0] * (GRADES - 1)))
    lists = got.column("words").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(got.num_rows), sizes)
    word = np.asarray(lists.flatten()).view(np.uint64)
    value = np.asarray(got.column("target")).astype(np.int64)
    grade = np.maximum(value, 0) if target == "grade" else graded(row, word, value == 1)
    return fit_ordinal(row, word, grade, **options)


def _scores(texts: pa.Array, m: OrdinalModel) -> np.ndarray:
    """w . x of every text."""
    row, own = _occurrences(texts)
    if not len(m.words) or not len(own):
        return np.zeros(len(texts))
    at = np.minimum(np.searchsorted(m.words, own), len(m.words) - 1)
    hit = np.flatnonzero(m.words[at] == own)
    pairs = np.unique(row[hit].astype(np.int64) * len(m.words) + at[hit])
    return np.bincount(pairs // len(m.words), m.weights[pairs % len(m.words)], len(texts))


def without_toxic(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs``, all columns, that ``severity`` does not reject; needs no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(known.value.expected(_scores(part.column("text"), known.value)) < reject_at))

    return docs.mapInArrow(run, docs.schema)


def severity(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """(doc_id, expected_severity, grade, rejected) of every row of (doc_id, text).

    ``grade`` is the most probable one and ``rejected`` says that the expected severity reaches
    ``reject_at``.  Null and empty texts have no features and so the least severity.  Repeated rows
    keep a row each; further columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                eta = _scores(part.column("text"), m)
                below = np.hstack([np.zeros((n, 1)), m.below(eta), np.ones((n, 1))])
                expected = m.expected(eta)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(expected), pa.array(np.diff(below, axis=1).argmax(axis=1), pa.int32()), pa.array(expected >= reject_at)],
                    ["doc_id", "expected_severity", "grade", "rejected"],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, expected_severity double, grade int, rejected boolean")
