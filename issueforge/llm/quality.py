"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each document becomes a vector of transformed statistics.  The estimate of a group starts from its
medians and median deviations; concentration steps then keep the h = share * n rows of smallest
Mahalanobis distance and take their mean and covariance.  Each step is two partial aggregations over
all rows (a quantile sketch and sums of products), so no group is ever gathered in one task; only
one row per group is handled in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.llm.textvec import SPACE, scan, shingles, slices
from issueforge.llm.stages import stage

SHARE = 0.75  # of a group's rows that the estimate must cover
STEPS = 4
LEAST_ROWS = 50  # smaller groups are judged by the estimate over all rows
CUTOFF = 45.0  # squared distance; chi-square with five degrees of freedom exceeds it in 1 of 7e7 rows
# smallest deviation by statistic, in transformed units: counts that hardly vary must not make a point mass
FLOORS = (0.35, 0.06, 0.09, 0.5, 0.25)
DIMENSIONS = tuple(f"x{i}" for i in range(len(FLOORS)))
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


# statistics of a text


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n = part.num_rows
            found = scan(part.column("text"), SPACE, lower=False)
            hashes, counts = found.hashes(), found.counts()
            whole = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])  # code points before a byte
            chars = np.bincount(found.doc, whole[found.end] - whole[found.start], n).astype(np.int64)
            symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[found.data])])
            symbols = symbols[found.offsets[1:]] - symbols[found.offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("lang"), part.column("source"), pa.array(counts), pa.array(chars), pa.array(symbols),
                    pa.array(_duplicate_lines(found)), pa.array(_repeated_words(hashes, found.doc, counts)),
                ],
                ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )


def _duplicate_lines(found) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, byte by byte."""
    n = len(found.offsets) - 1
    begin = np.unique(np.concatenate([found.offsets[:-1], np.flatnonzero(found.data == 10) + 1]))
    begin = begin[begin < len(found.data)]
    doc = np.searchsorted(found.offsets, begin, side="right") - 1
    newline = np.append(np.flatnonzero(found.data == 10), len(found.data))
    end = np.minimum(newline[np.searchsorted(newline, begin)], found.offsets[doc + 1])
    has_word = np.searchsorted(found.start, end) > np.searchsorted(found.start, begin)
    begin, end, doc = begin[has_word], end[has_word], doc[has_word]
    lines = type(found)(found.data, found.offsets, begin, end, doc)
    own = lines.hashes()
    order = np.lexsort((own, doc))
    same = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=n)


def _repeated_words(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words covered by three-word windows that occur at least twice in their text."""
    grams, owner = shingles(hashes, doc, len(counts), 3)
    n_grams = np.bincount(owner, minlength=len(counts))
    long = counts[owner] >= 3
    place = np.arange(len(owner)) - (np.cumsum(n_grams) - n_grams)[owner]
    at = ((np.cumsum(counts) - counts)[owner] + place)[long]
    grams, owner = grams[long], owner[long]
    order = np.lexsort((grams, owner))
    same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    for step in range(3):
        covered[at[order][twice] + step] = True
    return np.bincount(doc, covered[: len(doc)], len(counts)).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of (doc_id, text, lang, source).

    Words are runs without ASCII white space, case kept; null text has none.  ``n_symbols`` counts
    characters of ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an earlier one, and
    ``n_repeat_words`` words in three-word windows that occur twice or more.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source"))
    )
    return rows.mapInArrow(
        _statistics,
        "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint",
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def transformed() -> list[Column]:
    """The vector: log length, word length, and square roots of the shares of symbols, lines and repeats."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


# estimates


def _distance(x: list[str]) -> Column:
    """Squared distance from the columns ``mean`` and ``precision`` (row-major)."""
    p = len(x)
    away = [F.col(c) - F.element_at("mean", i + 1) for i, c in enumerate(x)]
    terms = [
        away[i] * away[j] * F.element_at("precision", i * p + j + 1) * (1 if i == j else 2) for i in range(p) for j in range(i, p)
    ]
    return sum(terms[1:], terms[0])


def _precision(covariance: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Inverse covariance with each deviation raised to its floor, correlations kept."""
    deviation = np.sqrt(np.maximum(np.diag(covariance), 0))
    raised = np.maximum(deviation, floors)
    correlation = covariance / np.outer(np.maximum(deviation, 1e-12), np.maximum(deviation, 1e-12))
    correlation = np.where(np.outer(deviation > 1e-9, deviation > 1e-9), correlation, 0.0)
    correlation = 0.95 * correlation
    np.fill_diagonal(correlation, 1.0)
    return np.linalg.inv(correlation * np.outer(raised, raised))


def _models(table: pa.Table, floors: np.ndarray, from_sums: bool) -> pa.Table:
    """(lang, source, mean, precision) of each group from its medians or its sums."""
    p = len(floors)
    means, precisions = [], []
    for r in table.to_pylist():
        if from_sums:
            n, mean = r["n"], np.array(r["sums"]) / r["n"]
            square = np.zeros((p, p))
            square[np.triu_indices(p)] = r["products"]
            square = square + np.triu(square, 1).T
            covariance = square / n - np.outer(mean, mean)
        else:
            mean, covariance = np.array(r["median"]), np.diag((1.4826 * np.array(r["deviation"])) ** 2)
        means.append(mean.tolist())
        precisions.append(_precision(covariance, floors).ravel().tolist())
    doubles = pa.list_(pa.float64())
    return pa.table(
        {"lang": table.column("lang"), "source": table.column("source"), "mean": pa.array(means, doubles), "precision": pa.array(precisions, doubles)}
    )


MODEL_DDL = "lang string, source string, mean array<double>, precision array<double>"


def _attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Null-safe join of rows with their group's columns; Spark picks the way by the size of ``groups``."""
    g = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = rows["lang"].eqNullSafe(g["_lang"]) & rows["source"].eqNullSafe(g["_source"])
    return rows.join(g, on).drop("_lang", "_source")


def estimates(
    vectors: DataFrame, floors: tuple[float, ...] = FLOORS, share: float = SHARE, steps: int = STEPS
) -> DataFrame:
    """(lang, source, mean, precision): the concentrated estimate of every group of ``vectors`` (lang, source, x0, ...).

    The covariance is scaled so that the group's median distance is that of a normal sample.
    Quantiles are sketches of accuracy 1 / 10000; null languages and sources are groups like others.
    """
    x = [f"x{i}" for i in range(len(floors))]
    low = np.array(floors)
    keys = ["lang", "source"]
    middle = lambda columns: F.array(*(F.percentile_approx(c, 0.5, 10_000) for c in columns))
    modelled = lambda table, from_sums: stage(
        table.mapInArrow(lambda b: _in_batches(b, low, from_sums), MODEL_DDL), "estimates"
    )
    medians = stage(vectors.groupBy(*keys).agg(middle(x).alias("median")), "medians")
    away = _attach(vectors, medians).select(
        *keys, "median", *(F.abs(F.col(c) - F.element_at("median", i + 1)).alias(c) for i, c in enumerate(x))
    )
    models = modelled(away.groupBy(*keys, "median").agg(middle(x).alias("deviation")), False)
    for _ in range(steps):
        placed = _attach(vectors, models).select(*keys, *x, _distance(x).alias("d"))
        inner = stage(placed.groupBy(*keys).agg(F.percentile_approx("d", share, 10_000).alias("most")), "cutoffs")
        close = _attach(placed, inner).filter("d <= most")
        sums = close.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.array(*(F.sum(c) for c in x)).alias("sums"),
            F.array(*(F.sum(F.col(x[i]) * F.col(x[j])) for i in range(len(x)) for j in range(i, len(x)))).alias("products"),
        )
        models = modelled(sums, True)
    placed = _attach(vectors, models).select(*keys, _distance(x).alias("d"))
    scale = placed.groupBy(*keys).agg(F.percentile_approx("d", 0.5, 10_000).alias("half"))
    normal = _chi_square_median(len(x))
    # never narrower than the floors ask for
    factor = F.greatest(F.col("half") / normal, F.lit(1.0))
    scaled = _attach(models, scale)
    return scaled.withColumn("precision", F.transform("precision", lambda v: v / factor)).drop("half")


def _chi_square_median(p: int) -> float:
    return p * (1 - 2 / (9 * p)) ** 3


def _in_batches(batches: Iterator[pa.RecordBatch], floors: np.ndarray, from_sums: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _models(pa.Table.from_batches([batch]), floors, from_sums).to_batches()


def quality(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Counts, base_failed, distance and kept of every row of (doc_id, text, lang, source).

    A row is kept if it passes the base rules and its squared Mahalanobis distance from its group's
    estimate is at most ``cutoff``.  Rows failing the base rules take no part in the estimates, which
    all others do.  Groups of fewer than ``least_rows`` such rows use the estimate over all rows, so
    do null and rare sources; with fewer in all, every row that passes the base rules is kept.
    Repeated rows count each; further columns are ignored.
    """
    counts = stage(
        statistics(docs).withColumn("base_failed", base_failed()).withColumns(dict(zip(DIMENSIONS, transformed()))), "statistics"
    )
    good = counts.filter("not base_failed").select("lang", "source", *DIMENSIONS)
    large = stage(good.groupBy("lang", "source").count().filter(F.col("count") >= least_rows).drop("count"), "groups")
    own = estimates(_attach(good, large))
    # written, so that the joins below see columns and not constants
    all_rows = stage(good.withColumns({"lang": F.lit("all"), "source": F.lit("all")}), "all-rows")
    pooled = estimates(all_rows).first() if all_rows.count() >= least_rows else None
    g = own.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = counts["lang"].eqNullSafe(g["_lang"]) & counts["source"].eqNullSafe(g["_source"])
    rows = counts.join(g, on, "left")
    if pooled is not None:
        literal = lambda values: F.array(*(F.lit(float(v)) for v in values))
        rows = rows.withColumns({c: F.coalesce(c, literal(pooled[c])) for c in ("mean", "precision")})
    rows = rows.withColumn("distance", F.coalesce(_distance(list(DIMENSIONS)), F.lit(0.0)))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"),
    )
