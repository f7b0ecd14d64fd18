"""Hierarchical Pitman-Yor language model over words with word contexts.

A word is predicted from the word before it: each such word is a restaurant, and so is the start of a
text.  It backs off to the restaurant of its class: start of text, after a sentence end, after other
punctuation, or the length of a plain word.  The three boundary classes share one parent restaurant
and the five plain ones another, and both share the root, whose base is uniform over the V training
words and one unknown word.  Events are those of the add-one base score, so perplexities compare.

Chinese-restaurant seating is sampled by Gibbs sweeps: within a sweep the customers of every word are
seated anew given the restaurants' table totals, so Spark seats all words in parallel.  Word contexts
are seated anew after each burn-in sweep: the pairs of a context and a word are joined with the
context's tables and the word's probabilities in the class; a pair met once has one table whatever is
drawn.  Predictive probabilities are averaged over the kept sweeps of the upper levels.

The probability of a word is that of its class, times the back-off weight of its context, times one
plus the share of its own customers.  So a text's score is a sum over words and a sum over the pairs
that training met.  Only the FREQUENT most frequent words and pairs are collected and broadcast, a
fixed bound; all others of a text are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.llm.textvec import Words, _mixed, scan, slices
from issueforge.llm.stages import stage

PARENT = np.array([0, 0, 0, 1, 1, 1, 1, 1])  # of each context class
CONTEXTS = len(PARENT)
SWEEPS, BURN_IN, ROUNDS = 5, 2, 2
STRENGTH = 1.0
FREQUENT = 1 << 17
SLICE = 4 << 20


def contexts(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Context class of every word, and of the end token of every text."""
    size = found.end - found.start
    last = found.data[found.end - 1] if len(size) else np.zeros(0, np.uint8)
    plain = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57))
    own = 3 + np.searchsorted([3, 4, 6, 9], size, side="right")
    own = np.where(plain, own, np.where(np.isin(last, [33, 46, 63]), 1, 2))
    before = np.zeros(len(size), dtype=np.int64)
    before[1:] = own[:-1]
    counts = found.counts()
    ends = np.cumsum(counts)
    some = counts > 0
    before[(ends - counts)[some]] = 0
    closing = np.zeros(len(counts), dtype=np.int64)
    closing[some] = own[ends[some] - 1]
    return before, closing


# seating


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = _mixed(seed + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(customers, base, tables, strength: float, discount: float, seed) -> np.ndarray:
    """Tables of each dish after seating its customers one after another.

    A customer opens a table with probability proportional to (strength + discount * tables) * base.
    ``tables`` is the restaurant's total.  Draws are a function of ``seed`` alone, so a lost task is
    repeated exactly.  Once 64 customers sit, the next are drawn in blocks of 1/32 of those seated.
    """
    customers = np.asarray(customers, dtype=np.int64)
    shape = customers.shape
    new = np.broadcast_to((strength + discount * np.asarray(tables)) * base, shape).ravel()
    customers, seed = customers.ravel(), np.broadcast_to(seed, shape).ravel()
    seated, got = np.minimum(customers, 1), np.minimum(customers, 1).astype(np.float64)
    active, step = np.flatnonzero(customers > 1), 0
    while len(active):
        n, t = seated[active], got[active]
        block = np.minimum(np.maximum(1, n >> 5), customers[active] - n)
        chance = new[active] / (n - discount * t + new[active])
        got[active] = t + np.minimum(block, np.floor(block * chance + _uniform(seed[active], step)))
        seated[active] = n + block
        active = active[seated[active] < customers[active]]
        step += 1
    return got.astype(np.int64).reshape(shape)


def discount_of(ones: float, twos: float) -> float:
    """Discount from the numbers of dishes with one and with two customers."""
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


# words and pairs


START = np.uint64(1)  # context of a text's first token; the end token has the hash 0


def _tokens(found: Words, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, class of the context, row) of all tokens: the words in order, then the end of every text."""
    before, closing = contexts(found)
    counts = found.counts()
    ends = np.cumsum(counts)
    some = counts > 0
    context = np.zeros(len(own), dtype=np.uint64)
    context[1:] = own[:-1]
    context[(ends - counts)[some]] = START
    last = np.full(len(counts), START)
    last[some] = own[ends[some] - 1]
    return (
        np.concatenate([context, last]),
        np.concatenate([own, np.zeros(len(counts), dtype=np.uint64)]),
        np.concatenate([before, closing]),
        np.concatenate([found.doc, np.arange(len(counts))]),
    )


def pair_hashes(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(context * np.uint64(0x9E3779B97F4A7C15) + _mixed(word + START))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            found = scan(part.column("text"))
            context, word, kind, _ = _tokens(found, found.hashes())
            _, first, times = np.unique(pair_hashes(context, word), return_index=True, return_counts=True)
            columns = [context[first].view(np.int64), word[first].view(np.int64), kind[first].astype(np.int32), times.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["context", "hash", "class", "c"])


@dataclass
class Totals:
    """Tables in all restaurants of a level: per context, per parent, and of the root."""

    leaf: np.ndarray
    mid: np.ndarray
    root: int


def _by_parent(t: np.ndarray) -> np.ndarray:
    return np.stack([t[..., PARENT == p].sum(axis=-1) for p in (0, 1)], axis=-1)


class Restaurants:
    """Seating of words given the sizes of a corpus; all arrays have a row per word."""

    def __init__(self, customers: np.ndarray, distinct: int, discount: float):
        self.customers, self.uniform, self.discount = customers, 1.0 / (distinct + 1), discount

    def seated(self, c: np.ndarray, totals: Totals, seed: np.ndarray):
        """Tables (leaf, mid, root) of each word after Gibbs rounds given the totals."""
        d, n = self.discount, max(int(self.customers.sum()), 1)
        root_p = mid_p = (c.sum(axis=1, keepdims=True) + 0.5) / (n + 1.0)
        mid_p = np.repeat(mid_p, 2, axis=1)
        one = np.uint64(1)
        with np.errstate(over="ignore"):
            seeds = _mixed(seed[:, None] + np.arange(11, dtype=np.uint64)[None, :] + one)
        for _ in range(ROUNDS):
            leaf = seat(c, mid_p[:, PARENT], totals.leaf, STRENGTH, d, seeds[:, :CONTEXTS])
            c_mid = _by_parent(leaf)
            mid = seat(c_mid, np.repeat(root_p, 2, axis=1), totals.mid, STRENGTH, d, seeds[:, CONTEXTS : CONTEXTS + 2])
            c_root = mid.sum(axis=1, keepdims=True)
            root = seat(c_root, self.uniform, totals.root, STRENGTH, d, seeds[:, CONTEXTS + 2 :])
            root_p, mid_p, _ = self.predict(c, leaf, mid, root, totals)
            seeds = _mixed(seeds)
        return leaf, mid, root

    def predict(self, c, leaf, mid, root, totals: Totals):
        """Predictive probabilities of each word: root, parents, contexts."""
        d = self.discount
        c_mid, c_root = _by_parent(leaf), mid.sum(axis=1, keepdims=True)
        root_p = (c_root - d * root + (STRENGTH + d * totals.root) * self.uniform) / (STRENGTH + totals.mid.sum())
        mid_p = (c_mid - d * mid + (STRENGTH + d * totals.mid) * root_p) / (STRENGTH + _by_parent(totals.leaf))
        leaf_p = (c - d * leaf + (STRENGTH + d * totals.leaf) * mid_p[:, PARENT]) / (STRENGTH + self.customers)
        return root_p, mid_p, leaf_p


@dataclass
class Model:
    """A fitted model, log10 throughout.

    ``words``: (hash, c, lp by class, weight as a context) of all training words; ``pairs``: (hash, gain)
    of all training pairs; ``unknown``: of an unseen word by class; ``start``: weight of the start of a text.
    """

    words: DataFrame
    pairs: DataFrame
    tokens: int
    distinct: int
    unknown: np.ndarray
    start: float


def _seed(hashes: np.ndarray, sweep: int) -> np.ndarray:
    return _mixed(hashes ^ np.uint64((sweep + 1) << 50))


NAMES = [f"c{i}" for i in range(CONTEXTS)]  # customers of a word by class


def _counts_of(batch) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([np.asarray(batch.column(c)) for c in NAMES], axis=1), np.asarray(batch.column("hash")).view(np.uint64)


def _opened(words: DataFrame) -> tuple[Restaurants, Totals]:
    """Restaurants of the classes and above for the customers in ``words``, one table a dish."""
    some = lambda expression: F.count_if(F.expr(expression))
    parents = [" + ".join(NAMES[i] for i in range(CONTEXTS) if PARENT[i] == p) for p in (0, 1)]
    first = words.agg(
        F.count("*"),
        *(F.coalesce(F.sum(c), F.lit(0)) for c in NAMES),
        *(some(f"{c} > 0") for c in NAMES),
        *(some(f"{p} > 0") for p in parents),
        sum((some(f"{c} = 1") for c in NAMES), F.lit(0)),
        sum((some(f"{c} = 2") for c in NAMES), F.lit(0)),
    ).first()
    at = 1 + CONTEXTS
    totals = Totals(np.array(first[at : at + CONTEXTS]), np.array(first[at + CONTEXTS : at + CONTEXTS + 2]), first[0])
    return Restaurants(np.array(first[1:at], dtype=np.int64), first[0], discount_of(first[-2], first[-1])), totals


def _swept(words: DataFrame, rooms: Restaurants, sweep: int, before: Totals) -> Totals:
    names = [f"t{i}" for i in range(CONTEXTS + 3)]

    def run(batches):
        for batch in batches:
            c, hashes = _counts_of(batch)
            leaf, mid, root = rooms.seated(c, before, _seed(hashes, sweep))
            sums = np.concatenate([leaf.sum(axis=0), mid.sum(axis=0), root.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], names)

    got = words.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    t = got.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()
    return Totals(np.array(t[:CONTEXTS]), np.array(t[CONTEXTS : CONTEXTS + 2]), t[-1])


def _averaged(rooms: Restaurants, kept: list, c: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
    """log10 probability of words in each class, averaged over sweeps (sweep, totals before, totals after)."""
    each = []
    for sweep, before, after in kept:
        if hashes is None:
            tables = np.zeros((1, CONTEXTS)), np.zeros((1, 2)), np.zeros((1, 1))
        else:
            tables = rooms.seated(c, before, _seed(hashes, sweep))
        each.append(rooms.predict(c, *tables, after)[2])
    return np.log10(np.mean(each, axis=0))


def _predicted(words: DataFrame, rooms: Restaurants, kept: list) -> DataFrame:
    """(hash, c, lp) of all words."""

    def run(batches):
        for batch in batches:
            c, hashes = _counts_of(batch)
            lp = _averaged(rooms, kept, c, hashes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * CONTEXTS, pa.int32()), pa.array(lp.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("c"), lists], ["hash", "c", "lp"])

    return words.mapInArrow(run, "hash bigint, c bigint, lp array<double>")


def _around(pairs: DataFrame, predicted: DataFrame, rooms: DataFrame) -> DataFrame:
    """Pairs with the tables of their context (``total``) and the word's log10 probability in its class (``lp``)."""
    joined = pairs.join(predicted.select("hash", F.col("lp").alias("_lp")), "hash")
    joined = joined.select(*pairs.columns, F.element_at("_lp", F.col("class") + 1).alias("lp"))
    return joined.join(rooms.select("context", "total"), "context")


def _seated_pairs(pairs: DataFrame, discount: float, sweep: int) -> DataFrame:
    """Pairs seated in their word contexts: tables ``t`` of each."""

    def run(batches):
        for batch in batches:
            context, word, kind, c, lp, total = (np.asarray(batch.column(x)) for x in ("context", "hash", "class", "c", "lp", "total"))
            seeds = _seed(pair_hashes(context.view(np.uint64), word.view(np.uint64)), sweep)
            t = seat(c, 10.0**lp, total, STRENGTH, discount, seeds)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (context, word, kind, c, t))], ["context", "hash", "class", "c", "t"])

    return pairs.mapInArrow(run, "context bigint, hash bigint, class int, c bigint, t bigint")


def _gains(pairs: DataFrame, discount: float) -> DataFrame:
    """(hash, gain): how much a pair's own customers raise the log10 probability above the back-off."""

    def run(batches):
        for batch in batches:
            context, word, c, t, lp, total = (np.asarray(batch.column(x)) for x in ("context", "hash", "c", "t", "lp", "total"))
            gain = np.log10(1.0 + (c - discount * t) / ((STRENGTH + discount * total) * 10.0**lp))
            hashes = pair_hashes(context.view(np.uint64), word.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column("c"), pa.array(gain)], ["hash", "c", "gain"])

    return pairs.mapInArrow(run, "hash bigint, c bigint, gain double")


def fit(train: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> Model:
    """Fits the model to the texts of ``train`` (text); every text ends with one end token.

    Words are maximal runs without ASCII white space, A-Z lower-cased; null is an empty text.  Word
    contexts are seated anew ``burn_in`` times, with one table a pair before.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("some sweeps must be kept")
    found = train.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _count_pairs, "context bigint, hash bigint, class int, c bigint"
    )
    pairs = stage(found.groupBy("context", "hash").agg(F.min("class").alias("class"), F.sum("c").alias("c")), "pairs")
    ones, twos = pairs.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = discount_of(ones, twos)
    # one table a pair: a word's customers in a class are its contexts there
    by_class = [F.count_if(F.col("class") == i).alias(c) for i, c in enumerate(NAMES)]
    words = first_words = stage(pairs.groupBy("hash").agg(F.sum("c").alias("c"), *by_class), "words")
    in_rooms = first_rooms = stage(pairs.groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("total")), "contexts")
    once, often = pairs.filter("c = 1").withColumn("t", F.lit(1).cast("long")), pairs.filter("c > 1")
    seated = pairs.withColumn("t", F.lit(1).cast("long"))
    rooms, totals = _opened(words)
    kept = []
    for sweep in range(sweeps):
        if 0 < sweep <= burn_in:
            predicted = _predicted(words, rooms, [(sweep - 1, *last)])
            drawn = stage(_seated_pairs(_around(often, predicted, in_rooms), discount, sweep), "seated-pairs")
            seated = once.unionByName(drawn)
            more, extra = drawn.filter("t > 1"), F.col("t") - 1
            by_word = more.groupBy("hash").agg(*(F.sum(F.when(F.col("class") == i, extra).otherwise(0)).alias(f"x{i}") for i in range(CONTEXTS)))
            added = [(F.col(c) + F.coalesce(f"x{i}", F.lit(0))).alias(c) for i, c in enumerate(NAMES)]
            words = stage(first_words.join(by_word, "hash", "left").select("hash", "c", *added), "words")
            by_room = more.groupBy("context").agg(F.sum(extra).alias("x"))
            total = (F.col("total") + F.coalesce("x", F.lit(0))).alias("total")
            in_rooms = stage(first_rooms.join(by_room, "context", "left").select("context", "n", total), "contexts")
            rooms, _ = _opened(words)
        last = totals, _swept(words, rooms, sweep, totals)
        if sweep >= burn_in:
            kept.append((sweep, *last))
        totals = last[1]

    predicted = stage(_predicted(words, rooms, kept), "predicted-words")
    strength, d = F.lit(STRENGTH), F.lit(discount)
    weights = in_rooms.select("context", F.log10((strength + d * F.col("total")) / (strength + F.col("n"))).alias("weight"))
    own = predicted.join(weights, predicted["hash"] == weights["context"], "left")
    table = stage(own.select("hash", "c", "lp", F.coalesce("weight", F.lit(0.0)).alias("weight")), "scored-words")
    gains = stage(_gains(_around(seated, predicted, in_rooms), discount), "scored-pairs")
    start = weights.filter(F.col("context") == int(START)).first()
    size = first_words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Model(table, gains, *size, _averaged(rooms, kept, np.zeros((1, CONTEXTS)), None)[0], start["weight"] if start else 0.0)


def _top(model: Model, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, c, lp, weight) of the most frequent words, by hash."""
    top = model.words.orderBy(F.desc("c"), "hash").limit(frequent).toArrow().combine_chunks()
    hashes = np.asarray(top.column("hash")).view(np.uint64)
    lists = top.column("lp").combine_chunks()
    values = np.asarray(lists.flatten() if len(lists) else pa.array([], pa.float64())).reshape(-1, CONTEXTS)
    order = np.argsort(hashes)
    return hashes[order], np.asarray(top.column("c"))[order], values[order], np.asarray(top.column("weight"))[order]


def _top_pairs(model: Model, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, gain) of the most frequent pairs, by hash."""
    top = model.pairs.orderBy(F.desc("c"), "hash").limit(frequent).select("hash", "gain").toArrow()
    hashes = np.asarray(top.column("hash")).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.asarray(top.column("gain"))[order]


def _found(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in a sorted array, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), max(len(sorted_hashes) - 1, 0))
    return at, sorted_hashes[at] == wanted if len(sorted_hashes) else np.zeros(len(wanted), bool)


def score(docs: DataFrame, model: Model, frequent: int = FREQUENT) -> DataFrame:
    """n_tokens, n_known, base (sum of log10(c + 1)) and score of (doc_id, held_out, text) rows.

    The ``frequent`` most frequent words and pairs are broadcast; the others of a text go through one
    join with the model's.  Repeated rows are scored each; null text is empty.
    """
    known = docs.sparkSession.sparkContext.broadcast((_top(model, frequent), _top_pairs(model, frequent)))
    unknown, start = model.unknown, model.start
    ddl = (
        "kind int, hash bigint, key bigint, doc_id bigint, held_out boolean, rows bigint, n_tokens bigint, context int, "
        "n_known bigint, base double, score double"
    )
    schema = pa.schema(
        [(n, {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}.get(t, pa.int64())) for n, t in (x.split() for x in ddl.split(", "))]
    )

    def of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def run(batches):
        (top_hash, top_c, top_lp, weight), (pair_hash, pair_gain) = known.value
        top_lp = top_lp + weight[:, None]  # every word but the end token is the next one's context
        end = np.searchsorted(top_hash, np.uint64(0))
        end_known = end < len(top_hash) and top_hash[end] == 0
        end_c, end_lp = (top_c[end], top_lp[end]) if end_known else (0, unknown)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                found = scan(part.column("text"))
                own = found.hashes()
                context, token, kinds, row = _tokens(found, own)
                before, closing = kinds[: len(own)], kinds[len(own) :]
                unique, place = np.unique(own, return_inverse=True)
                at, is_top = _found(top_hash, unique)
                common = is_top[place]
                which, doc = at[place[common]], found.doc[common]
                counts = found.counts()
                base = np.bincount(doc, np.log10(top_c[which] + 1.0), n) + np.log10(end_c + 1.0)
                total = np.bincount(doc, top_lp[which, before[common]], n) + end_lp[closing] + start
                pairs, pair_place = np.unique(pair_hashes(context, token), return_inverse=True)
                pair_at, is_often = _found(pair_hash, pairs)
                often = is_often[pair_place]
                total += np.bincount(row[often], pair_gain[pair_at[pair_place[often]]], n)
                n_known = np.bincount(doc, minlength=n) + int(end_known)
                with np.errstate(over="ignore"):
                    ids = np.asarray(part.column("doc_id").fill_null(-(1 << 62))).astype(np.uint64)
                    spot = np.arange(len(own), dtype=np.uint64) - (np.cumsum(counts) - counts)[found.doc].astype(np.uint64)
                    sums = np.zeros(n, dtype=np.uint64)
                    np.add.at(sums, found.doc, _mixed(own + spot))
                    key = _mixed(sums ^ _mixed(ids + counts.astype(np.uint64))).view(np.int64)
                yield of(
                    n, kind=np.zeros(n, np.int32), hash=key, key=key, doc_id=part.column("doc_id"), held_out=part.column("held_out"),
                    rows=np.ones(n, np.int64), n_tokens=counts + 1, n_known=n_known, base=base, score=total,
                )
                word, doc, context = place[~common], found.doc[~common], before[~common]
                if len(word):
                    m = len(unique)
                    groups, times = np.unique((doc.astype(np.int64) * CONTEXTS + context) * m + word, return_counts=True)
                    doc, context, word = groups // m // CONTEXTS, groups // m % CONTEXTS, groups % m
                    yield of(
                        len(word), kind=np.ones(len(word), np.int32), hash=unique[word].view(np.int64), key=key[doc],
                        context=context.astype(np.int32), n_known=times.astype(np.int64),
                    )
                if not often.all():
                    m = len(pairs)
                    groups, times = np.unique(row[~often].astype(np.int64) * m + pair_place[~often], return_counts=True)
                    yield of(
                        len(groups), kind=np.full(len(groups), 2, np.int32), hash=pairs[groups % m].view(np.int64), key=key[groups // m],
                        n_known=times.astype(np.int64),
                    )

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(run, ddl)
    own = F.transform("lp", lambda x: x + F.col("weight")).alias("lp")
    words = model.words.select(F.lit(1).alias("kind"), "hash", "c", own, F.lit(None).cast("double").alias("gain"))
    pairs = model.pairs.select(F.lit(2).alias("kind"), "hash", F.lit(None).cast("long").alias("c"), F.lit(None).cast("array<double>").alias("lp"), "gain")
    joined = rows.join(words.unionByName(pairs), ["kind", "hash"], "left")
    times, rare, pair = F.col("n_known"), F.col("kind") == 1, F.col("kind") == 2
    none = F.array(*(F.lit(float(x)) for x in unknown))
    lp = F.element_at(F.coalesce("lp", none), F.col("context") + 1)
    per_text = joined.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"),
        F.min("held_out").alias("held_out"),
        F.sum("rows").alias("rows"),
        F.min("n_tokens").alias("n_tokens"),
        F.sum(F.when(F.expr("kind = 0 or c > 0"), times)).alias("n_known"),
        F.sum(F.when(rare, times * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(rare, times * lp).when(pair, times * F.coalesce("gain", F.lit(0.0))).otherwise(F.col("score"))).alias("score"),
    )
    # rows equal in id and text were summed: each gets its share back
    each = per_text.withColumn("copy", F.explode(F.expr("array_repeat(0, cast(rows as int))")))
    return each.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.expr("n_known div rows").alias("n_known"),
        (F.col("base") / F.col("rows")).alias("base"),
        (F.col("score") / F.col("rows")).alias("score"),
    )


def held_out(column: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of the id as text modulo ``folds``; a null id is not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_model_scores(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, frequent: int = FREQUENT) -> DataFrame:
    """Trains on the rows that are not held out and scores all rows of (doc_id, text).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score.
    No training rows: every word is unseen and the character model uniform.  Repeated rows count each.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out())
    model = fit(rows.filter(~F.col("held_out")), sweeps, burn_in)
    denominator = float(np.log10(model.tokens + model.distinct + 1))
    return score(rows, model, frequent).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        "score",
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of the model and of the base, by held_out."""
    value = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(value("score").alias("perplexity"), value("base_score").alias("base_perplexity"))
