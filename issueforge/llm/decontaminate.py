"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

A window of a document has as many five-word shingles as a benchmark item.  Its SimHash is looked up
in a multi-index over the items' fingerprints: with BLOCKS blocks of bits and a radius below twice
that number, some block differs in one bit at most, so an index of every item's block values and
their one-bit neighbours finds all items within the radius.  Found pairs are verified by the exact
similarity of their weighted shingles (weights are counts).

A window that reaches the similarity holds at least that share of the item's shingles.  Windows are
therefore fingerprinted only where that many shingles of items of their size lie close enough
together, which loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.llm.stages import stage, with_ids

WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 12
BROADCAST_ROWS = 200_000  # narrow rows, counted before a broadcast


def words(column: str = "text") -> Column:
    """Letters and digits of a text, lower-cased, as an array of words."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles(column: str = "w") -> Column:
    """64-bit hashes of all runs of WORDS words; none for shorter texts."""
    parts = ", ".join(f"{column}[i + {k}]" for k in range(WORDS))
    return F.expr(
        f"if(size({column}) >= {WORDS}, transform(sequence(0, size({column}) - {WORDS}), i -> xxhash64({parts})), cast(array() as array<bigint>))"
    )


def simhash(column: str) -> Column:
    """Bit b is set if it is set in over half of the hashes."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * aggregate({column}, 0, (n, h) -> n + cast((shiftrightunsigned(h, b) & 1L) as int)) "
        f"> size({column}), shiftleft(1L, b), 0L))"
    )


def _block_bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def block_keys(fp: str = "fp", neighbours: bool = False, blocks: int = BLOCKS) -> Column:
    """Array of (block number, value) structs; with all values one bit away if asked for."""
    parts = []
    for n, (a, b) in enumerate(_block_bounds(blocks)):
        value = f"shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L"
        masks = [0, *(1 << k for k in range(b - a))] if neighbours else [0]
        parts += [f"named_struct('block', {n}, 'value', ({value}) ^ {m}L)" for m in masks]
    return F.expr(f"array({', '.join(parts)})")


def _by_size(facts: DataFrame, small: DataFrame, on, rows: int) -> DataFrame:
    """Inner join; ``small`` is broadcast only if its counted rows are few."""
    return facts.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on)


def overlap(a: str, b: str) -> Column:
    """Sum over shingles of the smaller of its two counts."""
    return F.expr(
        f"aggregate(array_distinct({a}), 0, (n, h) -> n + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))"
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """(doc_id, item_id, start, n_shingles, distance, similarity) of the best window of each leaked item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  ``start`` is the window's first
    word.  At a document's end windows may be shorter than the item.  Of equally similar windows the
    first counts.  Null texts, texts of fewer than five words and null ids cannot match.  Repeated
    rows of a document give one result; further columns are ignored.
    """
    if radius >= 2 * blocks:
        raise ValueError("the index finds radii below twice the number of blocks only")
    own = benchmark.select("item_id", words().alias("w")).select("item_id", shingles().alias("s"))
    own = stage(own, "item-words").filter("item_id is not null and size(s) > 0")
    items = stage(own.select("item_id", "s", F.size("s").alias("n"), simhash("s").alias("fp")), "items")
    marks = stage(items.select("n", F.explode("s").alias("h")).distinct(), "item-shingles")

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter("doc_id is not null and text is not null")
    hashed = texts.select("doc_id", words().alias("w")).select("doc_id", shingles().alias("s"))
    # the outer form infers no filter on the array, which would be computed a second time below
    at = hashed.select("doc_id", F.posexplode_outer("s").alias("pos", "h"))
    met = _by_size(at, marks, "h", marks.count())
    # starts of windows that hold enough shingles of items of their size
    near = met.groupBy("doc_id", "n").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    near = near.withColumn("need", F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int")).filter("size(p) >= need")
    starts = F.expr(
        "array_distinct(flatten(transform(filter(sequence(0, size(p) - need), j -> p[j + need - 1] - p[j] < n), "
        "j -> sequence(greatest(p[j + need - 1] - n + 1, 0), p[j]))))"
    )
    asked = near.select("doc_id", "n", starts.alias("starts")).filter("size(starts) > 0")
    asked = stage(asked.groupBy("doc_id").agg(F.collect_list(F.struct("n", "starts")).alias("asked")), "windows")
    again = _by_size(texts, asked, "doc_id", asked.count())
    again = again.select("doc_id", "asked", words().alias("w")).select("doc_id", "asked", shingles().alias("s"))
    per_size = again.select("doc_id", "s", F.explode_outer("asked").alias("a"))
    windows = per_size.select("doc_id", "s", F.col("a.n").alias("n"), F.explode_outer("a.starts").alias("start"))
    windows = windows.filter("start < size(s)").select("doc_id", "n", "start", F.expr("slice(s, start + 1, n)").alias("window"))
    windows = stage(windows.withColumn("fp", simhash("window")), "fingerprints")

    index = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.explode(block_keys("fp", True, blocks)).alias("k"))
    index = stage(index.select("item_id", "n", "item_fp", "k.*"), "index")
    probes = windows.select("doc_id", "n", "start", "fp", F.explode(block_keys("fp", False, blocks)).alias("k")).select("*", "k.*").drop("k")
    pairs = _by_size(probes, index, ["n", "block", "value"], index.count())
    pairs = pairs.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("distance") <= radius)
    pairs = pairs.select("doc_id", "n", "start", "fp", "item_id", "distance").distinct()
    full = pairs.join(windows.select("doc_id", "n", "start", "fp", "window").distinct(), ["doc_id", "n", "start", "fp"])
    full = _by_size(full, items.select("item_id", "s"), "item_id", items.count())
    shared = full.withColumn("both", overlap("window", "s"))
    value = F.col("both") / (F.size("window") + F.size("s") - F.col("both"))
    sure = shared.withColumn("similarity", value).filter(F.col("similarity") >= similarity - 1e-9)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance"), "n"))
    return (
        sure.groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select(
            "doc_id",
            "item_id",
            (-F.col("b.start")).alias("start"),
            F.col("b.n").alias("n_shingles"),
            (-F.col("b.distance")).alias("distance"),
            F.col("b.similarity").alias("similarity"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id has no leak; rows with a null id stay."""
    return with_ids(docs, leaks(docs, benchmark, **options).select("doc_id"), "left_anti")
