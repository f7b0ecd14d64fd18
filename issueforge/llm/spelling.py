"""Spelling variants: words one edit apart, found by permuterm rotations, and their most frequent forms.

Every word w gets the terminator ``$`` and its rotations ``w[i:] $ w[:i]``.  Two words differ by
one replaced code point at i exactly when their rotations starting after i agree once the last
character (the edited one) is skipped: the key ``w[i+1:] $ w[:i]``.  A word one code point
shorter, v, is a deletion of w at i exactly when v's full rotation ``v[i:] $ v[:i]`` equals that
key.  So replacements and indels become equal keys ("prefix ranges skipping the edited
character"); Spark groups each key, which is the scan of one range of the sorted rotations, and
emits each word's neighbours from its groups.

A key's group holds words that differ only in the skipped code point, one of the 90 letters of
the run class, plus at most one shorter word, whose rotation fixes it: a group never has more
than 91 members, whatever the corpus.  A hot word adds rows in proportion to its length only.
No pair table is written: per group, each member gets the number of its neighbours and the best
of them, and these are summed and minimised per word.

All of it is native Spark SQL; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.llm.stages import stage

# Fixed values of the contract: the run class, lower-casing of A-Z only, the deletion rule's modulus,
# the shortest word, the least count, and the ratio a form must reach.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MODULUS = 31
SHORTEST = 7
LEAST = 2
RATIO = 10


def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the distinct altered runs of all texts, at least ``shortest`` code points long, met ``least`` times or more.

    A run is lower-cased in A-Z only; h is the unsigned crc32 of the UTF-8 of ``<doc_id>:<run>``;
    where ``MODULUS`` divides h the code point ``h % length`` (from 0) is deleted.  A null text has
    no runs; a null doc_id is written as the empty string.  Runs shorter than ``shortest`` are
    dropped before hashing, as a deletion only shortens them.  Repeated rows count again.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), 0)).alias("_r"),
    )
    runs = runs.filter(F.length("_r") >= shortest).select("_d", F.translate("_r", UPPER, LOWER).alias("_r"))
    h = F.crc32(F.encode(F.concat("_d", F.lit(":"), "_r"), "UTF-8"))
    cut = (h % F.length("_r")).cast("int")
    # substring by column positions: before the deleted code point, and after it
    word = F.when(h % MODULUS == 0, F.concat(F.expr("substring(_r, 1, _k)"), F.expr("substring(_r, _k + 2)"))).otherwise(F.col("_r"))
    altered = runs.withColumn("_k", cut).select(word.alias("word"))
    counted = altered.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def _keys(vocabulary: DataFrame) -> DataFrame:
    """(key, kind, word, n, start): a K row per code point (rotation after it, the point skipped), an R row per rotation.

    ``start`` marks a K row whose skipped point begins a run of equal points; a deletion is counted
    only there, so a word and its shorter neighbour meet in exactly one group.
    """
    at = F.col("_i")
    deleted = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("_i")).select(
        F.concat(F.expr("substring(word, _i + 2)"), F.lit("$"), F.expr("substring(word, 1, _i)")).alias("key"),
        F.lit("K").alias("kind"),
        "word",
        "n",
        ((at == 0) | (F.expr("substring(word, _i + 1, 1)") != F.expr("substring(word, _i, 1)"))).alias("start"),
    )
    rotated = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("_i")).select(
        F.concat(F.expr("substring(word, _i + 1)"), F.lit("$"), F.expr("substring(word, 1, _i)")).alias("key"),
        F.lit("R").alias("kind"),
        "word",
        "n",
        F.lit(False).alias("start"),
    )
    return deleted.unionByName(rotated)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best): per word of ``vocabulary`` (word, n), its count of words one edit away and the best of them.

    ``best`` is the struct (neg, word) of least value over the neighbours, i.e. largest n, then the
    smallest word in code-point order (UTF-8 byte order is code-point order); null without any.
    """
    members = _keys(vocabulary).groupBy("key").agg(F.collect_list(F.struct("kind", "word", "n", "start")).alias("g"))
    one = members.select("g", F.explode("g").alias("m"))
    related = F.filter(
        "g",
        lambda x: (x["word"] != F.col("m.word"))
        & (
            ((x["kind"] == "K") & (F.col("m.kind") == "K"))
            | ((x["kind"] == "K") & x["start"] & (F.col("m.kind") == "R"))
            | ((x["kind"] == "R") & (F.col("m.kind") == "K") & F.col("m.start"))
        ),
    )
    per = one.select(
        F.col("m.word").alias("word"),
        F.col("m.n").alias("n"),
        F.size(related).alias("near"),
        F.array_min(F.transform(related, lambda x: F.struct((-x["n"]).alias("neg"), x["word"].alias("word")))).alias("best"),
    )
    return per.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last by pointer doubling; forms grow n tenfold a step, so chains are short.

    Each round is written to the shared folder; the driver sees one count a round.
    """
    links = stage(forms.select("word", F.coalesce("form", "word").alias("to")), "roots")
    while True:
        hop = links.alias("a").join(links.alias("b"), F.col("a.to") == F.col("b.word"), "left")
        nxt = hop.select(F.col("a.word").alias("word"), F.coalesce(F.col("b.to"), F.col("a.to")).alias("to"), (F.col("b.to") != F.col("a.to")).alias("_moved"))
        nxt = stage(nxt, "roots")
        if nxt.filter("_moved").limit(1).count() == 0:
            return nxt.select("word", F.col("to").alias("root"))
        links = nxt.drop("_moved")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, form, root (string); n, n_near, form_n (long): one row per word of :func:`words`.

    A word's form is its neighbour (one inserted, deleted or replaced code point) of largest n,
    ties to the smallest in code-point order, if that n is at least ``ratio`` times the word's n;
    else null, and form_n null.  root follows forms to the last (the word itself without a form).
    n_near is 0 without neighbours.  Nulls, empty texts and tables give no rows (an empty table, an
    empty result); only doc_id and text are read, so other columns of any name are ignored.
    """
    found = neighbours(stage(words(docs.select("doc_id", "text"), shortest, least), "words"))
    has = F.col("best").isNotNull() & (-F.col("best.neg") >= F.col("n") * ratio)
    forms = stage(
        found.select(
            "word",
            F.when(has, F.col("best.word")).alias("form"),
            F.col("n").cast("long").alias("n"),
            "n_near",
            F.when(has, -F.col("best.neg")).cast("long").alias("form_n"),
        ),
        "forms",
    )
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
