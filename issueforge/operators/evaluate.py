"""Grouping quality against labels, from the contingency table only.

Pairs are never formed: every measure follows from the cell counts and the two margins, which are
plain aggregates.  Entropies use  H(C|K) = (sum_k n_k ln n_k - sum_ck n_ck ln n_ck) / n , so no
join between cells and margins is needed either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.plans.skew import attach, salt, salts_seen

WIDE = "decimal(38,0)"  # squares of 10^11-row counts do not fit a BIGINT


def contingency(labels: DataFrame) -> DataFrame:
    """(true_label, pred_label, n): the one shuffle that sees all rows, partially aggregated."""
    return labels.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    wide = n.cast("decimal(19,0)")
    return (wide * (wide - F.lit(1).cast("decimal(1,0)"))).cast(WIDE)


def _sums(labels: DataFrame) -> DataFrame:
    """One row with all totals; cells and margins come from one GROUPING SETS pass over the cells."""
    t, p = "true_label", "pred_label"
    sets = contingency(labels).groupingSets([[t, p], [t], [p]], t, p).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("width"),
        F.grouping_id().alias("g"),
    )
    cell, by_true, by_pred = F.col("g") == 0, F.col("g") == 1, F.col("g") == 2

    def total(which: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, value)), F.lit(0))

    def rows(which: Column) -> Column:
        return F.count(F.when(which, F.lit(1)))

    n_ln_n = F.col("n") * F.log(F.col("n").cast("double"))
    return sets.agg(
        total(cell, F.col("n")).alias("n"),
        (total(cell, _pairs(F.col("n"))) / 2).cast(WIDE).alias("tp"),
        (total(by_pred, _pairs(F.col("n"))) / 2).cast(WIDE).alias("same_pred"),
        (total(by_true, _pairs(F.col("n"))) / 2).cast(WIDE).alias("same_true"),
        rows(by_true).alias("true_groups"),
        rows(by_pred).alias("predicted_clusters"),
        rows(by_pred & (F.col("width") > 1)).alias("false_merges"),
        rows(by_true & (F.col("width") > 1)).alias("false_splits"),
        total(cell, n_ln_n).alias("cell_ln"),
        total(by_true, n_ln_n).alias("true_ln"),
        total(by_pred, n_ln_n).alias("pred_ln"),
    )


def _confusion(sums: DataFrame) -> DataFrame:
    return (
        sums.withColumn("fp", (F.col("same_pred") - F.col("tp")).cast(WIDE))
        .withColumn("fn", (F.col("same_true") - F.col("tp")).cast(WIDE))
        .withColumn(
            "tn",
            ((_pairs(F.col("n")) / 2).cast(WIDE) - F.col("same_pred") - F.col("same_true") + F.col("tp")).cast(WIDE),
        )
    )


def _scores(confusion: DataFrame) -> DataFrame:
    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(1.0))

    p, r = F.col("precision"), F.col("recall")
    return (
        confusion.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0)))
    )


def _entropies(sums: DataFrame) -> DataFrame:
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")

    def entropy(total: str, groups: str) -> Column:
        return F.when(F.col(groups) > 1, F.log(n) - F.col(total) / n).otherwise(F.lit(0.0))

    def share(conditional: Column, whole: str) -> Column:
        return F.when(F.col(whole) > 0, 1 - conditional / F.nullif(F.col(whole), F.lit(0.0))).otherwise(F.lit(1.0))

    h, c = F.col("homogeneity"), F.col("completeness")
    return (
        sums.withColumn("true_entropy", entropy("true_ln", "true_groups"))
        .withColumn("pred_entropy", entropy("pred_ln", "predicted_clusters"))
        .withColumn("homogeneity", share((F.col("pred_ln") - F.col("cell_ln")) / n, "true_entropy"))
        .withColumn("completeness", share((F.col("true_ln") - F.col("cell_ln")) / n, "pred_entropy"))
        .withColumn("v_measure", F.when(h + c != 0, 2 * h * c / F.nullif(h + c, F.lit(0.0))).otherwise(F.lit(0.0)))
    )


def pair_confusion(labels: DataFrame) -> DataFrame:
    """E1"""
    return _confusion(_sums(labels)).select("tp", "fp", "fn", "tn")


def pair_prf(labels: DataFrame) -> DataFrame:
    """E2"""
    return _scores(_confusion(_sums(labels))).select("precision", "recall", "f1")


def merge_split_counts(labels: DataFrame) -> DataFrame:
    """E3"""
    return _sums(labels).select("false_merges", "false_splits")


def split_groups(labels: DataFrame) -> DataFrame:
    """True labels found in more than one cluster, sorted."""
    return (
        contingency(labels)
        .groupBy("true_label")
        .agg(F.count("*").alias("clusters"))
        .filter("clusters > 1")
        .orderBy("true_label")
    )


def merged_clusters(labels: DataFrame) -> DataFrame:
    """(pred_label, true_label, labels) for clusters of more than one label, sorted.

    One row per label rather than one list per cluster: a cluster may swallow any number of labels.
    """
    cells = contingency(labels).withColumn("_salt", salt("true_label"))
    mixed = (
        cells.groupBy("pred_label")
        .agg(F.count("*").alias("labels"), salts_seen().alias("_salts"))
        .filter("labels > 1")
    )
    return (
        attach(cells, mixed, ["pred_label"])
        .select("pred_label", "true_label", "labels")
        .orderBy("pred_label", "true_label")
    )


def label_entropy(labels: DataFrame) -> DataFrame:
    """E5: natural-log entropy of both labelings."""
    return _entropies(_sums(labels)).select("true_entropy", "pred_entropy")


def homogeneity_completeness_v(labels: DataFrame) -> DataFrame:
    """E6"""
    return _entropies(_sums(labels)).select("homogeneity", "completeness", "v_measure")


def eval_report(labels: DataFrame) -> DataFrame:
    """One row, four decimals."""
    full = _entropies(_scores(_confusion(_sums(labels))))
    rounded = ("precision", "recall", "f1", "homogeneity", "completeness", "v_measure")
    return full.select(
        F.col("n").alias("events"),
        "true_groups",
        "predicted_clusters",
        *[F.round(name, 4).alias(name) for name in rounded],
        "tp", "fp", "fn", "tn",
        "false_merges",
        "false_splits",
        F.round(F.col("n") / F.nullif(F.col("predicted_clusters"), F.lit(0)), 4).alias("dedupe_ratio"),
    )


def as_double(report: DataFrame, *names: str) -> DataFrame:
    """Pair counts as DOUBLE for consumers without 38-digit decimals."""
    return report.withColumns({name: F.col(name).cast("double") for name in names})
