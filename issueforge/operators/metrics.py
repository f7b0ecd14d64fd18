"""Nearest-rank summaries of numeric columns, exact at any size.

A rank is found by narrowing: count coarse value buckets, then fine buckets inside the ones that
hold a wanted rank, then the distinct values inside those.  All three passes are partial
aggregates over a two-column scan; the rows themselves are never sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issueforge.plans.skew import join_by_size, keyed_join
from issueforge.session import materialize

PERCENTILES = {"p50": 50.0, "p95": 95.0, "p99": 99.0}
OCTAVE_BUCKETS = 64
FINE_BUCKETS = 65_536


def _coarse(value: Column) -> Column:
    """A non-decreasing bucket number: about 1 % of the value wide; NaN is above all numbers, as in Spark's order."""
    size = F.least(F.floor(F.log2(F.abs(value) + 1.0) * OCTAVE_BUCKETS).cast("bigint"), F.lit(1 << 61))
    return F.when(F.isnan(value), F.lit(1 << 62)).when(value < 0, -size).otherwise(size)


def _fine(value: Column, low: Column, high: Column) -> Column:
    share = F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.floor(share * FINE_BUCKETS).cast("bigint")


def _rank(percent: float, n: Column, half_up: bool) -> Column:
    exact = F.lit(percent / 100.0) * (n - 1)
    k = F.floor(exact + 0.5) if half_up else F.bround(exact, 0)
    return F.greatest(F.lit(0), F.least(n - 1, k.cast("bigint")))


def _narrow(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the bucket in which each wanted rank falls and make the rank relative to it."""
    up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_before", up_to - F.col("n"))
    hit = F.filter(
        "ranks", lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("n"))
    )
    return (
        placed.withColumn("ranks", hit)
        .filter(F.size("ranks") > 0)
        .withColumn(
            "ranks",
            F.transform(
                "ranks", lambda r: F.struct(r["name"].alias("name"), (r["rank"] - F.col("_before")).alias("rank"))
            ),
        )
        .drop("_before")
    )


def metric_summary(
    rows: DataFrame, value: str, by: list[str] | None = None, half_up: bool = False, decimals: int = 4
) -> DataFrame:
    """D8 (D9 with ``half_up``): n, min, p50, p95, p99, max, mean per group.

    Rank k = round(p/100 * (n-1)), ties to even by default.  An ungrouped summary of no rows is
    n = 0 with zeros.
    """
    keys = by or ["_all"]
    data = rows if by else rows.withColumn("_all", F.lit(0))
    data = data.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").withColumn(
        "_b1", _coarse(F.col("v"))
    )
    first = materialize(
        data.groupBy(*keys, "_b1").agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("s")
        ),
        "summary",
    )
    totals = first.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        (F.sum("s") / F.sum("n")).alias("mean"),
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), _rank(p, F.col("_total"), half_up).alias("rank"))
            for name, p in PERCENTILES.items()
        ]
    )
    coarse = _narrow(
        first.withColumn("_total", total).withColumn("ranks", wanted), keys, "_b1"
    ).select(*keys, "_b1", "low", "high", "ranks")
    inside = join_by_size(data, coarse, [*keys, "_b1"]).withColumn(
        "_b2", _fine(F.col("v"), F.col("low"), F.col("high"))
    )
    fine = _narrow(
        inside.groupBy(*keys, "_b1", "_b2").agg(F.count("*").alias("n"), F.any_value("ranks").alias("ranks")),
        [*keys, "_b1"],
        "_b2",
    ).select(*keys, "_b1", "_b2", F.col("ranks").alias("fine_ranks"))
    leaves = join_by_size(inside.drop("ranks"), fine, [*keys, "_b1", "_b2"])
    values = _narrow(
        leaves.groupBy(*keys, "_b1", "_b2", "v").agg(
            F.count("*").alias("n"), F.any_value("fine_ranks").alias("ranks")
        ),
        [*keys, "_b1", "_b2"],
        "v",
    )
    picked = values.select(*keys, "v", F.explode("ranks.name").alias("name")).groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in PERCENTILES]
    )
    columns = ["min", *PERCENTILES, "max", "mean"]
    result = keyed_join(totals, picked, keys)
    if not by:
        result = result.groupBy().agg(
            F.coalesce(F.max("n"), F.lit(0)).alias("n"),
            *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns],
        )
    return result.select(*(by or []), "n", *[F.round(c, decimals).alias(c) for c in columns])


def metric_summary_approx(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The one-pass form: percentiles within 1/10000 of the rank, one aggregate, no narrowing."""
    shares = F.percentile_approx(value, [p / 100.0 for p in PERCENTILES.values()], 10_000)
    return (
        rows.groupBy(*(by or []))
        .agg(
            F.count(value).alias("n"), F.min(value).alias("min"), shares.alias("_p"),
            F.max(value).alias("max"), F.avg(value).alias("mean"),
        )
        .select(
            *(by or []), "n", "min",
            *[F.col("_p")[i].alias(name) for i, name in enumerate(PERCENTILES)],
            "max", "mean",
        )
    )
