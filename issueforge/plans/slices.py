"""Ordered computations cut into slices of the order key.

A window over (key, everything) would put all rows of a hot key into one task.  Here the window
runs inside (key, slice), and one row per slice carries totals from slice to slice.  Slices are a
function of the data, not of the partitioning, so a recomputed task gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issueforge.plans.skew import keyed_join

MICROS = 1_000_000
DEFAULT_SLICE_US = 60 * MICROS
DAY_US = 86_400 * MICROS
SLICE_ROWS = 50_000  # rows a slice of an ordered computation holds at most, plus one seq block
SEQ_BLOCK = 1024  # consecutive seq numbers: one unit of the histogram, never cut


def slice_of(column: str, width: int) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("bigint") if width > 1 else F.col(column)


def equi_depth_slices(
    points: DataFrame, keys: list[str], order: list[str], width: int, rows: int = SLICE_ROWS, block: int = SEQ_BLOCK, out: str = "_slice"
) -> DataFrame:
    """Add ``out``: slices of equal depth, numbered 0, 1, ... per key in ``order`` (time, ties..., seq).

    Cut points come from a histogram of units (key, time, ties, seq // block): a unit has at most
    ``block`` rows per tie value, as seq is unique, so one microsecond with any number of deliveries
    is cut by seq.  The rows before each unit are found by a two-level scan: units inside a time bin
    of ``width`` and bins inside a key, with the bins' totals carried down.  A unit starting after
    r rows goes to slice r // ``rows``; a slice so holds at most ``rows`` + ``block`` rows and is a
    contiguous range of the order.  Null keys form a key of their own.  Neither scan sees rows:
    only units (within a bin) and bins (within a key).
    """
    time, *ties, seq = order
    placed = points.withColumn("_blk", F.floor(F.col(seq) / F.lit(block)).cast("bigint")).withColumn("_bin", slice_of(time, width))
    units = placed.groupBy(*keys, "_bin", time, *ties, "_blk").agg(F.count("*").alias("_n"))
    bins = units.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    bins = bins.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_bn").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_bin_before"),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(time, *ties, "_blk").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_in_bin", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    cuts = keyed_join(units, bins, [*keys, "_bin"]).select(
        *keys, time, *ties, "_blk", F.floor((F.col("_bin_before") + F.col("_in_bin")) / F.lit(rows)).cast("bigint").alias(out)
    )
    return keyed_join(placed.drop("_bin"), cuts, [*keys, time, *ties, "_blk"]).drop("_blk")


def running_total(
    points: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to and including this one.

    ``order`` must be total within a key and its first column is the one that is sliced.
    """
    sliced = points.withColumn("_slice", slice_of(order[0], width))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = sliced.withColumn("_own", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "_slice").agg(
        F.max_by("_own", F.struct(*order)).alias("_total")
    )  # same partitioning as the window: no further shuffle of the points
    carried = ends.select(
        *keys,
        "_slice",
        F.coalesce(
            F.sum("_total").over(
                Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    return (
        keyed_join(local, carried, [*keys, "_slice"])
        .withColumn(out, F.col("_own") + F.col("_before"))
        .drop("_own", "_before", "_slice")
    )


def arrival_number(rows: DataFrame, time: str, tie: str, out: str) -> DataFrame:
    """Number all rows 1..n in order of (time, tie) without a single-task sort.

    Rows are ranked within their second, seconds are summed within their day, days are summed over
    the whole span: the only unpartitioned window sees one row per day.
    """
    placed = rows.withColumn("_sec", slice_of(time, MICROS)).withColumn("_day", slice_of(time, DAY_US))
    ranked = placed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_day", "_sec").orderBy(time, tie))
    )
    seconds = placed.groupBy("_day", "_sec").agg(F.count("*").alias("_n"))
    days = seconds.groupBy("_day").agg(F.sum("_n").alias("_n"))
    day_start = days.select(
        "_day",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_day_start"),
    )
    starts = (
        seconds.withColumn(
            "_in_day",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy("_day").orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .join(day_start, "_day")
        .select("_day", "_sec", (F.col("_in_day") + F.col("_day_start")).alias("_start"))
    )
    return (
        ranked.join(starts, ["_day", "_sec"])
        .withColumn(out, F.col("_start") + F.col("_rank"))
        .drop("_day", "_sec", "_rank", "_start")
    )
