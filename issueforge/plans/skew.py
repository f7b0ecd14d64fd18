"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.session import materialize

SALTS = 64  # one bit each in a BIGINT mask
BROADCAST_ROWS = 100_000  # rows, checked by a count, of narrow key tables


def salt(*columns: str) -> Column:
    """A number below SALTS that spreads the rows of one key."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts_seen(salt_column: str = "_salt") -> Column:
    """Aggregate: bit mask of the salts that occur with a key (combines map-side)."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt_column})"))


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, which the result has once; NULL keys match each other."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(and_, (left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys))
    return left.join(other, on, how).drop(*(f"_right_{k}" for k in keys))


def attach(facts: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-key rows back to the fact rows they were aggregated from.

    ``facts`` carries ``_salt`` and ``groups`` the mask ``_salts`` of the salts each key really has,
    so a rare key is copied once and a hot key up to SALTS times: the join key (keys, _salt) is
    even, and nothing is replicated that no fact row asks for.
    """
    copies = groups.withColumn(
        "_salt",
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> (shiftright(_salts, i) & 1L) = 1L)")),
    ).drop("_salts")
    return keyed_join(facts, copies, [*keys, "_salt"], how).drop("_salt")


def join_by_size(
    facts: DataFrame, small: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Inner join with a table that is usually tiny; NULL keys match each other.

    It is written out and counted first.  Up to ``limit`` rows it is broadcast; beyond that both
    sides are shuffled on (keys, salt) with the table copied once per salt.
    """
    small = materialize(small, "small-side")
    if small.count() <= limit:
        return keyed_join(facts, F.broadcast(small), keys)
    spread = 16
    # a function of the row: a repeated task gives its rows the same salts
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(spread)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    return keyed_join(salted, copies, [*keys, "_salt"]).drop("_salt")
