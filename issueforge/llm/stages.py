"""Written stages of the operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issueforge.session import materialize


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder, reads it back and lets Spark drop the shuffle files behind it.

    Spark's cleaner removes the files of a shuffle once the driver has collected the objects that
    refer to it, which an idle driver does late; a long operator would keep all of them on disk.
    ``options`` are the Parquet writer's.
    """
    out = materialize(df, name, **options)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


NARROW_ROWS = 1_000_000  # ids of eight bytes each, counted before a broadcast


def with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id is (``left_semi``) or is not (``left_anti``) in ``ids``, a table of one id column.

    Up to NARROW_ROWS ids, counted after they are written, are broadcast, so texts stay where they
    are; beyond that the join shuffles them.  Null ids match nothing.
    """
    ids = stage(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= NARROW_ROWS else ids
    return rows.join(side, rows["doc_id"] == side["_id"], how)
