"""Seen-id index for streaming dedupe: stored event ids in hash buckets, runs merged by size.

Each micro-batch adds a run of the ids it stored, written as one folder per hash bucket
(``bucket = pmod(xxhash64(event_id), buckets)``), sorted by id, with a Parquet Bloom filter on the
id in every file.  Runs are merged by size, as in a tiered log-structured store: ``fanout`` runs
of one level become one run of the next level, which has ``fanout`` times the buckets, so a
bucket holds about the same number of rows at every level.  A lookup opens, per run, only the
bucket folders its ids hash to; the Bloom filters serve point lookups (`SeenIndex.find`) that
push ``event_id = x`` into the Parquet reader.

Rows opened by a lookup of k ids: per run at most min(k, buckets) folders of about
rows_per_batch / base rows each, over at most (fanout - 1) runs per level and log_fanout(batches)
levels.  This grows with the batch and the logarithm of the history, not with the history.
Choose ``base`` near the ids of a micro-batch for folders of a row or so per id; a lookup of far
more ids than a run has buckets opens the whole run (the plain join of before).

Replays: a run is named by its level and the first and last micro-batch it holds.  A lookup for
micro-batch b reads the largest runs that end before b, so a replayed micro-batch sees the same
ids whether or not a merge happened in between; merges take only runs that end before the
micro-batch that starts them, and delete their inputs after the merged run is written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_BUCKETS = 16
FANOUT = 4
_RUN = re.compile(r"run-(\d+)-(\d+)-(\d+)$")


@dataclass(frozen=True)
class Run:
    level: int
    first: int
    last: int
    path: str


class SeenIndex:
    """The ids stored below ``root``, with ``schema`` columns, keyed by ``key``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "event_id", base: int = BASE_BUCKETS, fanout: int = FANOUT):
        self.spark, self.root, self.schema, self.key, self.base, self.fanout = spark, root.rstrip("/"), schema, key, base, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def buckets(self, level: int) -> int:
        return self.base * self.fanout**level

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def runs(self) -> list[Run]:
        """Every run folder with its level and micro-batches, oldest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        found = []
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            match = _RUN.match(name)
            if match and status.isDirectory() and self._fs.exists(self._path(f"{self.root}/{name}/_SUCCESS")):
                level, first, last = map(int, match.groups())
                found.append(Run(level, first, last, f"{self.root}/{name}"))
        return sorted(found, key=lambda r: (r.first, -r.last))

    def cover(self, before: int) -> list[Run]:
        """The largest runs that end before micro-batch ``before``; runs inside another one are left out."""
        ended = [r for r in self.runs() if r.last < before]
        return [r for r in ended if not any(o != r and o.first <= r.first and o.last >= r.last for o in ended)]

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> None:
        buckets = self.buckets(level)
        placed = rows.withColumn("bucket", self._bucket(buckets)).repartition(min(buckets, 200), "bucket").sortWithinPartitions("bucket", self.key)
        (
            placed.write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#" + self.key, "true")
            .partitionBy("bucket")
            .parquet(f"{self.root}/run-{level}-{first}-{last}")
        )

    def add(self, rows: DataFrame, batch: int) -> None:
        """Stores ``rows`` (the schema's columns) as micro-batch ``batch``'s run; a replay overwrites it."""
        self._write(rows.select(*[c.split()[0] for c in self.schema.split(",")]), 0, batch, batch)

    def compact(self, before: int) -> None:
        """Merges ``fanout`` runs of one level that end before ``before`` into one of the next level, as often as possible."""
        while True:
            cover = self.cover(before)
            levels = {}
            for run in cover:
                levels.setdefault(run.level, []).append(run)
            full = [rs for _, rs in sorted(levels.items()) if len(rs) >= self.fanout]
            if not full:
                return
            merged = full[0][: self.fanout]
            rows = self._read(*[r.path for r in merged])
            self._write(rows, merged[0].level + 1, merged[0].first, merged[-1].last)
            for run in merged:
                self._fs.delete(self._path(run.path), True)

    def _read(self, *paths: str) -> DataFrame:
        """Files below ``paths``; bucket folders of several runs are read as plain files, without partition columns."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _opened(self, run: Run, hit: set[int], largest: int) -> list[str]:
        buckets = self.buckets(run.level)
        wanted = {b % buckets for b in hit} if largest % buckets == 0 else set(range(buckets))
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(run.path))}
        return [f"{run.path}/bucket={b}" for b in sorted(wanted) if f"bucket={b}" in there]

    def opened(self, ids: DataFrame, before: int) -> list[str]:
        """The bucket folders a lookup of ``ids`` before micro-batch ``before`` opens.

        The driver gathers the distinct buckets of the ids at the finest level in use: at most
        min(distinct ids, buckets of the largest run) integers.
        """
        cover = self.cover(before)
        if not cover:
            return []
        largest = max(self.buckets(r.level) for r in cover)
        hit = {r[0] for r in ids.select(self._bucket(largest).alias("b")).distinct().collect()}
        return [p for run in cover for p in self._opened(run, hit, largest)]

    def lookup(self, ids: DataFrame, before: int) -> DataFrame:
        """Stored rows whose key is among ``ids`` (a table with the key column), from runs before micro-batch ``before``."""
        paths = self.opened(ids, before)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = self._read(*paths)
        return stored.join(ids.select(self.key).distinct(), self.key, "left_semi")

    def find(self, key: str, before: int) -> DataFrame:
        """Stored rows of one key: one bucket folder per run, row groups skipped by their Bloom filters."""
        probe = self.spark.createDataFrame([(key,)], f"{self.key} string")
        paths = self.opened(probe, before)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self._read(*paths).filter(F.col(self.key) == key)
