"""Keyed state in tiers: ledger keys (F2, T1), contacts (T1) and contact parts.

Every batch writes its rows as one *run* of level 0. When a level holds ``fan``
runs, they are merged into one run of the next level, so a state of ``n`` batches
has fewer than ``fan`` runs on each of some ``log(n) / log(fan)`` levels and a row is
rewritten once per level, however long the stream lives. Runs above level 0 are
bucketed by the key, one file per bucket: a lookup joins each of them with the
batch's keys where they lie, without an exchange on the state's side. Level 0 is
plain Parquet of at most ``fan`` batches.

Which runs count is a list of names that the caller commits with its batch. A run is
named by its level and the batch that wrote it; a batch that comes again overwrites its
own runs alone, and a merge reads only runs of earlier batches and its own, so nothing
that a committed list names is ever rewritten. Runs no longer named stay on disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 8
BUCKETS = 64


def level_of(run: str) -> int:
    return int(run.split("-")[0])


def add_run(runs: list[str], batch: int, fan: int = FAN) -> tuple[list[str], list[str]]:
    """(live runs, merged runs) after ``batch`` wrote its run ``0-<batch>``.

    With merged runs, the last live run is the one that they are merged into. A merge
    that fills the next level takes that level along, so a batch writes one merged run at most.
    """
    live, level, merged = [*runs, f"0-{batch}"], 0, []
    while True:
        full = [r for r in live if level_of(r) == level]
        if len(full) + (1 if merged else 0) < fan:
            break
        merged = [*merged, *full]
        live = [r for r in live if level_of(r) != level]
        level += 1
    return ([*live, f"{level}-{batch}"] if merged else live), merged


class Tiers:
    """Runs of rows keyed by ``key`` under ``path``; ``merge`` reduces rows of several runs to one row per key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, merge: Callable[[DataFrame], DataFrame],
                 fan: int = FAN, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.merge, self.fan, self.buckets = merge, fan, buckets

    def _folder(self, run: str) -> str:
        return f"{self.path}/run={run}"

    def _table(self, run: str) -> str:
        return "tier_" + hashlib.md5(self._folder(run).encode()).hexdigest()

    def run(self, run: str) -> DataFrame:
        """The rows of one run; above level 0 as a bucketed table, declared again where the catalog lacks it."""
        if level_of(run) == 0:
            return self.spark.read.schema(self.schema).parquet(self._folder(run))
        if not self.spark.catalog.tableExists(self._table(run)):
            self.spark.sql(
                f"CREATE TABLE {self._table(run)} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) "
                f"SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self._folder(run)}'")
        return self.spark.table(self._table(run))

    def read(self, runs: list[str]) -> DataFrame:
        """One row per key over the live runs."""
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(reduce(DataFrame.unionByName, map(self.run, runs)))

    def lookup(self, keys: DataFrame, runs: list[str]) -> DataFrame:
        """One row per key of ``keys`` (a frame of that column) that the state holds.

        Each run meets the keys on its own, so bucketed runs are not shuffled and what is merged is no more than was asked.
        """
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(reduce(DataFrame.unionByName, [self.run(r).join(keys, self.key, "left_semi") for r in runs]))

    def put(self, rows: DataFrame, batch: int, runs: list[str]) -> list[str]:
        """Write ``rows`` as the batch's run, merge full levels; the live runs to commit."""
        names = StructType.fromDDL(self.schema).names
        rows.select(*names).write.mode("overwrite").parquet(self._folder(f"0-{batch}"))
        live, merged = add_run(runs, batch, self.fan)
        if merged:
            whole = self.read(merged).select(*names)
            (whole.repartition(self.buckets, F.col(self.key)).sortWithinPartitions(self.key)
             .write.mode("overwrite").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
             .option("path", self._folder(live[-1])).saveAsTable(self._table(live[-1])))
        return live
