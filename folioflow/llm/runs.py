"""Levelled sorted runs: an index of 128-bit or 64-bit hashes that grows batch by batch.

A run is an immutable bucketed table, sorted by hash inside each bucket. New batches become
runs of level 0; as soon as a level has ``fanout`` runs they are merged into one run of the
next level, so a lookup meets a number of runs logarithmic in the batches. All runs have the
same buckets, so joining a run to a batch moves only the batch, and compaction merges runs
bucket by bucket without a shuffle.

Runs lie in the folder that the driver and all executors share, or in one that is named, and
``state`` has what a later session needs to register them again.

A batch can have a name. Its rows then carry the name of the attempt that added them; adding a
batch of the same name again voids the former attempt's rows, which lookups pass over and
compaction removes. So a batch whose work failed after it was added is simply given again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_path, scratch_root, shuffle_parts

_ATTEMPT = "_attempt"


class Runs:
    """Runs of rows with key columns ``keys`` (longs) and further columns."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], fanout: int = 2, buckets: int | None = None, prefix: str = "runs", levels: list[list[str]] | None = None, folder: str | None = None):
        self.spark, self.keys, self.fanout = spark, list(keys), fanout
        self.buckets = buckets or shuffle_parts(spark)
        self.prefix = prefix if levels is not None else f"{prefix}_{uuid.uuid4().hex}"
        self.folder = folder or f"{scratch_root(spark)}/folioflow-{self.prefix}"
        self.levels = levels or []
        #: The attempt that holds for each named batch, and those that don't count any more.
        self.batches: dict[str, str] = {}
        self.void: list[str] = []
        self._columns = ""

    @property
    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def state(self) -> dict:
        """What a later session needs to go on with the same index."""
        kept = ("keys", "fanout", "buckets", "prefix", "levels", "folder", "batches", "void")
        return {k: getattr(self, k) for k in kept} | {"columns": self._columns}

    @classmethod
    def resume(cls, spark: SparkSession, state: dict) -> Runs:
        out = cls(spark, state["keys"], state["fanout"], state["buckets"], state["prefix"], [list(x) for x in state["levels"]], state["folder"])
        out.batches, out.void, out._columns = dict(state["batches"]), list(state["void"]), state["columns"]
        keys = ", ".join(out.keys)
        for name in out.tables:
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} ({out._columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {out.buckets} BUCKETS LOCATION '{out.folder}/{name}'")
        return out

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` dealt by key as the runs are, so that joins to runs need no further exchange."""
        return df.repartition(self.buckets, *self.keys)

    def _write(self, df: DataFrame, dealt: bool) -> str:
        name = f"{self.prefix}_{uuid.uuid4().hex[:12]}"
        rows = df if dealt else self.dealt(df)
        self._columns = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
        rows.sortWithinPartitions(*self.keys).write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, f"{self.folder}/{name}")

    def add(self, df: DataFrame, batch: str | None = None) -> None:
        """Add a batch as a run of level 0, then compact. An index has either named batches or
        such without a name."""
        if not self.levels:
            self.levels.append([])
        if batch is None:
            self.levels[0].append(self._write(df, dealt=False))
        else:
            attempt = uuid.uuid4().hex
            self.levels[0].append(self._write(df.withColumn(_ATTEMPT, F.lit(attempt)), dealt=False))
            if batch in self.batches:
                self.void.append(self.batches[batch])
            self.batches[batch] = attempt
        self._compact()

    def _compact(self) -> None:
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fanout:
                old = self.levels[at]
                merged = self._write(self._union(old), dealt=True)
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)
                self.levels[at] = []
                for name in old:
                    self._remove(name)

    def _live(self, name: str, batch: str | None = None) -> DataFrame:
        """A run's rows that count, without those of ``batch``."""
        rows = self.spark.table(name)
        void = [*self.void, *([self.batches[batch]] if batch in self.batches else [])]
        return rows.where(~F.col(_ATTEMPT).isin(void)) if void else rows

    def _union(self, names: list[str]) -> DataFrame:
        out = self._live(names[0])
        for name in names[1:]:
            out = out.unionByName(self._live(name))
        return out if len(names) == 1 else self.dealt(out)

    def absent(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key no run has: one merge anti-join a run."""
        for name in self.tables:
            batch = batch.join(self._live(name).select(*self.keys).hint("merge"), self.keys, "left_anti")
        return batch

    def present(self, batch: DataFrame, other_than: str | None = None) -> DataFrame | None:
        """Rows of ``batch`` joined to the runs that have their key; None without runs. Rows that
        the named batch ``other_than`` has added don't count."""
        out = None
        for name in self.tables:
            found = batch.join(self._live(name, other_than).hint("merge"), self.keys)
            out = found if out is None else out.unionByName(found)
        return out

    def drop(self) -> None:
        for name in self.tables:
            self._remove(name)
        remove_path(self.spark, self.folder)
        self.levels = []
