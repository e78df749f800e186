"""The inventory as a log of changes: what is known of every filed document, at scale.

A trace beside each document serves people and small runs. Over millions of documents one
join has to do: every run appends its traces as an immutable delta, sorted by destination, and
readers merge the deltas, the last trace of a destination winning. Deltas are listed in a small
file that is replaced whole, so a delta counts all at once or not at all, and one that a failed
run has left counts for nothing. ``compact`` merges all deltas into one, when readers meet many.

Defined cases: of traces of one destination in one delta the one of the greatest ``order``
stays; a null destination is nobody's and is left out; a null trace removes what was known; an
empty log is an empty table; appending under a name that the log has is the same append made
again and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import opened, remove_path, write_whole

ENTRY = "dest string, trace string"
_LIST = "_deltas.json"


class InventoryLog:
    """Deltas of (dest, trace) in ``folder``, which the driver and all executors share. One run
    at a time appends or compacts; any number reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def deltas(self) -> list[dict]:
        """(name, at) of what counts, the earliest first."""
        fs, root = opened(self.folder)
        try:
            with fs.open_input_stream(f"{root}/{_LIST}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return []

    def _list(self, deltas: list[dict]) -> None:
        fs, root = opened(self.folder)
        write_whole(fs, f"{root}/{_LIST}", json.dumps(deltas).encode())

    def append(self, rows: DataFrame, order: str, name: str | None = None) -> None:
        """Add the traces of a run, rows (dest, trace, ``order``). ``name`` tells runs apart."""
        known = self.deltas()
        if name is not None and any(name in d["names"] for d in known):
            return
        at = uuid.uuid4().hex
        last = rows.where("dest IS NOT NULL").groupBy("dest").agg(F.max_by(F.struct("trace"), order).alias("t")).select("dest", "t.trace")
        last.repartitionByRange("dest").sortWithinPartitions("dest").write.parquet(f"{self.folder}/{at}")
        self._list([*known, {"at": at, "names": [name] if name is not None else []}])

    def _merged(self, deltas: list[dict]) -> DataFrame:
        """(dest, trace, number) with the last word on each destination, removals included."""
        out = None
        for number, d in enumerate(deltas):
            rows = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{d['at']}").withColumn("number", F.lit(number))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], f"{ENTRY}, number int")
        if len(deltas) == 1:
            return out
        return out.groupBy("dest").agg(F.max_by(F.struct("trace", "number"), "number").alias("t")).select("dest", "t.*")

    def current(self) -> DataFrame:
        """(dest, trace) of all documents that are known."""
        return self._merged(self.deltas()).where("trace IS NOT NULL").select("dest", "trace")

    def traced(self, rows: DataFrame, dest: str) -> DataFrame:
        """``rows`` with the column ``trace``, null where nothing is known. Before deltas are merged
        only their entries on wanted destinations go on."""
        wanted = rows.where(F.col(dest).isNotNull()).select(F.col(dest).alias("dest")).distinct()
        out = None
        for number, d in enumerate(self.deltas()):
            part = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{d['at']}").withColumn("number", F.lit(number)).join(wanted, "dest", "left_semi")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return rows.withColumn("trace", F.lit(None).cast("string"))
        last = out.groupBy("dest").agg(F.max_by(F.struct("trace"), "number").alias("t")).select(F.col("dest").alias(dest), "t.trace")
        return rows.join(last, dest, "left")

    def compact(self) -> None:
        """One delta in place of all; what was removed or overwritten goes."""
        old = self.deltas()
        if len(old) < 2:
            return
        at = uuid.uuid4().hex
        self.current().repartitionByRange("dest").sortWithinPartitions("dest").write.parquet(f"{self.folder}/{at}")
        self._list([{"at": at, "names": [n for d in old for n in d["names"]]}])
        for d in old:
            remove_path(self.spark, f"{self.folder}/{d['at']}")
