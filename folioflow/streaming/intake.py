"""Streaming intake: new files become micro-batches of the same plan, names are keyed state.

Documents have no event time, so there are no windows or watermarks here. Two streams follow
each other:

1. Files to plan rows. A micro-batch is planned like any other run and written once, under its
   number; a batch that is run again after a failure finds its folder and leaves it.
2. Plan rows to names. Rows are keyed by what their name is a suffixed form of, so that all
   names that can meet are one key. Its state is the names taken under it and what they hold.
   A batch reads its own rows and the state of its keys; nothing of former output is read, so a
   batch costs the same however long the stream has run.

``outcome`` joins what both have written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.naming import extension, without_extension
from ..operators.claim import MOST_SUFFIX, TOO_MANY
from ..scratch import opened
from ..sources.documents import identified
from ..workers import importable

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
CLAIMED = "path string, final_dest string, duplicate boolean, claim_error string"
_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watched_files(spark: SparkSession, path: str, pattern: str | None = None, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, size, content) of the files that appear under ``path``."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size"), "content")


def _forms(name: str) -> tuple[str, str]:
    """A name's stem and extension, as suffixes go between them."""
    folder, slash, leaf = name.rpartition("/")
    stem, dot, ext = leaf.rpartition(".")
    return (f"{folder}{slash}{stem}", dot + ext) if dot else (name, "")


def _nth(dest: str, n: int) -> str:
    stem, ext = _forms(dest)
    return dest if n == 1 else f"{stem}-{n}{ext}"


class Names:
    """The names that are taken under one key, and of each destination met its free suffixes and
    where its contents are."""

    def __init__(self, taken: dict[str, tuple[int, str]], most: int = MOST_SUFFIX):
        self.taken, self.most = taken, most
        self.known: dict[str, tuple[dict[tuple[int, str], int], list[int]]] = {}
        self.new: list[str] = []

    def _of(self, dest: str):
        if dest not in self.known:
            first: dict[tuple[int, str], int] = {}
            for n in range(self.most, 0, -1):
                there = self.taken.get(_nth(dest, n))
                if there and there[0] > 0:
                    first[there] = n
            self.known[dest] = (first, [1])
        return self.known[dest]

    def claim(self, dest: str, size: int, digest: str) -> tuple[str | None, bool]:
        """(name, whether it holds the same content already); no name where none is free."""
        first, at = self._of(dest)
        while at[0] <= self.most and _nth(dest, at[0]) in self.taken:
            at[0] += 1
        same = first.get((size, digest), self.most + 1) if size > 0 else self.most + 1
        n = min(same, at[0])
        if n > self.most:
            return None, False
        name = _nth(dest, n)
        if n == same:
            return name, True
        self._take(name, (size, digest))
        return name, False

    def _take(self, name: str, content: tuple[int, str]) -> None:
        self.taken[name] = content
        self.new.append(name)
        stem, ext = _forms(name)
        root, dash, number = stem.rpartition("-")
        places = [(name, 1)]
        if dash and number.isdigit() and number[0] != "0" and 2 <= int(number) <= self.most:
            places.append((root + ext, int(number)))
        for dest, n in places:
            if dest in self.known and content[0] > 0:
                first = self.known[dest][0]
                first[content] = min(n, first.get(content, n))


class Claims(StatefulProcessor):
    """(path, final_dest, duplicate, claim_error) of rows (path, size, digest, dest) of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "name string", "size long, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = Names({k[0]: (v[0], v[1]) for k, v in self.held.iterator()})
        out = []
        for row in pd.concat(list(rows)).sort_values("path", kind="stable").itertuples():
            name, same = names.claim(row.dest, row.size_, row.digest)
            out.append((row.path, name, same, None if name else TOO_MANY))
        for name in names.new:
            self.held.updateValue((name,), names.taken[name])
        yield pd.DataFrame(out, columns=["path", "final_dest", "duplicate", "claim_error"])

    def close(self) -> None:
        pass


def plan_stream(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Plan each batch and write it to ``out``/planned/batch=n. plan: from scanned rows to plan rows."""

    def batch(rows: DataFrame, n: int) -> None:
        fs, folder = opened(f"{out}/planned/batch={n}")
        if not fs.get_file_info(f"{folder}/_SUCCESS").is_file:
            plan(identified(rows)).drop("content").write.mode("overwrite").parquet(f"{out}/planned/batch={n}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/planned")
    return (writer.trigger(availableNow=True) if once else writer).start()


def claim_stream(spark: SparkSession, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Claim names for what ``plan_stream`` has planned, in the order in which it came."""
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE)
    planned = spark.readStream.schema("path string, size long, digest string, dest string, error_kind string, batch int").parquet(f"{out}/planned")
    good = planned.where("error_kind IS NULL AND dest IS NOT NULL").select("path", F.col("size").alias("size_"), "digest", "dest")
    root = F.concat(F.regexp_replace(without_extension(F.col("dest")), r"(-[1-9][0-9]{0,3})+\z", ""), extension(F.col("dest")))
    named = good.withColumn("root", root).groupBy("root").transformWithStateInPandas(Claims(), CLAIMED, "Append", "None")
    writer = named.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/claimed").option("path", f"{out}/claimed")
    return (writer.trigger(availableNow=True) if once else writer).start()


def intake(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> tuple[StreamingQuery, StreamingQuery]:
    """Both streams over what is there, one after the other, or started for good."""
    first = plan_stream(stream, plan, out, checkpoint, once)
    if once:
        first.awaitTermination()
    second = claim_stream(stream.sparkSession, out, checkpoint, once)
    if once:
        second.awaitTermination()
    return first, second


def outcome(spark: SparkSession, out: str) -> DataFrame:
    """The plan rows so far, with batch, final_dest, duplicate and claim_error."""
    planned = spark.read.parquet(f"{out}/planned")
    claims = spark.read.schema(CLAIMED).parquet(f"{out}/claimed")
    rows = planned.join(claims, "path", "left")
    return rows.withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
