"""Files of folders that all machines share, listed, read and removed by executors.

Spark's readers list on the driver and keep a status of every file there, for as long as a plan
lives. Here the driver only names the roots: a task finds the folders below each, a task each
lists a folder's files, and their names are dealt out to the tasks that read them. A task holds
one piece of names or ``PIECE`` bytes of contents (or one larger file), however many there are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import suppress
from itertools import islice
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable

#: Bytes of contents and number of names that a task hands on at a time, and the largest content that a row can hold.
PIECE, NAMES, MOST = 4 << 20, 5_000, (1 << 31) - (1 << 16)


def seen(name: str) -> bool:
    """Whether Spark's readers take a file or go into a folder of this name."""
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_metadata", "_common_metadata"))


def _apart(roots: list[str]) -> list[str]:
    """Roots without those that lie below another one and are found there."""
    given = set(roots)

    def below(root: str) -> bool:
        path = PurePosixPath(root)
        return any(str(p) in given and all(map(seen, path.relative_to(p).parts)) for p in path.parents)

    return [r for r in roots if not below(r)]


def _pieces(rows: Iterator, most: int, *schema: tuple[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_pylist([dict(zip([k for k, _ in schema], x, strict=True)) for x in some], schema=pa.schema(schema))


def _dealt(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def _folders(spark: SparkSession, roots: list[str], recursive: bool, everything: bool = False) -> DataFrame:
    """(place) of roots and, if ``recursive``, of all folders below them, through links too but never
    round in circles; with ``everything`` hidden ones as well, and none through a link."""

    def inside(place: bytes, above: frozenset) -> Iterator[tuple[bytes]]:
        yield (place,)
        if not recursive:
            return
        with suppress(OSError):
            if not os.path.isdir(place):
                return
            status = os.stat(place)
            above |= {(status.st_dev, status.st_ino)}
            with os.scandir(place) as found:
                for x in found:
                    if _is_folder(x, follow=not everything) and (everything or seen(os.fsdecode(x.name))):
                        there = os.stat(x.path)
                        if (there.st_dev, there.st_ino) not in above:
                            yield from inside(x.path, above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in batch.column("root").to_pylist():
                yield from _pieces(inside(os.fsencode(root), frozenset()), NAMES, ("place", pa.binary()))

    importable(spark)
    given = spark.createDataFrame(pa.table({"root": pa.array(roots, pa.string())})).repartition(max(1, min(len(roots), 256)))
    found = given.mapInArrow(run, "place binary")
    return found.repartition(_dealt(spark)) if recursive else found


def listed(spark: SparkSession, roots: list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(place, size) of the files that Spark's readers would take, empty ones too; a size that
    can't be told is null."""
    roots = [re.sub(r"\Afile:/*", "/", r) for r in roots]
    wanted = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern() if pattern else ".*", re.DOTALL)

    def files_of(place: bytes) -> Iterator[tuple[bytes, int | None]]:
        takes = lambda name: seen(name) and wanted.fullmatch(name)
        if not os.path.isdir(place):
            if takes(os.fsdecode(os.path.basename(place))):
                yield place, _size(place)
            return
        try:
            found = os.scandir(place)
        except OSError:
            yield place, None  # a folder that can't be opened has its row, as a file has
            return
        with found:
            yield from ((x.path, _size(x.path)) for x in found if takes(os.fsdecode(x.name)) and not _is_folder(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column("place").to_pylist():
                yield from _pieces(files_of(place), NAMES, ("place", pa.binary()), ("size", pa.int64()))

    return _folders(spark, _apart(roots) if recursive else roots, recursive).mapInArrow(run, "place binary, size long")


def _is_folder(x: os.DirEntry, follow: bool = True) -> bool:
    try:
        return x.is_dir(follow_symlinks=follow)
    except OSError:
        return False  # a link that leads round in a circle


def _size(place: bytes) -> int | None:
    try:
        return os.stat(place).st_size
    except OSError:
        return None


def contents(files: DataFrame) -> DataFrame:
    """(path, size, content) of ``listed`` files. Empty ones aren't opened; what can't be read, or
    is too large for a row, has neither size nor content."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def read(place: bytes, size: int | None) -> bytes | None:
        if not size:
            return None if size is None else b""
        try:
            with open(place, "rb") as f:
                got = f.read(MOST + 1) if size <= MOST else None
        except OSError:
            return None
        return got if got is None or len(got) <= MOST else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bulk = [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for place, size in zip(*(batch.column(k).to_pylist() for k in ("place", "size")), strict=True):
                got = read(place, size)
                if held and bulk + len(got or b"") > PIECE:
                    yield piece()
                    held, bulk = [], 0
                held.append((f"file:{place.decode('utf-8', 'replace')}", None if got is None else len(got), got))
                bulk += len(got or b"")
                if len(held) == NAMES:
                    yield piece()
                    held, bulk = [], 0
        if held:
            yield piece()

    return files.repartition(_dealt(files.sparkSession)).mapInArrow(run, "path string, size long, content binary")


def emptied(spark: SparkSession, root: str) -> None:
    """Remove all files below a folder, none through a link; its folders stay. So whoever removes
    these has no list of files to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = 0
        for batch in batches:
            for place in batch.column("place").to_pylist():
                with os.scandir(place) as found:
                    for x in found:
                        if not _is_folder(x, follow=False):
                            with suppress(FileNotFoundError):
                                os.unlink(x.path)
                            gone += 1
        yield pa.RecordBatch.from_pylist([{"gone": gone}], schema=pa.schema([("gone", pa.int64())]))

    _folders(spark, [re.sub(r"\Afile:/*", "/", root)], recursive=True, everything=True).mapInArrow(run, "gone long").agg(F.sum("gone")).collect()
