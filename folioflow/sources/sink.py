"""The archive as a data source that is written to: ``format("folioflow_archive")``.

Rows have final_dest and what is to be left under that name: a document (path, size, digest,
and content where the bytes are in the row) or its trace (trace), or both. Every row ends as an
outcome, (path, final_dest, filed, filing_error, trace_error), never as an exception.

Tasks do the writing, which is idempotent: a document is copied beside its name, verified and
linked, and one that is there already is recognised; a trace is replaced whole. A task that is
run again, or twice at once, therefore does no harm to the tree. It does leave a second file of
outcomes, so these are committed: each task writes its outcomes to a file of its own under the
option ``outcome`` and returns that file's name with its counts; when all tasks are done the
driver writes the list of names, which makes them the result of the run, all at once. If the
job fails or is cancelled the driver removes the files, and there is no result. What passes the
driver is one line a task, however many documents there are. Whatever a killed task had begun
to write is in the run's own staging folder of the archive, which goes in either case.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.filing import Archive, FilingError
from ..scratch import opened, write_whole
from ..workers import importable
from .inventory import SUFFIX

OUTCOME = "path string, final_dest string, filed boolean, filing_error string, trace_error string"
_ARROW = pa.schema([("path", pa.string()), ("final_dest", pa.string()), ("filed", pa.bool_()), ("filing_error", pa.string()), ("trace_error", pa.string())])
_LIST = "_committed.json"


@dataclass
class Done(WriterCommitMessage):
    """A task's file of outcomes, and how many there are and failed."""

    part: str
    rows: int
    failed: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, root: str, outcome: str, move: bool):
        self.root, self.outcome, self.move = root, outcome, move
        self.staging = f".folioflow-{uuid.uuid4().hex}"

    def write(self, iterator) -> Done:
        import pyarrow.parquet as pq

        archive = Archive(self.root, self.staging)
        fs, folder = opened(self.outcome)
        fs.create_dir(folder, recursive=True)
        part = f"part-{uuid.uuid4().hex}.parquet"
        rows = failed = 0
        with fs.open_output_stream(f"{folder}/{part}") as out, pq.ParquetWriter(out, _ARROW) as writer:
            for batch in iterator:
                told = [self._row(archive, row) for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist()]
                rows += len(told)
                failed += sum(t["filing_error"] is not None or t["trace_error"] is not None for t in told)
                writer.write_batch(pa.RecordBatch.from_pylist(told, schema=_ARROW))
        return Done(part, rows, failed)

    def _row(self, archive: Archive, row: dict) -> dict:
        name = row["final_dest"]
        out = {"path": row.get("path"), "final_dest": name, "filed": None, "filing_error": None, "trace_error": None}
        if row.get("digest") is not None:
            try:
                source = row["content"] if "content" in row else row["path"].removeprefix("file:")
                out["filed"] = archive.place(source, row["size"], row["digest"], name, self.move) == "filed"
            except (OSError, FilingError) as e:
                return out | {"filed": False, "filing_error": str(e)}
        if row.get("trace") is not None:
            try:
                archive.write_atomic(name + SUFFIX, row["trace"].encode())
            except (OSError, FilingError) as e:
                out["trace_error"] = str(e)
        return out

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        fs, folder = opened(self.outcome)
        told = {"parts": [m.part for m in done], "rows": sum(m.rows for m in done), "failed": sum(m.failed for m in done)}
        write_whole(fs, f"{folder}/{_LIST}", json.dumps(told).encode())
        Archive(self.root, self.staging).cleared()

    def abort(self, messages) -> None:
        fs, folder = opened(self.outcome)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.part}")
        Archive(self.root, self.staging).cleared()


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folioflow_archive"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("an archive is only added to: use mode('append')")
        return ArchiveWriter(self.options["root"], self.options["outcome"], self.options.get("move", "false") == "true")


def write_archive(rows: DataFrame, root: str, outcome: str, move: bool = False) -> DataFrame:
    """Leave ``rows`` in the archive and return their outcomes. ``outcome`` is a folder that
    the driver and all executors share, as the archive itself."""
    spark = rows.sparkSession
    importable(spark)
    spark.dataSource.register(ArchiveSink)
    kept = [c for c in ("path", "size", "digest", "content", "final_dest", "trace") if c in rows.columns]
    sent = rows.where("final_dest IS NOT NULL").select(*kept)
    sent.write.format("folioflow_archive").option("root", root).option("outcome", outcome).option("move", str(move).lower()).mode("append").save()
    return committed(spark, outcome)


def committed(spark: SparkSession, outcome: str) -> DataFrame:
    """The outcomes of a run that was committed; an error if it wasn't."""
    fs, folder = opened(outcome)
    with fs.open_input_stream(f"{folder}/{_LIST}") as f:
        parts = json.loads(f.read())["parts"]
    paths = [f"{outcome.rstrip('/')}/{p}" for p in parts]
    return spark.read.schema(OUTCOME).parquet(*paths) if paths else spark.createDataFrame([], OUTCOME)


def last_traces(rows: DataFrame, order: str = "path") -> DataFrame:
    """(final_dest, trace) of rows (final_dest, trace): where several documents share a name,
    the trace of the last one stays, as if they had come one after another."""
    return rows.groupBy("final_dest").agg(F.max_by("trace", order).alias("trace"))
