"""The engine: plan, claim, file, hand off, trace, replay; and the command line over it."""

from __future__ import annotations

import argparse
import logging
import os
import re
import signal
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..channel import Address, Channel
from ..functions.naming import file_name
from ..operators.analyse import Client, ModelError, ReplyStore, with_replies
from ..operators.claim import claim
from ..operators.extract import Tools, with_text
from ..operators.filing import Archive, names_held
from ..operators.handoff import Command, arguments, not_attempted, run_commands
from ..operators.pages import with_paged_text
from ..sources.documents import scan_files
from ..sources.inventory import read_traces, trace_beside, trace_json
from ..sources.inventory_log import InventoryLog
from ..sources.sink import last_traces, write_archive
from ..workers import importable
from . import report
from .config import DISPOSITIONS, Config, ConfigError, load
from .plan import build_plan, exit_code
from .replay import destination_inside, replay_state
from .schema import EXIT_CODES, METADATA

VERSION_TEXT = "folioflow 0.1.0\n"
log = logging.getLogger("folioflow")


class Cancelled(Exception):
    pass


@dataclass
class Engine:
    """Configured stages over DataFrames. ``analyse`` takes rows with path and text and adds
    reply, reply_error_kind and reply_error_msg; by default it asks the configured model.

    ``scratch`` is a folder that the driver and all executors share, ``spark.checkpoint.dir`` if
    it isn't named. What calls and commands gave is written there before anything reads it, so
    that nothing is asked, run or moved twice, also when an executor is lost. With ``replies``,
    a store of the model's replies, texts are stored before the model is asked, and no prompt
    is asked again by a task, plan or run that starts over. With ``inventory``, a log of traces,
    what is known of documents comes from there, by one join, and not from the files beside
    them, which are written all the same."""

    spark: SparkSession
    config: Config
    analyse: object = None
    tools: Tools = field(default_factory=Tools)
    scratch: str = ""
    replies: ReplyStore | None = None
    inventory: InventoryLog | None = None
    #: Where the lines go that commands say while they run.
    echo: Address | None = None

    def __post_init__(self):
        importable(self.spark)
        self._run, self.cancelled = uuid.uuid4().hex, False

    @classmethod
    def configured(cls, spark: SparkSession, config: Config) -> Engine:
        ocr, vision = config.ocr, None
        if ocr.base_url and ocr.model:
            vision = Client(ocr.base_url, ocr.model, ocr.api_key.secret(), ocr.timeout).transcribe
        return cls(spark, config, tools=Tools(ocr.max_pages, ocr.dpi, ocr.timeout, vision))

    def _asked(self, rows: DataFrame) -> DataFrame:
        if self.analyse is not None:
            return self.analyse(rows)
        a, t, g = self.config.analysis, self.config.types, self.config.tags
        good = F.col("text")["error_kind"].isNull()
        try:
            client = Client(a.base_url, a.model, a.api_key.secret(), a.timeout, a.retries)
        except ModelError as e:
            return rows.withColumns({"reply": F.lit(None).cast("string"), "reply_error_kind": F.when(good, F.lit(e.kind)), "reply_error_msg": F.when(good, F.lit(str(e)))})
        if self.replies is not None:
            rows = self.stored(rows, f"extracted-{uuid.uuid4().hex}")
        return with_replies(rows, F.when(good, F.col("text")["content"]), client, t.values, t.fallback, g.values, a.retries, self.replies)

    def extracted(self, docs: DataFrame) -> DataFrame:
        """With something to look at pages with, documents are stored on the way, see ``operators.pages``."""
        if self.tools.vision is None:
            return with_text(docs, self.tools)
        run = uuid.uuid4().hex
        return with_paged_text(docs, self.tools, lambda df, name: self.stored(df, f"{name}-{run}"), self.replies)

    def plan(self, docs: DataFrame) -> DataFrame:
        """The side-effect-free plan of scanned documents. One line of steps, without branches or
        joins: each document is extracted once and asked about once each time the plan is
        evaluated, so ``execute`` and the command line store it first."""
        return build_plan(self._asked(self.extracted(docs).drop("content")), self.config)

    @property
    def folder(self) -> str:
        """This run's folder in the shared one."""
        root = self.scratch or self.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", self.spark.sparkContext.master):
                raise ConfigError("neither scratch nor spark.checkpoint.dir names a folder that the driver and all executors share")
            root = self.scratch = tempfile.mkdtemp(prefix="folioflow-")
        return f"{root.rstrip('/')}/folioflow-run-{self._run}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to the run's folder and read back."""
        if self.cancelled:
            raise Cancelled("the run was cancelled")
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def cancellable(self) -> Iterator[None]:
        """Jobs started inside can be cancelled by ``cancel``."""
        context = self.spark.sparkContext
        context.addJobTag(self._run)
        try:
            yield
        finally:
            context.removeJobTag(self._run)

    def cancel(self) -> None:
        """Stop this run from any thread: its jobs end, and with their workers the commands and
        tools that they run. What is filed stays filed, and nothing stays half written."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self._run)

    def cleared(self) -> None:
        """Remove what this run has stored."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def execute(self, plan: DataFrame, *, archive: bool = True) -> DataFrame:
        """File what the plan says, hand it off, leave traces; one row a document."""
        root, disposition = self.config.archive_root, self.config.disposition
        plan = self.stored(plan, "plan")
        good, bad = plan.where("error_kind IS NULL"), plan.where("error_kind IS NOT NULL")
        nothing = {"final_dest": F.lit(None).cast("string"), "duplicate": F.lit(False), "archive": not_attempted()}
        if disposition == "keep":
            return plan.withColumns(nothing).withColumn("action", report.action(F.col("disposition"), F.col("duplicate")))
        Archive(root)
        there = self.stored(names_held(good.select("dest"), root), "held")
        claims = claim(good.select("path", "size", "digest", "dest", F.col("path").alias("arrival")), there)
        claims = self.stored(claims, "claims")
        placed = write_archive(claims.select("path", "size", "digest", "final_dest"), root, f"{self.folder}/placed", disposition == "move").select("path", "filing_error")
        rows = good.join(claims.select("path", "final_dest", "duplicate", "claim_error"), "path").join(placed, "path", "left")
        fault = F.coalesce("claim_error", "filing_error")
        rows = rows.withColumns({"error_kind": F.when(fault.isNotNull(), F.lit("claim")), "error_msg": fault}).drop("claim_error", "filing_error")
        rows = self.handed_off(rows, archive)
        rows = self.stored(rows, "outcome")
        rows = self.traced(rows, self.traces(rows.where(f"final_dest IS NOT NULL AND ({_GOOD})")), "traces")
        bad = bad.withColumns(nothing)
        out = rows.unionByName(bad, allowMissingColumns=True)
        return out.withColumn("action", report.action(F.col("disposition"), F.col("duplicate"))).withColumn("exit_code", exit_code(F.col("error_kind")))

    def handed_off(self, rows: DataFrame, archive: bool = True) -> DataFrame:
        """Add the outcome of the external command; a failure is an error but undoes nothing."""
        a = self.config.archive
        if not archive or not a.configured:
            return rows.withColumn("archive", not_attempted())
        own, each = a.templates()
        where = F.concat(F.lit(self.config.archive_root.rstrip("/") + "/"), F.col("final_dest"))
        ready = rows.where("error_kind IS NULL").withColumn("argv", arguments(own, each, where, F.col("metadata")))
        done = run_commands(ready, Command(a.command, a.timeout, tuple(a.env), self.echo)).drop("argv")
        failed = ~F.col("archive")["success"]
        done = done.withColumns({"error_kind": F.when(failed, F.lit("archive")), "error_msg": F.when(failed, F.col("archive")["error"])})
        return done.unionByName(rows.where("error_kind IS NOT NULL").withColumn("archive", not_attempted()))

    def traces(self, rows: DataFrame) -> DataFrame:
        text = F.col("text")
        body = trace_json(F.col("path"), F.col("digest"), F.col("metadata"), F.col("rule"), F.current_timestamp(), text["truncation"], F.col("archive"))
        return rows.select("path", "final_dest", body.alias("trace"))

    def traced(self, rows: DataFrame, traces: DataFrame, name: str) -> DataFrame:
        """Leave ``traces`` (path, final_dest, trace) beside the documents. A trace that couldn't be
        written is the error of each row of its name, also where the hand-off failed: the
        next run would not know of the filing."""
        left = write_archive(last_traces(traces), self.config.archive_root, f"{self.folder}/{name}")
        failed = left.where("trace_error IS NOT NULL").select("final_dest", "trace_error")
        if self.inventory is not None:
            good = traces.join(failed, "final_dest", "left_anti").withColumnRenamed("final_dest", "dest")
            self.inventory.append(good, "path", f"{self._run}-{name}")
        out = rows.join(failed, "final_dest", "left")
        fault = F.col("trace_error").isNotNull() & (F.col("error_kind").isNull() | (F.col("error_kind") == "archive"))
        out = out.withColumns({"error_kind": F.when(fault, F.lit("trace")).otherwise(F.col("error_kind")), "error_msg": F.when(fault, F.col("trace_error")).otherwise(F.col("error_msg"))})
        return out.select(*rows.columns)

    def replayed(self, docs: DataFrame) -> DataFrame:
        """docs with record and state: what is left to do for each (see ``plans.replay``). Only
        documents inside the archive have a trace, and only theirs are read."""
        where = F.regexp_replace("path", r"\Afile:/*", "/")
        rows = docs.withColumn("inside", destination_inside(where, self.config.archive_root))
        if self.inventory is not None:
            rows = self.inventory.traced(rows, "inside")
        else:
            rows = rows.withColumn("trace", trace_beside(F.col("inside"), self.config.archive_root))
        rows = read_traces(rows)
        state = replay_state(F.col("inside").isNotNull(), F.col("record"), self.config.archive.configured)
        return rows.withColumn("state", state)


# ---------------------------------------------------------------- command line


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise _Usage(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="folioflow", description="File documents by what they say: any number of paths, globs or folders in one run.")
    p.add_argument("documents", nargs="*")
    p.add_argument("--config", default="", help="configuration file")
    p.add_argument("--output", default="text", choices=("text", "json"))
    p.add_argument("--dry-run", action="store_true", help="compute and print the plan; write nothing")
    p.add_argument("--disposition", choices=DISPOSITIONS, default=None)
    p.add_argument("--no-analysis", action="store_true", help="extract text only")
    p.add_argument("--no-file", action="store_true", help="skip filing")
    p.add_argument("--no-archive", action="store_true", help="skip the external command")
    p.add_argument("--quiet", action="store_true", help="errors only")
    p.add_argument("--verbose", action="store_true", help="debug diagnostics")
    p.add_argument("--version", action="store_true")
    return p


def main(args: list[str] | None = None, engine_of=Engine.configured, out=None, err=None) -> int:
    """0 if all documents went well, 2 for what the user can mend, else 1."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        o = parser().parse_args(args)
        if o.version:
            out.write(VERSION_TEXT)
            return 0
        if o.quiet and o.verbose:
            raise _Usage("--quiet and --verbose contradict each other")
        if not o.documents:
            raise _Usage("no document given")
        logging.basicConfig(stream=err, level=logging.ERROR if o.quiet else logging.DEBUG if o.verbose else logging.INFO)
        config = load(o.config).apply(disposition=o.disposition).validate()
    except (_Usage, ConfigError) as e:
        err.write(f"folioflow: {e}\n")
        return 2
    o.command = os.path.basename(config.archive.command)
    spark = SparkSession.builder.appName("folioflow").getOrCreate()
    engine = engine_of(spark, config)
    return run(engine, scan_files(spark, *o.documents), o, out, err)


@contextmanager
def _signals(engine: Engine) -> Iterator[None]:
    """SIGINT and SIGTERM cancel the run. Handlers belong to the main thread; a run in another
    one is cancelled by ``Engine.cancel``."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    stop = lambda *_: threading.Thread(target=engine.cancel, daemon=True).start()
    before = {s: signal.signal(s, stop) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


@contextmanager
def _echoed(engine: Engine, o, err) -> Iterator[None]:
    """What commands say is printed while they run, unless nobody wants to hear it."""
    if o.quiet or o.no_archive or not engine.config.archive.configured:
        yield
        return
    channel = Channel(engine.spark.conf.get("spark.driver.host", "localhost"), lambda line: err.write(f"{line}\n"))
    engine.echo = channel.address
    try:
        yield
    finally:
        channel.close()


def run(engine: Engine, docs: DataFrame, o, out, err) -> int:
    try:
        with _signals(engine), engine.cancellable(), _echoed(engine, o, err):
            return _run(engine, docs, o, out, err)
    except Exception:
        if not engine.cancelled:
            raise
        err.write("folioflow: interrupted; what was filed so far stays, and the next run goes on from there\n")
        return 1
    finally:
        engine.cleared()


def _run(engine: Engine, docs: DataFrame, o, out, err) -> int:
    worst = 0
    nothing = not_attempted()
    if o.no_analysis:
        empty = {c: F.lit(None).cast("string") for c in ("dest", "rule", "disposition")}
        rows = engine.extracted(docs).drop("content")
        rows = rows.withColumns(empty | {"metadata": F.lit(None).cast(METADATA), "action": F.lit(report.EXTRACTED), "archive": nothing, "error_kind": F.col("text")["error_kind"], "error_msg": F.col("text")["error_msg"]})
        show = report.output_json(rows, include_text=True) if o.output == "json" else F.col("text")["content"]
        return max(worst, _told(rows.withColumn("line", show), o, out, err))
    if not o.dry_run:
        known = engine.stored(engine.replayed(docs), "known")
        again = known.where("state <> 'process'")
        worst = max(worst, _replay(engine, again, o, out, err))
        docs = known.where("state = 'process'").drop("state", "inside", "trace", "record", "unusable")
    rows = engine.plan(docs)
    if o.dry_run or o.no_file:
        rows = rows.withColumn("archive", nothing).withColumn("action", report.action(F.col("disposition"), F.lit(False), dry_run=o.dry_run, no_file=o.no_file))
    else:
        rows = engine.execute(rows, archive=not o.no_archive).withColumn("dest", F.coalesce("final_dest", "dest"))
    if o.output == "json":
        return max(worst, _told(rows.withColumn("line", report.output_json(rows)), o, out, err))
    c = F.col
    cells = [file_name(c("path")), report.or_dash(report.destination(c("action"), c("dest"))), report.or_dash(c("metadata")["type"]), report.or_dash(F.array_join(c("metadata")["tags"], ", "))]
    rows = rows.withColumns({f"cell{k}": x for k, x in enumerate(cells)})
    if o.dry_run:
        rows = rows.withColumn("detail", report.detail_of(rows))
    rows = engine.stored(rows.withColumn("note", report.archive_note(c("archive"))), "told")
    widths = rows.where(_GOOD).agg(*[F.max(F.length(f"cell{k}")) for k in range(3)]).first()
    widths = [max(len(name), n or 0) for name, n in zip(_HEADINGS, widths, strict=False)]
    aligned = lambda cells: F.concat(*[F.rpad(x, n + 2, " ") for x, n in zip(cells, widths, strict=False)], cells[-1])
    out.write("".join(name.ljust(n + 2) for name, n in zip(_HEADINGS, widths, strict=False)) + _HEADINGS[-1] + "\n")
    return max(worst, _told(rows.withColumn("line", aligned([c(f"cell{k}") for k in range(4)])), o, out, err))


_HEADINGS = ("SOURCE", "DEST", "TYPE", "TAGS")
_GOOD = "error_kind IS NULL OR error_kind = 'archive'"


def _told(rows: DataFrame, o, out, err) -> int:
    """Print each row's line, note, detail and error. Returns the exit code."""
    more = [F.col(k) if k in rows.columns else F.lit(None).alias(k) for k in ("note", "detail")]
    worst = 0
    for r in rows.select("path", "line", "error_kind", "error_msg", "archive", *more).toLocalIterator():
        if r["error_kind"] in (None, "archive", "trace") and r["line"] is not None:
            out.write(r["line"] + "\n")
            if r["note"]:
                out.write(f"\n{r['note']}\n")
            if r["detail"]:
                wide = max(len(d["label"]) for d in r["detail"])
                out.write("\n" + "".join(f"{d['label']:<{wide}}  {d['value']}\n" for d in r["detail"]) + "\n")
        worst = max(worst, _complained(r, o, err))
    return worst


def _complained(r, o, err) -> int:
    """A row's error on ``err``, and under ``--quiet`` what its failed command has said, which
    otherwise was heard while it ran; its exit code."""
    if o.quiet and r["archive"]["output"] and not r["archive"]["success"]:
        for line in r["archive"]["output"].rstrip("\n").split("\n"):
            err.write(f"{o.command}| {line.removesuffix(chr(13))}\n")
    if r["error_kind"] is None:
        return 0
    err.write(f"folioflow: {r['path']}: {r['error_kind']}: {r['error_msg']}\n")
    return EXIT_CODES.get(r["error_kind"], 1)


def _replay(engine: Engine, again: DataFrame, o, out, err) -> int:
    """Hand off what was filed but not handed off; nothing is extracted, asked or moved."""
    rows = again.select("path", "digest", F.col("inside").alias("final_dest"), F.col("record.metadata").alias("metadata"), F.col("record.rule").alias("rule"), "state", F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("string").alias("error_msg"), F.col("record.source").alias("source"), F.col("record.filed_at").alias("filed_at"), F.col("record.truncation").alias("truncation"))
    todo = rows.where("state = 'hand-off'") if not o.no_archive else rows.where("false")
    done = engine.stored(engine.handed_off(todo), "replayed")
    body = trace_json(F.col("source"), F.col("digest"), F.col("metadata"), F.col("rule"), F.col("filed_at"), F.col("truncation"), F.col("archive"))
    done = engine.traced(done, done.select("path", "final_dest", body.alias("trace")), "replayed-traces")
    for r in rows.select("path", "final_dest", "state").toLocalIterator():
        log.info("%s is filed at %s: %s", r["path"], r["final_dest"], r["state"])
    return max((_complained(r, o, err) for r in done.select("path", "archive", "error_kind", "error_msg").toLocalIterator()), default=0)


if __name__ == "__main__":
    sys.exit(main())
