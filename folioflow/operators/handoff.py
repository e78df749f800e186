"""Hand-off to an external command: arguments, run, captured outcome.

Arguments are array expressions, one element a template, so no shell is involved. Commands run
in Arrow batches; a task that is run again runs its commands again, so the outcome belongs
in the inventory before the next run asks what is outstanding.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import threading
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..channel import MOST, Address, tell
from ..functions.normalise import date_prefix
from ..functions.text import OUTPUT_BYTES, OUTPUT_MARK
from ..processes import guarded, kill_group
from .rules import Template

#: Seconds until a command is stopped, and until its streams are given up after.
TIMEOUT, WAIT_DELAY = 60.0, 5.0
RESULT = ("attempted", "success", "exit_code", "output", "error", "attempted_at")


def argument_values(path: Column, metadata: Column) -> dict[str, Column]:
    """What argument templates may name: the values as they are, absent ones empty."""
    text = lambda k: F.coalesce(metadata[k], F.lit(""))
    return {
        "Path": path,
        "Title": text("title"),
        "Type": text("type"),
        "Correspondent": text("correspondent"),
        "Reference": text("reference"),
        "Description": text("description"),
        "Amount": text("amount"),
        "Currency": text("currency"),
        "Tags": F.concat(F.lit("["), F.array_join(metadata["tags"], " "), F.lit("]")),
        "DocumentDate": date_prefix(metadata["document_date"]),
        "DueDate": date_prefix(metadata["due_date"]),
    }


def arguments(args: Sequence[Template], each_tag: Sequence[Template], path: Column, metadata: Column) -> Column:
    """The argument list: each template once, then all templates of tags for every tag."""
    values = argument_values(path, metadata)
    own = F.array(*[t.rendered(values) for t in args]) if args else F.array().cast("array<string>")
    if not each_tag:
        return own
    tags = F.coalesce(metadata["tags"], F.array().cast("array<string>"))
    return F.concat(own, F.flatten(F.transform(tags, lambda tag: F.array(*[t.rendered({"": tag}) for t in each_tag]))))


@dataclass(frozen=True)
class Command:
    name: str
    timeout: float = TIMEOUT
    env: tuple[str, ...] = ()
    #: Where lines go while the command runs.
    echo: Address | None = None
    environ: Mapping[str, str] | None = field(default=None, repr=False)

    def environment(self) -> dict[str, str]:
        """The ambient environment and, by name, what the command needs; secrets travel here."""
        out = dict(os.environ)
        out |= {k: v for k, v in (self.environ or os.environ).items() if k in self.env}
        return out

    def run(self, argv: Sequence[str]) -> dict:
        """Run once. Every failure is part of the outcome; the time is in seconds since 1970."""
        out = {"attempted": True, "success": False, "exit_code": None, "output": None, "error": None, "attempted_at": time.time()}
        path = shutil.which(self.name)
        if path is None:
            return out | {"error": f"{self.name} is not installed or not on PATH"}
        try:
            with guarded([path, *argv], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, env=self.environment()) as process:
                capture = _Capture(process.stdout, f"{os.path.basename(self.name)}| ".encode(), self.echo)
                try:
                    code = process.wait(self.timeout)
                except subprocess.TimeoutExpired:
                    kill_group(process.pid)
                    process.wait()
                    out["error"] = f"{self.name} did not finish within {self.timeout:g} s and its process group was killed"
                    code = None
                out["output"] = capture.text() or None
        except (OSError, ValueError) as e:
            return out | {"error": f"{self.name}: {e}"}
        if code == 0:
            out |= {"success": True, "exit_code": 0}
        elif code is not None and code > 0:
            out |= {"exit_code": code, "error": f"{self.name} exited {code}"}
        elif code is not None:
            out["error"] = f"{self.name}: signal {-code}"
        return out


class _Capture:
    """Reads a stream to its end in the background, keeps a bounded head, echoes lines."""

    def __init__(self, stream, prefix: bytes, echo: Address | None):
        self.head, self.more, self.prefix, self.echo, self.rest = b"", False, prefix, echo, b""
        self.thread = threading.Thread(target=self._read, args=(stream,), daemon=True)
        self.thread.start()

    def _read(self, stream) -> None:
        while piece := stream.read1(1 << 16):
            left = OUTPUT_BYTES - len(self.head)
            self.head += piece[:left]
            self.more |= len(piece) > left
            if self.echo is not None:
                *lines, self.rest = (self.rest + piece).split(b"\n")
                if len(self.rest) > MOST:
                    lines, self.rest = [*lines, self.rest], b""
                for line in lines:
                    tell(self.echo, self.prefix + line.removesuffix(b"\r"))
        if self.echo is not None and self.rest:
            tell(self.echo, self.prefix + self.rest.removesuffix(b"\r"))

    def text(self) -> str:
        self.thread.join(WAIT_DELAY)
        return self.head.decode("utf-8", "replace") + (OUTPUT_MARK if self.more else "")


def run_commands(rows: DataFrame, command: Command, argv: str = "argv", result: str = "archive") -> DataFrame:
    """Add the struct ``result`` to rows with an array ``argv``. Only the arguments reach
    Python; the function is marked as not deterministic, so that plans run it once a row."""
    from ..plans.schema import ARCHIVE

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for given in batches:
            yield pd.DataFrame([command.run(list(a)) for a in given], columns=list(RESULT), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    told = F.pandas_udf(run, ARCHIVE.replace("timestamp", "double")).asNondeterministic()
    rows = rows.withColumn("_told", told(F.col(argv)))
    whole = F.struct(*[(F.timestamp_seconds(F.col("_told")[k]) if k == "attempted_at" else F.col("_told")[k]).alias(k) for k in RESULT])
    return rows.withColumn(result, whole.cast(ARCHIVE)).drop("_told")


def not_attempted() -> Column:
    from ..plans.schema import ARCHIVE

    return F.struct(F.lit(False).alias("attempted"), F.lit(False).alias("success"), *[F.lit(None).alias(k) for k in ("exit_code", "output", "error", "attempted_at")]).cast(ARCHIVE)
