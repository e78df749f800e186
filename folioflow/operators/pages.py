"""Scanned documents page by page: pages fan out, are transcribed side by side, and come back.

A scan of twenty pages is twenty calls. Made one after another in the task that has the
document they would hold it up, and one failure would repeat them all. Here they are rows:

1. Extraction as usual, but where pages have to be looked at it only says how many. It is
   stored, and of the contents only those that are looked at, so no document is opened twice.
2. A table function renders the pages of a document; the images are dealt over all tasks, each
   document's too, and stored.
3. Pages are transcribed, a bounded number at a time in each task. With a ``ReplyStore`` each
   page's text is kept as it comes, so what starts over asks only for the pages that failed.
4. Pages are gathered in their order. A page that failed for good is its document's error, the
   first one if there are several.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mime as M
from ..functions.text import is_blank
from ..workers import importable
from .analyse import WINDOW, ReplyStore
from .extract import LATER, TEXT_SCHEMA, Failure, Tools, rendered_page, transcribed, with_text

_TOLD = "id long, page int, said string, error_kind string, error_msg string"


def page_images(tools: Tools):
    """A table function (mime, content, pages) to (page, media, image, error_kind, error_msg)."""

    class Pages:
        def eval(self, mime: str, content: bytes, pages: int) -> Iterator[tuple]:
            if mime != M.PDF:
                yield 1, mime, content, None, None
                return
            with tempfile.TemporaryDirectory() as folder:
                path = Path(folder, "in.pdf")
                path.write_bytes(content)
                for page in range(1, pages + 1):
                    try:
                        yield page, "image/png", rendered_page(path, page, tools), None, None
                    except Failure as e:
                        yield page, None, None, e.kind, str(e)

    return F.udtf(Pages, returnType="page int, media string, image binary, error_kind string, error_msg string")


def transcripts(pages: DataFrame, tools: Tools, replies: ReplyStore | None, window: int = WINDOW) -> DataFrame:
    """(id, page, said, error_kind, error_msg) of rows (id, page, media, image, error_kind, error_msg)."""

    def told(media: str | None, image: bytes | None, kind: str | None, message: str | None) -> tuple:
        if kind is not None:
            return None, kind, message
        try:
            key = hashlib.sha256(f"page {media} ".encode() + image).hexdigest() if replies else None
            said = replies.get(key) if key else None
            if said is None:
                said = transcribed(tools, media, image)
                if key:
                    replies.put(key, said)
            return said, None, None
        except Failure as e:
            return None, e.kind, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max(1, window)) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 4 * window):
                    part = batch.slice(at, 4 * window)
                    got = list(pool.map(told, *(part.column(k).to_pylist() for k in ("media", "image", "error_kind", "error_msg"))))
                    columns = [part.column("id"), part.column("page"), *(pa.array([g[k] for g in got], pa.string()) for k in range(3))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "page", "said", "error_kind", "error_msg"])

    return pages.mapInArrow(run, _TOLD)


def gathered(told: DataFrame) -> DataFrame:
    """(id, said, error_kind, error_msg): the texts of each document's pages in their order, and the
    error of the first page that has one."""
    page = F.struct("page", F.coalesce("said", F.lit("")).alias("said"))
    failed = F.min(F.when(F.col("error_kind").isNotNull(), F.struct("page", "error_kind", "error_msg"))).alias("e")
    each = told.groupBy("id").agg(F.array_sort(F.collect_list(page)).alias("pages"), failed)
    return each.select("id", F.array_join(F.col("pages.said"), "\n\n").alias("said"), "e.error_kind", "e.error_msg")


def with_paged_text(docs: DataFrame, tools: Tools, store: Callable[[DataFrame, str], DataFrame], replies: ReplyStore | None = None) -> DataFrame:
    """As ``extract.with_text``, with pages that are looked at dealt over all tasks. ``store`` writes
    a table under a name and reads it back. Content is null of what wasn't looked at."""
    importable(docs.sparkSession)
    text = F.col("text")
    later = F.col("text")["error_kind"].eqNullSafe(F.lit(LATER))
    first = with_text(docs, replace(tools, vision=None, deferred=True)).withColumn("_id", F.monotonically_increasing_id())
    first = store(first.withColumn("content", F.when(later, F.col("content"))), "texts")
    seen = first.where(later).select(F.col("_id").alias("id"), "mime", "content", text["truncation"]["pages_processed"].alias("n"))
    images = seen.lateralJoin(page_images(tools)(F.col("mime").outer(), F.col("content").outer(), F.coalesce(F.col("n"), F.lit(1)).outer())).drop("mime", "content", "n")
    images = store(images.repartition(docs.sparkSession.sparkContext.defaultParallelism), "page-images")
    told = store(transcripts(images, tools, replies), "transcripts")
    whole = gathered(told).select(F.col("id").alias("_id"), F.struct("said", "error_kind", "error_msg").alias("_seen"))
    rows = first.join(whole, "_id", "left")
    t, s = F.col("text"), F.col("_seen")
    cut = F.when(t["truncation"]["pages_processed"] < t["truncation"]["pages_total"], t["truncation"])
    blank = s["error_kind"].isNull() & is_blank(s["said"])
    made = F.struct(
        F.when(s["error_kind"].isNull(), s["said"]).alias("content"),
        F.when(s["error_kind"].isNull(), F.lit("vision")).alias("origin"),
        F.when(s["error_kind"].isNull(), cut).alias("truncation"),
        F.when(blank, F.lit("empty")).otherwise(s["error_kind"]).alias("error_kind"),
        F.when(blank, F.lit("no text in the document")).otherwise(s["error_msg"]).alias("error_msg"),
    ).cast(TEXT_SCHEMA)
    return rows.withColumn("text", F.when(later, made).otherwise(t)).drop("_id", "_seen")
