"""What is left to do for documents that were seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.inventory import outstanding


def replay_state(inside: Column, record: Column, archiver_configured: bool) -> Column:
    """done: filed and handed off; hand-off: only that is left; outstanding: it is left and no
    command is configured; process: everything, as for a document without a usable trace."""
    left = F.lit("hand-off") if archiver_configured else F.lit("outstanding")
    return F.when(~inside | record.isNull(), F.lit("process")).when(~outstanding(record["archive"]), F.lit("done")).otherwise(left)


def not_yet_filed(docs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Documents whose content the inventory doesn't have: an anti-join by digest before any
    text is extracted, since everything behind it costs more."""
    return docs.join(inventory.select(F.col("source_digest").alias("digest")).distinct(), "digest", "left_anti")


def destination_inside(path: Column, root: str) -> Column:
    """A path's name inside the archive, null if it lies outside."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)) & (F.length(path) > len(base)), F.substr(path, F.lit(len(base) + 1)))
