"""What Python workers need: the package on their path, and work in small pieces."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import SparkSession

#: Rows and bytes of a piece.
ROWS, BYTES = 256, 4 << 20
_HOME = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Workers get the folder that this package was imported from on their path, also where
    the driver reached it through ``sys.path`` alone. On a cluster the package has to be
    installed on, or shipped to, the executors; a path that isn't there does no harm."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, _HOME])


def pieces(batches: Iterable[pa.RecordBatch], *bulky: str, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, whose ``bulky`` columns of texts or bytes hold
    ``most`` bytes together, or one larger row. What a worker makes of a batch is then as small,
    whatever Spark sends at a time."""
    for batch in batches:
        if batch.num_rows == 0:
            yield batch
        sizes = [0] * batch.num_rows
        for k in bulky:
            sizes = [n + (x or 0) for n, x in zip(sizes, pa.compute.binary_length(batch.column(k)).to_pylist(), strict=True)]
        start = held = 0
        for at, n in enumerate(sizes):
            if at > start and (at - start == rows or held + n > most):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
