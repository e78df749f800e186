"""Integer vectors made of embeddings: reading, exact inner products, packed blocks, best-of lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SCALE = 256.0
#: Rows and bytes of a block that is broadcast, and rows of a tile of products.
BLOCK_ROWS, BLOCK_BYTES, TILE = 8192, 16 << 20, 1024
#: Below these a product is exact in float64 and fits a long.
_EXACT, _LONG = float(1 << 53), float(1 << 63)
#: Rows that wait for a merge, at least.
_WAIT = 1 << 16


def usable(rows: DataFrame) -> DataFrame:
    """The rows that have an id and a vector of finite components only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def quantised(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component as a float64 matrix; shorter vectors end in zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two integer-valued matrices, exact, as float64 where
    none can reach 2**53 and else as longs; OverflowError where one might not fit a long."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * w
    if most < _EXACT:
        return a @ b.T
    if most < _LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("components are so large that an inner product may not fit 64 bits")


def map_vectors(df: DataFrame, fn, schema: str, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` whose ``fn`` gets an iterator of record batches and yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        for got in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name]).cast(f.type) for f in arrow], schema=arrow)

    bound_batches(df.sparkSession, rows)
    return df.mapInArrow(run, out)


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``rows`` rows and about ``BLOCK_BYTES``."""
    held, n, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if held and (n + part.num_rows > rows or size > BLOCK_BYTES):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, size = [], 0, 0
            held.append(part)
            n, size = n + part.num_rows, size + part.nbytes
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def even(rows: DataFrame, each: int) -> DataFrame:
    """``rows`` dealt in turn over as many partitions as blocks of ``each`` rows need."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def packed(rows: DataFrame, each: int = BLOCK_ROWS) -> DataFrame:
    """(n, ids, labels, components) of blocks of (vec_id, label, embedding): one row a block,
    columns packed as binary values in the order of vec_id."""

    def pack(batches):
        for b in gathered(batches, each):
            ids, x = b.column("vec_id").to_numpy(), quantised(b.column("embedding"))
            order = np.argsort(ids, kind="stable")
            labels = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            yield {"n": [len(ids)], "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "components": [x[order].tobytes()]}

    return map_vectors(even(rows, each), pack, "n long, ids binary, labels binary, components binary")


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, matrix) of a packed block."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["components"]).reshape(row["n"], -1)


class Best:
    """The ``k`` best (score, id) of each slot: higher scores first, ties to the smaller id.
    Lists of parts of the candidates merge to that of all, so a task keeps k a slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The least score that a slot may still take.
        self.least = np.full(slots, -np.inf)
        self._waiting, self._n = [], 0

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self._waiting.append((slot, score.astype(np.int64), ids))
        self._n += len(slot)
        if self._n > max(_WAIT, len(self.slot)):
            self.settle()

    def offer_tile(self, slots: np.ndarray, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``scores`` are slots and columns candidates, of which those ``wanted`` count.
        Only what may be among the best k of this tile and of those before goes on."""
        wanted &= scores >= self.least[slots][:, None]
        if np.count_nonzero(wanted) > 2 * self.k * len(slots) and scores.shape[1] > self.k:
            inside = np.where(wanted, scores.astype(np.float64), -np.inf)
            # one step down, where rounding of scores beyond 2**53 might hide a tie
            wanted &= scores >= np.nextafter(np.partition(inside, -self.k, axis=1)[:, -self.k], -np.inf)[:, None]
        r, c = np.nonzero(wanted)
        if len(r):
            self.offer(slots[r], scores[r, c], ids[c])

    def settle(self) -> None:
        """Merge what waits into the lists."""
        if not self._waiting:
            return
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self._waiting, strict=True))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(first, append=len(slot)))
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[slot[place == self.k - 1]] = np.nextafter(score[last].astype(np.float64), -np.inf) if len(last) and np.abs(score[last]).max() >= _EXACT else score[last]
        by = np.concatenate([self.slot, *(w[0] for w in self._waiting)])
        self.slot, self.score, self.id = by[kept], score[kept], ids[kept]
        self._waiting, self._n = [], 0
