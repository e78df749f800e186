"""Exact top-k search by inner product over an impact-ordered index, score at a time.

The index. Candidates are dealt over shards of at most 8,192 rows. In a shard each dimension
has a posting list: its rows ordered by component, which is quantised to a level; the run of
one level is a segment. A segment's impact on a query is bounded by the query's component
times the level's end, so a list is read from one end for positive components and from the
other for negative ones, impact falling. The index has a row for every shard, stored in the
shared folder, and keeps the components themselves for rescoring.

The search. A block of queries, of at most 8,192 rows and 16 MB, is broadcast. In each shard a
query reads segments of all dimensions by descending impact, adding each to its rows'
accumulators. After each round it knows for every row a bound: the impacts seen, and for what
isn't seen the largest impact left. Exact scores of the rows that lead give a score that the
k-th best has at least, and so do the shards the task has searched before. Rows whose
bound doesn't reach it are proven out. The query stops when rescoring all others takes no more
steps than the postings that are unread, or when all are read; those others are then rescored
exactly. Nothing else ends a search, so the result is exact whatever the data; where vectors
are alike in no dimension most segments are read. Best lists of shards merge to the result.

Memory is a shard, a block of queries and k rows a query, also where a third of all vectors
are equal. A block's result is written before the next begins.

Defined cases: rows with a null vec_id or vector, or with a null or non-finite component,
take no part; a vector that is shorter than another counts as ending in zeros, an empty one
has score 0 with all; equal scores go to the smaller vec_id; rows that repeat a vec_id are
candidates each, and queries each, but none is a candidate of a query of its own vec_id; a
query without candidates has no row; components so large that a score may not fit 64 bits
are an error; an empty table gives an empty result; other columns don't take part, whatever
their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch_path, store
from .vectors import BLOCK_ROWS, Best, even, gathered, map_vectors, packed, quantised, unpacked, usable

K = 5
SHARD_ROWS = 8192
#: Levels that a dimension's components are quantised to in a shard, at most.
LEVELS = 32
#: Times that a search stops to look what is proven.
ROUNDS = 8
_SAFE = float(1 << 61)
_INDEX = "n long, ids binary, components binary, rows binary, step binary"


def indexed(candidates: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of (vec_id, embedding), a row for each shard: ids and components of its rows,
    and by dimension the rows in the order of their levels and the width of a level."""

    def build(batches):
        for b in gathered(batches, shard_rows):
            ids, x = b.column("vec_id").to_numpy(), quantised(b.column("embedding"))
            if np.abs(x).max(initial=0.0) >= _SAFE:
                raise OverflowError("components are too large for 64-bit scores")
            x = x.astype(np.int64)
            step = (np.ptp(x, axis=0) // LEVELS + 1) if x.size else np.ones(x.shape[1], np.int64)
            rows = np.argsort(x // step, axis=0, kind="stable").T.astype(np.int32)
            yield {"n": [len(ids)], "ids": [ids.tobytes()], "components": [x.tobytes()], "rows": [rows.tobytes()], "step": [step.tobytes()]}

    return map_vectors(even(candidates, shard_rows), build, _INDEX)


class Shard:
    """The posting lists of a shard, ready to be searched."""

    def __init__(self, row: dict):
        self.n, self.ids = row["n"], np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["components"], np.int64).reshape(self.n, -1)
        self.width = self.x.shape[1]
        step = np.frombuffer(row["step"], np.int64)
        rows = np.frombuffer(row["rows"], np.int32).reshape(self.width, self.n)
        self.least, self.most = self.x.min(axis=0), self.x.max(axis=0)
        self.large = np.abs(self.x).max(initial=0)
        # segments from the low end and from the high end: rows, and of each segment where it begins and its level's ends
        self.sides = []
        for d in range(self.width):
            order = rows[d].astype(np.intp)
            level = self.x[order, d] // step[d]
            first = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
            ends = np.append(first, self.n)
            low = np.maximum(level[first] * step[d], self.least[d])
            high = np.minimum((level[first] + 1) * step[d] - 1, self.most[d])
            back = self.n - ends[::-1]
            self.sides.append(((order, ends, low, high), (order[::-1].copy(), back, low[::-1], high[::-1])))
        most = max((len(s[0][2]) for s in self.sides), default=0)
        self.ends = np.full((2, self.width, most + 1), self.n)
        self.low, self.high = (np.zeros((2, self.width, most), np.int64) for _ in range(2))
        self.segments = np.array([len(s[0][2]) for s in self.sides])
        for d, both in enumerate(self.sides):
            for side, (_, ends, low, high) in enumerate(both):
                self.ends[side, d, : len(ends)] = ends
                self.low[side, d, : len(low)], self.high[side, d, : len(high)] = low, high

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the rows that may be among the ``k`` best of a query, all those that
        are and reach ``floor`` included."""
        w = min(self.width, len(q))
        q = q[:w].astype(np.int64)
        others = self.ids != own
        alive = np.count_nonzero(others)
        if not w or not alive:
            return self.ids[others], np.zeros(alive, np.int64)
        if float(np.abs(q).max()) * float(self.large) * 2 * w >= _SAFE:
            raise OverflowError("components are so large that an inner product may not fit 64 bits")
        at, side = np.arange(w), (q > 0).astype(int)
        worst = np.minimum(q * self.least[:w], q * self.most[:w])
        # what a segment adds at most, above the worst that its dimension can do
        impact = np.where(q > 0, q, 0)[:, None] * self.high[side, at] + np.where(q < 0, q, 0)[:, None] * self.low[side, at] - worst[:, None]
        segment = np.arange(impact.shape[1])
        there = segment < self.segments[:w, None]
        impact[~there] = -1
        best = impact[:, 0]
        sizes = np.diff(self.ends[side, at], axis=1)
        ranked = np.sort(impact[there])[::-1]
        weight = np.cumsum(sizes[there][np.argsort(-impact[there], kind="stable")])
        stops = np.unique(ranked[np.minimum(np.searchsorted(weight, weight[-1] * np.arange(1, ROUNDS + 1) / ROUNDS), len(ranked) - 1)])[::-1]

        base = int(worst.sum())
        # an accumulator holds a row's impacts and, in its low bits where they fit, how often it was seen
        unit = 1 << w.bit_length()
        if float(best.sum()) * unit >= _SAFE:
            unit = 0
        sums, seen = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        done = np.zeros(w, np.int64)
        bound = None
        for stop in stops:
            upto = (impact >= stop).sum(axis=1)
            new = (segment >= done[:, None]) & (segment < upto[:, None])
            rows = np.concatenate([self.sides[d][side[d]][0][begin:end] for d, begin, end in zip(at, self.ends[side, at, done], self.ends[side, at, upto], strict=True)])
            np.add.at(sums, rows, np.repeat(impact[new] * unit + 1 if unit else impact[new], sizes[new]))
            if not unit:
                np.add.at(seen, rows, 1)
            done = upto
            total = sums
            if unit:
                total, seen = sums // unit, sums % unit
            active = done > 0
            open_ = active & (done < self.segments[:w])
            left = int(impact[open_, done[open_]].max(initial=0))
            bound = total + (int(active.sum()) - seen) * left + (base + int(best[~active].sum()))
            bound[~others] = np.iinfo(np.int64).min
            if alive > k:
                lead = np.argpartition(bound, self.n - k)[self.n - k :]
                floor = max(floor, int((self.x[lead, :w] @ q).min()))
            unread = self.n * w - int(self.ends[side, at, done].sum())
            if np.count_nonzero(bound >= floor) * w <= unread:
                break
        may = np.flatnonzero((bound >= floor) & others)
        return self.ids[may], self.x[may, :w] @ q


def searched(index: DataFrame, block: tuple, k: int) -> DataFrame:
    """(slot, score, vec_id) of the best ``k`` of each query of a block, by task."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        ids, _, x = sent.value
        best = Best(len(ids), k)
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                for j, own in enumerate(ids):
                    got, scores = shard.search(x[j], own, k, best.least[j])
                    best.offer(np.full(len(got), j), scores, got)
                best.settle()
        yield {"slot": best.slot, "score": best.score, "vec_id": best.id}

    return map_vectors(index, search, "slot long, score long, vec_id long", rows=1)


def nearest(rows: DataFrame, queries: Column, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``rows`` (vec_id, embedding) for which the
    condition holds the ``k`` rows of the highest inner product, its own left out."""
    spark = rows.sparkSession
    candidates = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    index = store(indexed(candidates, shard_rows), "impact-index")
    blocks = store(packed(candidates.where(queries).withColumn("label", F.lit(0)), block_rows), "queries")
    path, schema = scratch_path(spark, "nearest"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=-1")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    for number, row in enumerate(blocks.toLocalIterator()):
        block = unpacked(row)
        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(block[0])], "slot long, query_id long")
        merged = searched(index, block, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        merged.join(names, "slot").select("query_id", "rank", "vec_id", "score").write.mode("overwrite").parquet(f"{path}/block={number}")
    discard(index, blocks)
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")


# ---------------------------------------------------------------- query


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER w)::INTEGER AS rank, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 5
"""
