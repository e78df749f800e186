"""Hard-negative mining by blocked products.

Anchors are packed in blocks of at most 8,192 rows (and 16 MB), of which one at a time is
broadcast; each task multiplies it with its candidates, tile by tile, in float64, which is
exact below 2**53 (larger ones in 64-bit integers, and what may not fit those is an error).

1. First pass: each task keeps of every anchor the best positives it has met, five at most;
   such lists merge, so what a task sends doesn't grow with its rows.
2. The merged lists of one block, five rows an anchor, give each pair of anchor and positive
   its window of scores. Second pass: each task keeps of every pair the best negatives inside
   the window, which merge again.

The result of a block is written before the next one begins; a block that is run again
replaces its own. Work is anchors times candidates, as the exact result asks; memory is a
block, a tile and the lists, whatever the number of rows or the size of a label.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite
component, take no part; a vector that is shorter than another counts as ending in zeros, an
empty one has product 0 with all; equal scores go to the smaller vec_id; rows that repeat a
vec_id are candidates each, and anchors each, but none is a candidate of an anchor of its
own vec_id; an anchor without positives, or a pair without negatives, has no row; an empty
table gives an empty result; other columns don't take part, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch_path, store
from .vectors import BLOCK_ROWS, TILE, Best, map_vectors, packed, products, quantised, unpacked, usable

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these parts of the positive's.
LOW, HIGH = Fraction(30, 100), Fraction(90, 100)

_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _best(candidates: DataFrame, block, k: int, same: bool, windows=None) -> DataFrame:
    """(slot, score, vec_id) of the best ``k`` candidates of each slot, by task: of an anchor the
    rows of its label, or of each of its windows (least and most: anchors x windows) the
    rows of other labels."""
    sent = candidates.sparkSession.sparkContext.broadcast((block, windows))

    def multiply(batches):
        (ids, labels, x), bounds = sent.value
        each = 1 if bounds is None else bounds[0].shape[1]
        best = Best(len(ids) * each, k)
        for b in batches:
            cand, kinds, y = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), quantised(b.column("embedding"))
            for at in range(0, len(ids), TILE):
                part = slice(at, at + TILE)
                scores = products(x[part], y)
                meet = (labels[part, None] == kinds) == same
                meet &= ids[part, None] != cand
                slots = np.arange(at, at + len(scores)) * each
                for j in range(each):
                    inside = meet.copy()
                    if bounds is not None:
                        least, most = (bound[part, j, None] for bound in bounds)
                        inside &= (scores >= least) & (scores <= most)
                    best.offer_tile(slots + j, scores, inside, cand)
        best.settle()
        for at in range(0, len(best.slot), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield {"slot": best.slot[part], "score": best.score[part], "vec_id": best.id[part]}

    return map_vectors(candidates, multiply, "slot long, score long, vec_id long")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: Fraction = LOW, high: Fraction = HIGH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows``
    (vec_id, label, embedding), the anchors being those for which the condition holds.

    An anchor's positives are its best other rows of the same label; of the rows of other
    labels whose score lies between ``low`` and ``high`` times the positive's, the best are
    the negatives, ranked from 1."""
    spark = rows.sparkSession
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    candidates = usable(typed).where(F.col("label").isNotNull())
    blocks = store(packed(candidates.where(anchors), block_rows), "anchors")
    path = scratch_path(spark, "mined")
    spark.createDataFrame([], _MINED).write.parquet(f"{path}/block=-1")
    for number, row in enumerate(blocks.toLocalIterator()):
        block = unpacked(row)
        found = _merged(_best(candidates, block, positives, same=True), positives).collect()
        scores, ids = np.zeros((len(block[0]), positives), np.int64), np.zeros((len(block[0]), positives), np.int64)
        least, most = np.ones_like(scores), np.zeros_like(scores)
        for r in found:
            at = (r["slot"], r["rank"] - 1)
            scores[at], ids[at] = r["score"], r["vec_id"]
            least[at], most[at] = -(-low.numerator * r["score"] // low.denominator), high.numerator * r["score"] // high.denominator
        pairs = spark.createDataFrame(
            [(r["slot"] * positives + r["rank"] - 1, int(block[0][r["slot"]]), r["vec_id"], r["score"]) for r in found], "slot long, anchor_id long, positive_id long, positive_score long"
        )
        got = _merged(_best(candidates, block, negatives, same=False, windows=(least, most)), negatives)
        told = got.join(pairs, "slot").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        told.write.mode("overwrite").parquet(f"{path}/block={number}")
    discard(blocks)
    return spark.read.schema(f"{_MINED}, block int").parquet(path).drop("block")


# ---------------------------------------------------------------- query


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels being moved on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
