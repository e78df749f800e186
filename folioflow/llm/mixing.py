"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a shuffled order that depends only on the seed and the
document's id. A copy of a document finishes at the virtual time (tokens of its source up to
and with it) / (target of its source), so all sources reach their targets at time 1. Copies
are sorted by that time over all sources and cut at the total budget. Since a source's
copies are taken in its own order, the cut is one boundary for each source and epoch, which
is joined to the documents by source; texts are never shuffled.

Defined cases: a null text has size 0; null sources form one source, sorted last; a null
doc_id is ordered as the empty text; repeated rows are taken or left together; an empty
table gives an empty result; a source of size 0 gets target 0 and nothing is taken of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, store
from .prefix import running_total

WEIGHTS = (3, 1, 2)


def fair_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): ``share`` of all sizes dealt by weight,
    none over ``most`` times its own size, the excess dealt again by weight.

    Sorted by size for weight, the sources before some place are full and the rest share
    what is left; that place is the first whose share fits. One row a source goes through
    the windows, never one a document.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("source_rank", F.row_number().over(named) - 1)
    ranked = ranked.withColumn("_weight", F.element_at(cycle, F.col("source_rank") % len(weights) + 1)).withColumn("_most", F.lit(float(most)) * F.col("source_size"))
    order = [F.col("_most") / F.col("_weight"), F.col("source_rank")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(rest))
        .withColumn("_fits", F.col("_weight") * F.col("_left") / F.col("_rest") <= F.col("_most"))
    )
    level = F.first(F.when(F.col("_fits"), F.struct("_left", "_rest")), ignorenulls=True).over(whole)
    open_ = F.coalesce(F.max(F.col("_fits")).over(before.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    return filled.withColumn("_level", level).select(
        "source", "source_rank", "source_size", F.when(open_, F.col("_weight") * F.col("_level._left") / F.col("_level._rest")).otherwise(F.col("_most")).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """The plan of a mix of ``docs`` (doc_id, text, source).

    Returns the light rows (doc_id, source, size, shuffle_key), stored, and the boundaries,
    one row a source: source, source_rank, source_size, target, and ``bounds``, an array with
    for each epoch the last (shuffle_key, size) taken, null where none is. The number of
    epochs is ``most``, a constant, whole and small.
    """
    light = store(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("shuffle_key")), "sizes")
    targets = store(fair_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(most)), "targets")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    ranked = light.join(targets, light["source"].eqNullSafe(targets["source"])).select("source_rank", "shuffle_key", "size", "source_size", "target")
    own = running_total(ranked, ["source_rank"], ["shuffle_key", "size"], "size")
    copies = own.where("target > 0").select(
        "source_rank", "shuffle_key", "size", "source_size", "target", "before", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch")
    )
    finish = (F.col("before") + F.col("size") + F.col("epoch") * F.col("source_size")) / F.col("target")
    queue = running_total(copies.select("source_rank", "shuffle_key", "size", "epoch", finish.alias("finish")), [], ["finish", "source_rank", "epoch", "shuffle_key", "size"], "size", "passed")
    taken = queue.where(F.col("passed") + F.col("size") <= F.lit(budget))
    last = taken.groupBy("source_rank", "epoch").agg(F.max(F.struct("shuffle_key", "size")).alias("bound"))
    bounds = last.groupBy("source_rank").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "bound"))).alias("_by"))
    bounds = targets.join(bounds, "source_rank", "left").select(
        "source", "source_rank", "source_size", "target", F.array(*[F.try_element_at("_by", F.lit(e)) for e in range(most)]).alias("bounds")
    )
    return light, store(bounds, "bounds")


def shuffle_key(doc_id, seed: str = ""):
    """The place of a document in its source's shuffled order."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def with_copies(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add source_size, target and n_copies to rows that have source, shuffle_key and size.
    The bounds are one row a source; Spark broadcasts them only below its size threshold."""
    marks = bounds.select(F.col("source").alias("_source"), "source_size", "target", "bounds")
    here = F.struct("shuffle_key", "size")
    return (
        rows.join(marks, rows["source"].eqNullSafe(marks["_source"]), "left")
        .withColumn("n_copies", F.size(F.filter("bounds", lambda b: b.isNotNull() & (here <= b))).cast("long"))
        .drop("_source", "bounds")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    _, bounds = mix(docs, weights, share, most, seed)
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keyed = own.withColumns({"source": F.col(names["source"]), "size": n_words(F.col(names["text"])), "shuffle_key": shuffle_key(F.col(names["doc_id"]), seed)})
    taken = with_copies(keyed, bounds).where("n_copies > 0")
    again = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    return again.select(*[F.col(n).alias(c) for c, n in names.items()])


# ---------------------------------------------------------------- query


def op3_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    light, bounds = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_copies(light, bounds).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1 AS r FROM src),
weighed AS (SELECT *, (ARRAY[3.0, 1.0, 2.0])[r % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM ranked),
filled AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM src) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER o AS i
  FROM weighed WINDOW o AS (ORDER BY most / w, r)),
level AS (SELECT i, remaining, rest FROM filled WHERE w * remaining / rest <= most ORDER BY i LIMIT 1),
targets AS (
  SELECT f.source, f.r, f.source_size, CASE WHEN f.i >= l.i THEN f.w * l.remaining / l.rest ELSE f.most END AS target
  FROM filled f CROSS JOIN level l),
own AS (
  SELECT s.doc_id, s.size, s.k, t.r, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY t.r ORDER BY s.k, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT o.*, e.epoch, (o.upto + e.epoch * o.source_size) / o.target AS finish
  FROM own o CROSS JOIN (VALUES (0), (1)) e(epoch) WHERE o.target > 0),
passed AS (SELECT *, sum(size) OVER (ORDER BY finish, r, epoch, k, size ROWS UNBOUNDED PRECEDING) AS total FROM queue),
taken AS (
  SELECT doc_id, k, r, size, count(*) AS n FROM passed
  WHERE total <= (SELECT sum(target) FROM targets) GROUP BY ALL)
SELECT o.doc_id, o.size, o.source_size, o.target, (o.size * coalesce(t.n, 0))::BIGINT AS taken
FROM own o LEFT JOIN taken t ON o.doc_id = t.doc_id AND o.k = t.k AND o.r = t.r AND o.size = t.size
"""
