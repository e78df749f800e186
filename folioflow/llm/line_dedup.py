"""Line dedup: the first document that holds a line keeps it, all others lose it.

Batches of ascending doc_id meet levelled sorted runs of line hashes. A batch's lines are
grouped by key first, so each key meets the runs once, however many rows have it; keys that
the runs don't have yet become a new run (a merge anti-join). What is left are the keys that
some document loses, with their first holder: stored, so that Spark splits the join of a very
common one to the batch's lines. Keys are 128-bit hashes. Only hashes and ids are shuffled by
key; texts meet the list of keys that their row loses once.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code points
never drop; a null doc_id counts as a document behind all others; rows of the same doc_id
are one document and keep each other's lines; a doc_id may be of any type that has an order;
texts of any length are taken whole; an empty table gives an empty result; other columns
don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import SPACE, discard, map_rows, maybe_among, signed, store
from .runs import Runs

MIN_CHARS = 10
#: Batches that a whole table is dealt into, by ranges of doc_id.
BATCHES = 4
_STRIP = SPACE.encode()


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is shorter than ``min_chars`` code points."""
    keys = [line.strip(_STRIP).lower() for line in (text or b"").split(b"\n")]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars) else None for k in keys]


def hashed_keys(keys: list[bytes | None]) -> list[int]:
    return [0 if k is None else xxhash.xxh3_128_intdigest(k) for k in keys]


def halves(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(v.to_bytes(16, "little") for v in values)
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return signed(both[:, 1].copy()), signed(both[:, 0].copy())


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(owner, row, hi, lo): for each row its doc_id, the hash of its text, and the arrays of its
    distinct line hashes."""

    def hashed(batches):
        for b in batches:
            his, los = [], []
            for text in b["text"]:
                hi, lo = halves(list({h for h in hashed_keys(line_keys(text, min_chars)) if h}))
                his.append(hi)
                los.append(lo)
            yield {"owner": b["doc_id"], "row": b["row"], "hi": his, "lo": los}

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), hashed, f"owner {dict(docs.dtypes)['doc_id']}, row long, hi array<long>, lo array<long>")


def batch_ranges(ids: DataFrame, batches: int) -> list:
    """Conditions that deal owners to ``batches`` ascending ranges of about as many rows each,
    null owners to the last; one range where owners aren't numbers."""
    owner, marks = F.col("owner"), []
    if batches > 1 and isinstance(ids.schema["owner"].dataType, NumericType):
        marks = sorted(set(ids.agg(F.percentile_approx("owner", [i / batches for i in range(1, batches)], 1000)).first()[0] or []))
    if not marks:
        return [F.lit(True)]
    inner = [(owner > low) & (owner <= high) for low, high in zip(marks, marks[1:], strict=False)]
    return [owner <= marks[0], *inner, owner.isNull() | (owner > marks[-1])]


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: Runs | None = None) -> DataFrame:
    """(owner, row, keys) of the rows that lose some; keys are (hi, lo).

    ``runs`` is an index with columns hi, lo, first_owner to go on from; its documents come
    before all of ``docs``.
    """
    keyed = store(document_keys(docs, min_chars), "line-keys")
    index = runs or Runs(docs.sparkSession, ["hi", "lo"], prefix="lines")
    lost = None
    owner, holder = F.col("owner"), F.col("holder")
    try:
        for of_batch in batch_ranges(keyed, batches):
            rows = keyed.where(of_batch).select("owner", "row", F.explode(F.arrays_zip("hi", "lo")).alias("k")).select("owner", "row", "k.hi", "k.lo")
            ends = [F.min("owner").alias("holder"), F.max("owner").alias("last"), F.max(owner.isNull()).alias("unnamed")]
            batch = store(rows.groupBy("hi", "lo").agg(*ends), "line-batch")
            new = store(index.absent(batch), "line-batch")
            shared = new.where((holder < F.col("last")) | (F.col("unnamed") & holder.isNotNull())).select("hi", "lo", "holder", F.lit(False).alias("earlier"))
            known = index.present(batch.select("hi", "lo"))
            if known is not None:
                shared = shared.unionByName(known.select("hi", "lo", F.col("first_owner").alias("holder"), F.lit(True).alias("earlier")))
            shared = store(shared, "line-holders")
            index.add(new.select("hi", "lo", F.col("holder").alias("first_owner")))
            loses = F.when(F.col("earlier"), ~holder.eqNullSafe(owner)).otherwise(owner.isNull() | (holder < owner))
            later = rows.join(shared, ["hi", "lo"]).where(loses)
            part = store(later.groupBy("owner", "row").agg(F.collect_set(F.struct("hi", "lo")).alias("keys")), "line-drops")
            lost = part if lost is None else lost.unionByName(part)
            discard(batch, new, shared)
    finally:
        if runs is None:
            index.drop()
        discard(keyed)
    return lost


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: Runs | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of each row of ``docs``."""
    lost = dropped_keys(docs, min_chars, batches, runs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    kind = dict(docs.dtypes)["doc_id"]

    def rebuilt(batches_):
        for b in batches_:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(b["text"], b["keys"], strict=True):
                text = text or b""
                if keys:
                    drop = {((k["hi"] & (2**64 - 1)) << 64) | (k["lo"] & (2**64 - 1)) for k in keys}
                    lines = text.split(b"\n")
                    left = [x for x, k in zip(lines, hashed_keys(line_keys(text, min_chars)), strict=True) if k not in drop]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                    kept.append(b"\n".join(left).decode())
                else:
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    kept.append(text.decode())
            yield {"doc_id": b["doc_id"], "n_lines": n_lines, "n_dropped": n_dropped, "kept_text": kept}

    same = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("own") == F.col("row"))
    loses = maybe_among([F.col("doc_id"), F.col("own")], lost.select("owner", "row"))
    whole = rows.where(~loses).select("doc_id", "text", F.lit(None).cast(lost.schema["keys"].dataType).alias("keys"))
    joined = whole.unionByName(rows.where(loses).join(lost, same, "left").select("doc_id", "text", "keys"))
    return map_rows(joined, rebuilt, f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")


# ---------------------------------------------------------------- query


def op9_lines(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines, dropped lines and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
first AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT lines.*, f.owner IS NOT NULL AND f.owner < doc_id AS dropped FROM lines LEFT JOIN first f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
