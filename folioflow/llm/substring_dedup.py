"""Substring dedup over a log-structured fingerprint index.

Every window of 35 words is named by its least hash of 12 words: equal windows have equal
names, and neighbouring windows mostly share theirs, so a text has one name for about twelve
words. Names are the fingerprints that the index holds.

1. One pass gives each row its number of words, the SHA-256 of its word sequence, and its
   names, apart those met at one place and at several places of the text.
2. Rows with one word sequence, told by 128 bits of the digest, are one class. A class of two
   rows or more loses all words if it has a window at all; its windows still count against
   others.
3. Batch by batch the classes' names are merge-joined to the index's sorted runs: a name that
   a run has, or that the batch has twice, is a suspect; new names become a new run; runs of
   a level are compacted.
4. Verification: windows whose name is a suspect are hashed anew, all 35 words, by two
   independent 64-bit hashes, of which one mixes at every step so that no pattern of words
   cancels out. They are counted over all classes, within the tasks first; those met twice
   are confirmed, stored, and joined to the windows, a join that Spark splits where one
   passage has a great part of all rows.
5. The words that confirmed windows cover are removed. A text that has suspects moves once, to
   them, and is kept there by row until its confirmed windows come. Before the shuffle a bit
   filter of the rows with suspects passes over the others, but for the few that it can't tell
   apart; their digest is taken in the first pass.

With an ``index`` to go on from, history counts: the index holds (name, one, two) of every
different window of each earlier call, the two hashes being those of step 4. A call's names are
merge-joined to it; what it holds under them makes these names suspects and confirms the
windows that it has. The call's own windows then become a run under the name of its ``batch``.
Rows of earlier calls are not judged again. A call of the same batch, as after a failure of
whatever used its result, doesn't count what the former one has added and takes its place.

Defined cases: a null or blank text has no words, and its kept text is empty; texts shorter
than a window lose nothing; very long texts are taken whole, one at a time in a worker; equal
texts are ties that nobody wins, all lose their windows; rows of the same doc_id, or with a
null one, are judged as rows; a doc_id may be of any type; an empty table gives an empty
result; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, bucketed, discard, map_rows, maybe_among, signed, store, tree_hashes, word_hashes
from .runs import Runs

WIDTH = 35
GRAM = 12
BATCHES = 4
_SALT = 0xD6E8FEB86659FD93
_ROW = ("nid", "th")
_CLASS = ("hi", "lo")


class Windows:
    """Names and hashes of a text's windows."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram, self.powers = width, gram, Powers()

    def grams(self, hashes: np.ndarray) -> np.ndarray:
        return self.powers.windows(hashes, self.gram)

    def names(self, grams: np.ndarray) -> np.ndarray:
        """The least hash of the grams inside each window."""
        span = self.width - self.gram + 1
        low, reach = grams, 1
        while 2 * reach <= span:
            low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
        return np.minimum(low[: len(low) - (span - reach)], low[span - reach :]) if span > reach else low

    def both(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tree_hashes(hashes, self.width, _SALT), self.powers.windows(hashes, self.width)


def named_rows(docs: DataFrame) -> DataFrame:
    """(nid, th, doc_id, text): rows with two hashes that name them, of the id and of the text;
    rows that are equal in both have the same name."""
    named = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(1), "text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(named.alias("nid"), F.xxhash64("text").alias("th"), "doc_id", "text")


def scanned(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(nid, th, doc_id, n_words, hi, lo, sha, once, often): the first pass over all rows."""
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches):
        w = Windows(width, gram)
        for b in batches:
            out = {k: [] for k in ("n_words", "hi", "lo", "sha", "once", "often")}
            for text in b["text"]:
                words = text.split() if text else []
                sha = hashlib.sha256(b" ".join(words)).digest()
                out["n_words"].append(len(words))
                out["hi"].append(int.from_bytes(sha[:8], "big", signed=True))
                out["lo"].append(int.from_bytes(sha[8:16], "big", signed=True))
                out["sha"].append(sha)
                once = often = np.zeros(0, np.uint64)
                if len(words) >= width:
                    grams = w.grams(word_hashes(text))
                    names = np.unique(w.names(grams))
                    place = np.searchsorted(names, grams)
                    place[place == len(names)] = 0
                    times = np.bincount(place[names[place] == grams], minlength=len(names))
                    once, often = names[times == 1], names[times > 1]
                out["once"].append(signed(once))
                out["often"].append(signed(often))
            yield {k: b[k] for k in (*_ROW, "doc_id")} | out

    return map_rows(named_rows(docs), scan, f"nid long, th long, doc_id {kind}, n_words long, hi long, lo long, sha binary, once array<long>, often array<long>")


def all_windows(docs: DataFrame, classes: DataFrame, width: int, gram: int) -> DataFrame:
    """(name, one, two) of each different window of the classes, for an index."""
    texts = named_rows(docs).drop("doc_id").join(classes.select(*_ROW), list(_ROW))

    def hashed(batches):
        w = Windows(width, gram)
        for b in batches:
            for text in b["text"]:
                hashes = word_hashes(text)
                one, two = w.both(hashes)
                yield {"name": signed(w.names(w.grams(hashes))), "one": signed(one), "two": signed(two)}

    return map_rows(texts, hashed, "name long, one long, two long").distinct()


def suspects(classes: DataFrame, index: Runs, batches: int) -> DataFrame:
    """Names met at two places or more. classes: (hi, lo, copies, once, often)."""
    out = None
    for k in range(batches):
        part = classes.where(F.pmod(F.xxhash64(*_CLASS), F.lit(batches)) == k) if batches > 1 else classes
        single = part.select(F.explode("once").alias("name"), F.least("copies", F.lit(2)).alias("n"))
        rows = single.unionByName(part.select(F.explode("often").alias("name"), F.lit(2).alias("n")))
        batch = store(rows.groupBy("name").agg(F.sum("n").alias("n")), "names")
        found = batch.where("n > 1").select("name")
        known = index.present(batch.select("name"))
        if known is not None:
            found = found.unionByName(known.select("name"))
        found = store(found, "suspects")
        index.add(index.absent(batch.select("name")))
        out = found if out is None else out.unionByName(found)
        discard(batch)
    return out.distinct()


def hashed_windows(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Rows (nid, th, hi, lo, copies, names, text) with the place and both hashes of each window
    that has one of ``names``; the text goes on only where a row stands alone for its class."""

    def hashed(batches):
        w = Windows(width, gram)
        for b in batches:
            out = {k: b[k] for k in (*_ROW, *_CLASS, "copies")} | {k: [] for k in ("text", "at", "one", "two")}
            for text, names, copies in zip(b["text"], b["names"], b["copies"], strict=True):
                hashes = word_hashes(text)
                at = np.flatnonzero(np.isin(w.names(w.grams(hashes)), np.array(names, np.int64).view(np.uint64)))
                one, two = w.both(hashes)
                out["text"].append(text.decode() if copies == 1 else None)
                out["at"].append(at.astype(np.int32))
                out["one"].append(signed(one[at]))
                out["two"].append(signed(two[at]))
            yield out

    return map_rows(texts, hashed, "nid long, th long, hi long, lo long, copies long, text string, at array<int>, one array<long>, two array<long>")


def cut_rows(texts: DataFrame, width: int) -> DataFrame:
    """(hi, lo, n_removed, cut_sha, cut_text) of rows (hi, lo, text, starts) without the words of
    the windows that begin at ``starts``."""

    def cut(batches):
        for b in batches:
            out = {k: b[k] for k in _CLASS} | {k: [] for k in ("n_removed", "cut_sha", "cut_text")}
            for text, at in zip(b["text"], b["starts"], strict=True):
                words = text.split()
                at = np.array(at)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
                stay = np.cumsum(edge[:-1]) == 0
                left = b" ".join(words[i] for i in np.flatnonzero(stay))
                out["n_removed"].append(int(len(words) - stay.sum()))
                out["cut_sha"].append(hashlib.sha256(left).digest())
                out["cut_text"].append(left.decode())
            yield out

    return map_rows(texts, cut, "hi long, lo long, n_removed long, cut_sha binary, cut_text string")


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, index: Runs | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of each row of ``docs``; kept_text
    (kept words joined by a space) is null where it is known by its digest alone: no word
    or every word of the row is removed.

    ``index`` is Runs(spark, ["name"]), empty or left by earlier calls of the same width and
    gram; it takes this call's windows under the name ``batch``, which tells the rows of this
    call from those of others. Without it only the rows of this call count."""
    if index is not None and not batch:
        raise ValueError("with an index the rows of a call need a name: batch")
    spark = docs.sparkSession
    scan = store(scanned(docs, width, gram), "windows")
    first = F.min_by(F.struct(*_ROW, "once", "often"), F.struct(*_ROW)).alias("first")
    classes = scan.where(F.col("n_words") >= width).groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("copies"), first)
    classes = store(classes.select(*_CLASS, "copies", "first.*"), "sequences")
    own, held = Runs(spark, ["name"], prefix="windows"), None
    try:
        named = suspects(classes, own, batches)
        if index is not None and index.tables:
            met = classes.select(F.explode(F.concat("once", "often")).alias("name")).distinct()
            held = store(index.present(met, batch).select("name", "one", "two").distinct(), "history")
            named = named.unionByName(held.select("name")).distinct()
        named = store(named, "suspects")
    finally:
        own.drop()

    each = classes.select(*_ROW, *_CLASS, "copies", F.explode(F.concat("once", "often")).alias("name"))
    wanted = each.join(named, "name").groupBy(*_ROW, *_CLASS, "copies").agg(F.collect_list("name").alias("names"))
    wanted = store(wanted, "wanted")
    rows = named_rows(docs).drop("doc_id")
    texts = rows.where(maybe_among([F.col(k) for k in _ROW], wanted.select(*_ROW))).join(wanted.hint("merge"), list(_ROW))
    doubtful = hashed_windows(texts, width, gram)
    # rows that repeat an id and a text come several times; only classes of many copies have any
    repeated = scan.join(classes.where("copies > 1").select(*_ROW), list(_ROW)).groupBy(*_ROW).count().where("count > 1")
    if repeated.limit(1).count():
        doubtful = doubtful.dropDuplicates(list(_ROW))
    doubtful = bucketed(doubtful, "doubtful", *_ROW)
    starts = doubtful.select(*_ROW, "copies", F.explode(F.arrays_zip("at", "one", "two")).alias("w")).select(*_ROW, "copies", "w.at", "w.one", "w.two")
    twice = starts.groupBy("one", "two").agg(F.sum("copies").alias("n")).where("n > 1").select("one", "two")
    if held is not None:
        twice = twice.unionByName(held.select("one", "two")).distinct()
    confirmed = starts.where("copies = 1").select(*_ROW, "at", "one", "two").join(store(twice, "twice"), ["one", "two"])
    spans = confirmed.groupBy(*_ROW).agg(F.collect_list("at").alias("starts"))
    changed = cut_rows(doubtful.where("copies = 1").select(*_ROW, *_CLASS, "text").join(spans, list(_ROW)).select(*_CLASS, "text", "starts"), width)

    if index is not None:
        index.add(all_windows(docs, classes, width, gram), batch)
    nothing = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    gone = classes.where("copies > 1").select(*_CLASS, F.lit(None).cast("long").alias("n_removed"), nothing.alias("cut_sha"), F.lit(None).cast("string").alias("cut_text"))
    verdicts = changed.unionByName(gone).withColumn("judged", F.lit(True))
    rows = scan.select("doc_id", "n_words", *_CLASS, "sha").join(verdicts, list(_CLASS), "left")
    removed = F.when(F.col("judged"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0))
    return rows.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("cut_sha", "sha"))).alias("kept_sha256"), F.col("cut_text").alias("kept_text"))


# ---------------------------------------------------------------- query


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document with its words, how many of them repeated windows cover, and the digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM starts WHERE g IN (SELECT g FROM starts GROUP BY g HAVING count(*) > 1)),
words AS (SELECT doc_id, j, w[j] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM split)),
covered AS (
  SELECT x.doc_id, x.j, x.x, t.i IS NOT NULL AND x.j < t.i + 35 AS gone
  FROM words x ASOF LEFT JOIN twice t ON x.doc_id = t.doc_id AND x.j >= t.i),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT gone), '')) AS kept
  FROM covered GROUP BY doc_id)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(m.n_removed, 0)::BIGINT AS n_removed, coalesce(m.kept, sha256('')) AS kept_sha256
FROM split s LEFT JOIN summed m USING (doc_id)
"""
