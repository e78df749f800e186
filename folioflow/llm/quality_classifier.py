"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters and digits, and runs of marks. Features are hashes of words, of
pairs of words, and of the event that a word repeats the one before, as counts of unit
length. The learner reads at most ``TRAIN_ROWS`` labelled rows, the same ones on every run,
chosen by a hash of their ids; their texts are found by a broadcast of those ids, so no text
is shuffled. Their sparse features, stored, stream through one task in a fixed order, once for
each epoch, sorted by Spark; the task holds the model and one batch, whatever the texts'
lengths. The weights, 2**BITS floats however large the corpus is, are broadcast, and every text is scored
as one sparse dot product.

Defined cases: a null or empty text has no features and gets the bias' score; rows whose
label is null don't train; of several labels of one id the least holds; without any label
all scores are 0.5; a null doc_id is never a training row nor held out; repeated rows score
alike; texts of any length are taken whole; an empty table gives an empty result; other
columns are never read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, map_rows, mixed, store

BITS = 18
#: The most labelled rows that the learner reads.
TRAIN_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
_PAIR, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.uint64((1 << BITS) - 1)


class Features:
    def __init__(self):
        self.cache = WordHashes()

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices, ascending, and values of unit length; the last index is the bias."""
        h = self.cache.of(_TOKEN.findall(text or b""))
        if not len(h):
            return np.array([1 << BITS]), np.ones(1, np.float32)
        again = np.count_nonzero(h[1:] == h[:-1])
        all_ = np.concatenate([h, mixed(h[:-1] * _PAIR + h[1:]), np.full(again, _AGAIN)])
        index, count = np.unique(all_ & _MASK, return_counts=True)
        value = count / np.sqrt(np.dot(count, count.astype(np.float64)))
        return np.append(index.astype(np.int64), 1 << BITS), np.append(value, 1.0).astype(np.float32)


class Ftrl:
    """Follow-the-regularised-leader, proximal, with a learning rate for each coordinate."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, index=slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (_sigmoid(np.dot(w, value)) - label) * value
        more = g * g
        sigma = (np.sqrt(self.n[index] + more) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += more


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def held_out(doc_id):
    """Rows kept from the learner: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(place, label, text) of at most ``rows`` labelled ids that aren't held out."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    ids = ids.orderBy("place", "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("place", "doc_id", "label", "text")


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all features and the bias, as float32."""

    def featured(batches):
        features = Features()
        for b in batches:
            both = [features.of(t) for t in b["text"]]
            index = [i.astype("<u4").tobytes() for i, _ in both]
            yield {k: b[k] for k in ("place", "doc_id", "label")} | {"index": index, "value": [v.tobytes() for _, v in both]}

    kind = dict(docs.dtypes)["doc_id"]
    ready = map_rows(training_rows(docs, labels, rows), featured, f"place long, doc_id {kind}, label int, index binary, value binary")

    def learned(batches):
        model = Ftrl((1 << BITS) + 1)
        for b in batches:
            for index, value, label in zip(b["index"], b["value"], b["label"], strict=True):
                model.learn(np.frombuffer(index, "<u4").astype(np.int64), np.frombuffer(value, np.float32), 1 if label else 0)
        yield {"weights": [model.weights().astype("<f4").tobytes()]}

    sample = store(ready, "features", "lz4")
    each = sample.coalesce(1).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = each.sortWithinPartitions("epoch", "place", "doc_id", F.octet_length("index"), "value", "index")
    got = map_rows(ordered.select("label", "index", "value"), learned, "weights binary").collect()
    discard(sample)
    return np.frombuffer(bytes(got[0]["weights"]), "<f4") if got else np.zeros((1 << BITS) + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of each row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))

    def score(batches):
        features, w = Features(), shared.value
        for b in batches:
            out = []
            for text in b["text"]:
                index, value = features.of(text)
                out.append(float(_sigmoid(np.dot(w[index].astype(np.float64), value))))
            yield {"doc_id": b["doc_id"], "score": out}

    return map_rows(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")


# ---------------------------------------------------------------- query


def op7_scores(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs, trained(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
