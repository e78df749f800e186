"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

The benchmark is the query set. It is read in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_BYTES`` bytes, so what is broadcast at a time has a fixed bound. A benchmark of one
block is held against every row in one pass. Of a longer one, bit filters of all shingles,
``FILTER_BYTES`` at most for each of the five widths, first take out the rows that could hold
an item at all; only these few, stored, meet block after block. So all texts are passed over
once, or twice where clean rows are wanted, however long the benchmark is.

In each text, windows of as many words as an item has are compared to the items of that
length. Only windows that share enough shingles with those items to reach the threshold at
all get a fingerprint (the bound is exact, nothing similar is passed over). A fingerprint has
128 bits, the signs of the summed bits of the window's shingles; a shingle that comes again in
the window is another one each time, so weighted and plain similarity are the same. It is cut
in 16 blocks of 8 bits; within a distance of 40 at least one block differs in two bits or
fewer, so the tables of all such block values give every item within that radius. Those are
checked by the exact weighted Jaccard similarity of shingle counts. Expected distances at
similarity 0.8 are about 19, five standard errors below the radius. For lower thresholds the
radius, and the distance of the block tables, grow to keep five of them.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case;
shingles have five words, or all words of a shorter item.

Defined cases: a null or blank text or item matches nothing; a text shorter than an item is
one window as a whole; texts of any length are taken whole, their words in pieces of a
mebibyte; repeated rows are judged alike; ties between an item's windows go to the first; an
empty table or benchmark gives no matches; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, among, bound_batches, discard, map_rows, mixed, store, word_hashes

THRESHOLD = 0.8
SHINGLE = 5
#: The least radius; ``radius_of`` gives the one of a threshold.
RADIUS, BLOCKS = 40, 16
BLOCK_ITEMS, BLOCK_BYTES = 4096, 8 << 20
#: The largest bit filter, and the bits of it that a shingle is given below that size.
FILTER_BYTES, _SPARSE = 32 << 20, 64
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SECOND, _AGAIN = np.uint64(0xA0761D6478BD642F), np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4096
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def radius_of(threshold: float) -> int:
    """Five standard errors over the distance expected at a similarity of ``threshold``, where
    windows of different shingles have the cosine 2t / (1 + t)."""
    share = np.arccos(2 * threshold / (1 + threshold)) / np.pi
    bits = 8 * BLOCKS
    return min(bits, max(RADIUS, int(np.ceil(bits * share + 5 * np.sqrt(bits * share * (1 - share))))))


class Texts:
    """Hashes of words and shingles."""

    def __init__(self):
        self.powers = Powers()

    def words(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        return word_hashes((text if text.isascii() else text.decode().lower().encode()).translate(_PLAIN))

    def shingles(self, words: np.ndarray, width: int) -> np.ndarray:
        return self.powers.windows(words, width)


def numbered(shingles: np.ndarray) -> np.ndarray:
    """The shingles of one window, the second and later of equal ones made different."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return shingles
    place = np.arange(len(ranked))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty_like(shingles)
    out[order] = np.where(nth > 0, mixed(ranked + nth.astype(np.uint64) * _AGAIN), ranked)
    return out


def bit_rows(shingles: np.ndarray) -> np.ndarray:
    """128 signs for each shingle."""
    both = np.stack([shingles, mixed(shingles ^ _SECOND)], axis=1)
    return (np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """16 bytes for each row of 128 sums."""
    return np.packbits(sums > 0, axis=1)


class Length:
    """The items of one length, with their block tables."""

    def __init__(self, n_words: int, items: list[tuple[int, np.ndarray]], radius: int = RADIUS):
        self.radius = radius
        self.n_words, self.width = n_words, min(SHINGLE, n_words)
        self.n = n_words - self.width + 1
        self.items = items
        self.counts = [np.unique(s, return_counts=True) for _, s in items]
        self.known = np.unique(np.concatenate([s for _, s in items]))
        self.prints = fingerprints(np.stack([bit_rows(numbered(s)).sum(axis=0, dtype=np.int64) for _, s in items]))
        # tables[b][v]: the items whose block b is near v, as bits
        near = (_APART <= radius // BLOCKS)[:, self.prints]  # value, item, block
        self.tables = np.packbits(near.transpose(2, 0, 1), axis=2)

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) of each fingerprint and each item within the radius."""
        hits = np.zeros((len(prints), self.tables.shape[2]), np.uint8)
        for b in range(BLOCKS):
            hits |= self.tables[b][prints[:, b]]
        rows, items = np.nonzero(np.unpackbits(hits, axis=1)[:, : len(self.items)])
        close = np.bitwise_count(prints[rows] ^ self.prints[items]).sum(axis=1) <= self.radius
        yield from zip(rows[close].tolist(), items[close].tolist(), strict=True)

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity: least over greatest counts, summed."""
        values, counts = np.unique(shingles, return_counts=True)
        own, times = self.counts[item]
        _, i, j = np.intersect1d(values, own, assume_unique=True, return_indices=True)
        both = int(np.minimum(counts[i], times[j]).sum())
        return both / (len(shingles) + self.n - both)


def windows_possible(n_text: int, hits: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Starts of the windows of ``n`` shingles that share enough of them to reach the threshold:
    at similarity t two sets of n have 2t / (1 + t) * n in common. hits: where the text has a
    shingle of the items."""
    size = min(n, n_text)
    need = int(np.ceil(threshold / (1 + threshold) * (size + n) - 1e-9))
    if size < need or len(hits) < need:
        return np.zeros(0, np.int64)
    total = np.zeros(n_text + 1, np.int64)
    total[hits + 1] = 1
    np.cumsum(total, out=total)
    return np.flatnonzero(total[size:] - total[: len(total) - size] >= need)


class BitFilter:
    """Some bits of a hash of each shingle of all items; no shingle of an item is missed."""

    def __init__(self, n_shingles: int, most: int = FILTER_BYTES):
        size = min(most, max(1 << 19, 1 << (_SPARSE * max(n_shingles, 1) // 8).bit_length()))
        self.shift = np.uint64(64 - (size.bit_length() + 2))
        self.bits = np.zeros(size, np.uint8)

    def _places(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = shingles >> self.shift
        return (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)

    def add(self, shingles: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, *self._places(shingles))

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        where, bit = self._places(shingles)
        return np.flatnonzero(self.bits[where] & bit)


class Candidates:
    """All items' lengths and filters: which texts could hold an item at all."""

    def __init__(self, blocks: Iterator[list], n_words: int, threshold: float):
        self.threshold, texts, self.lengths, self.filters = threshold, Texts(), {}, {}
        for _, text in chain.from_iterable(blocks):
            words = texts.words(text)
            if len(words):
                width = min(SHINGLE, len(words))
                if width not in self.filters:
                    self.filters[width], self.lengths[width] = BitFilter(n_words), set()
                self.filters[width].add(texts.shingles(words, width))
                self.lengths[width].add(len(words) - width + 1)

    def possible(self, texts: Texts, text: bytes | None) -> bool:
        words = texts.words(text)
        for width, known in self.filters.items():
            shingles = texts.shingles(words, width)
            hits = known.hits(shingles)
            if len(hits) and any(len(windows_possible(len(shingles), hits, n, self.threshold)) for n in self.lengths[width]):
                return True
        return False


class Matcher:
    """One block of items against any text."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], threshold: float):
        self.threshold, self.texts = threshold, Texts()
        by_length: dict[int, list] = {}
        for item_id, text in items:
            words = self.texts.words(text)
            if len(words):
                by_length.setdefault(len(words), []).append((item_id, self.texts.shingles(words, min(SHINGLE, len(words)))))
        self.lengths = [Length(n, own, radius_of(threshold)) for n, own in sorted(by_length.items())]
        self.widths = sorted({x.width for x in self.lengths})
        self.known = {w: np.unique(np.concatenate([x.known for x in self.lengths if x.width == w])) for w in self.widths}
        self.filters = {}
        for w, known in self.known.items():
            self.filters[w] = BitFilter(len(known))
            self.filters[w].add(known)

    def matches(self, text: bytes | None) -> dict[int | None, tuple[float, int, int]]:
        """Each item found, with its best similarity and that window's first word and length."""
        words, found = self.texts.words(text), {}
        for width in self.widths:
            shingles = self.texts.shingles(words, width)
            maybe = self.filters[width].hits(shingles)
            maybe = maybe[among(shingles[maybe], self.known[width])] if len(maybe) else maybe
            if len(maybe):
                for length in self.lengths:
                    if length.width == width:
                        self._of_length(length, shingles, maybe, found)
        return found

    def _of_length(self, length: Length, shingles: np.ndarray, maybe: np.ndarray, found: dict) -> None:
        n = min(length.n, len(shingles))
        starts = windows_possible(len(shingles), maybe[among(shingles[maybe], length.known)], length.n, self.threshold)
        for at in range(0, len(starts), _CHUNK):
            part = starts[at : at + _CHUNK]
            # one run of prefix sums for each stretch of overlapping windows
            for run in np.split(part, np.flatnonzero(np.diff(part) > n) + 1):
                low = run[0]
                stretch = shingles[low : run[-1] + n]
                if len(np.unique(stretch)) == len(stretch):
                    sums = np.zeros((len(stretch) + 1, 8 * BLOCKS), np.int32)
                    np.cumsum(bit_rows(stretch), axis=0, out=sums[1:], dtype=np.int32)
                    prints = fingerprints(sums[run - low + n] - sums[run - low])
                else:
                    prints = fingerprints(np.stack([bit_rows(numbered(shingles[x : x + n])).sum(axis=0, dtype=np.int32) for x in run]))
                for row, item in length.near(prints):
                    start = int(run[row])
                    similar = length.similarity(shingles[start : start + n], item)
                    item_id = length.items[item][0]
                    if similar >= self.threshold and similar > found.get(item_id, (0.0,))[0]:
                        found[item_id] = (similar, start, n + length.width - 1)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark in blocks of bounded items and bytes, read one after another."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        text = row["text"].encode()
        if block and (len(block) >= BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


_matcher: tuple = (None, None)


def matcher_of(shared, threshold: float) -> Matcher:
    """The matcher of a broadcast block, made once a worker."""
    global _matcher
    if _matcher[0] != (shared.id, threshold):
        _matcher = ((shared.id, threshold), Matcher(shared.value, threshold))
    return _matcher[1]


class _Shared:
    """A broadcast value that workers know again."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _texts_of(batch: pa.RecordBatch, place: int) -> list[bytes | None]:
    texts = batch.column(place)
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def chosen(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` whose text ``judge()`` (made for each partition) holds for; nothing is shuffled."""
    place = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def kept(batches):
        good = judge()
        for batch in batches:
            yield batch.filter(pa.array([good(t) for t in _texts_of(batch, place)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def _without(docs: DataFrame, shared: _Shared, threshold: float) -> DataFrame:
    def judge():
        matcher = matcher_of(shared, threshold)
        return lambda text: not matcher.matches(text)

    return chosen(docs, judge)


def _found(docs: DataFrame, shared: _Shared, threshold: float) -> DataFrame:
    def found(batches):
        matcher = matcher_of(shared, threshold)
        for b in batches:
            rows = [(d, i, *m) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, m in sorted(matcher.matches(t).items(), key=str)]
            yield dict(zip(_MATCH, map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))

    return map_rows(docs.select("doc_id", "text"), found, _schema(docs))


_MATCH = ("doc_id", "item_id", "similarity", "first_word", "n_words")


def _schema(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, item_id long, similarity double, first_word long, n_words long"


def _candidates(docs: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that could hold some item, stored, and all others."""
    n_words = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] // 4
    shared = _Shared(docs.sparkSession, Candidates(item_blocks(benchmark), n_words, threshold))

    def judge(wanted: bool):
        def made():
            known, texts = shared.value, Texts()
            return lambda text: known.possible(texts, text) == wanted

        return made

    return store(chosen(docs, judge(True)), "candidates"), chosen(docs, judge(False))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): a row for each row of ``docs`` and
    each item that a window of it is similar to."""
    spark, blocks = docs.sparkSession, item_blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], _schema(docs))
    if second is None:
        return _found(docs, _Shared(spark, first), threshold)
    few, out = _candidates(docs.select("doc_id", "text"), benchmark, threshold)[0], None
    for block in chain([first, second], blocks):
        shared = _Shared(spark, block)
        part = store(_found(few, shared, threshold), "matches")
        shared.broadcast.destroy()
        out = part if out is None else out.unionByName(part)
    discard(few)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns. Texts pass
    through the tasks that judge them; nothing is shuffled."""
    spark, blocks = docs.sparkSession, item_blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return _without(docs, _Shared(spark, first), threshold)
    few, rest = _candidates(docs, benchmark, threshold)
    for block in chain([first, second], blocks):
        shared = _Shared(spark, block)
        left = store(_without(few, shared, threshold), "candidates")
        shared.broadcast.destroy()
        discard(few)
        few = left
    return rest.unionByName(few)


# ---------------------------------------------------------------- query


def op6_leaks(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with similarity and place."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, items).withColumn("similarity", F.round("similarity", 6))
