"""MinHash near-dedup with odd sketches.

1. One pass over the texts gives each row its set size, a 128-bit key of its set of word
   shingles, and band keys of MinHash samples.
2. Rows with the same set are one class from here on; a class stands by its least doc_id.
3. Buckets are band keys that two classes or more share. Each bucket is led by its member
   that meets the most others over all its buckets, so the many buckets of one family of
   copies have few leaders; a family is all classes that share a leader.
4. Every class is compared with its leaders only, so the work of a family grows with its
   members. A pair's odd sketches come first: every MinHash sample flips one bit of a parity
   bitmap, and the set bits of two bitmaps' XOR tell how many samples differ. What they don't
   rule out is confirmed by the exact intersection of whole sets.
5. Components of these links. A family that is one component is done. In the others the
   members outside the largest component, and only they, are compared with all members of
   other components, in blocks of bounded size, each pair of blocks a group of its own. A
   group skips classes that it has already connected and returns no more links than it has
   members, so no set of all pairs is made.
6. Components of all links, carried back from classes to rows.

With 24 bands of 4 rows a pair of similarity 0.85 shares no bucket with probability 2e-8, of
0.8 with 3e-6. For lower similarities the 96 samples make more bands of fewer rows, so that a
linked pair shares no bucket with probability 1e-5 at most; a similarity for which even
bands of one sample miss more (under 0.12) is refused. Sketches are folded from 512 samples of
their own; a pair is ruled out if it is six standard errors too far apart, which at 0.85 is
all pairs under about 0.75.

Defined cases: null or blank texts have the empty set and are linked with nothing; fewer
words than a shingle make one shingle; very long texts are taken whole, one at a time in a
worker; a doc_id may be of any type that has an order; a null doc_id is never the name of a
component unless no member has another; rows of the same doc_id are separate rows, of which
one of the least text hash stands for a group that the id is the name of; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Powers, bucketed, discard, lowered, map_rows, maybe_among, mixed, shingles_of, signed, store, word_hashes
from .components import components

BANDS, ROWS = 24, 4
#: The greatest probability that a linked pair shares no bucket.
MISS = 1e-5
#: Samples that a sketch is folded from, and its bits.
SAMPLES, SKETCH_BITS = 512, 2048
#: Standard errors by which a pair's sketches must be farther apart than at the threshold.
MARGIN = 6.0
#: Classes and bytes of sets in one block of a family.
BLOCK_CLASSES, BLOCK_BYTES = 192, 6 << 20

_BAND = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def _permutations(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    flips, factors = (rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None] for _ in range(2))
    return flips, factors | np.uint32(1)


_BANDED, _SKETCHED = _permutations(20_240_229, BANDS * ROWS), _permutations(20_240_301, SAMPLES)


def minhashes(shingles: np.ndarray, permutations: tuple[np.ndarray, np.ndarray] = _BANDED) -> np.ndarray:
    """The least of each permuted value, for each permutation; long sets in pieces."""
    flips, factors = permutations
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    best, step = None, (1 << 20) // len(flips)
    for at in range(0, len(high), step):
        x = (high[None, at : at + step] ^ flips) * factors
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        low = x.min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def rows_of(similarity: float) -> int:
    """The most samples in a band with which a pair of ``similarity`` is missed by MISS at most."""
    for rows in range(ROWS, 0, -1):
        if (1 - similarity**rows) ** (BANDS * ROWS // rows) <= MISS:
            return rows
    raise ValueError(f"similarity {similarity} is too low: {BANDS * ROWS} samples miss more than {MISS} of the links")


def band_keys(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = samples.astype(np.uint64).reshape(-1, rows)
    pairs = (np.pad(bands, ((0, 0), (0, 1))) if rows % 2 else bands).reshape(len(bands), -1, 2)
    joined = (pairs[:, :, 0] << np.uint64(32)) | pairs[:, :, 1]
    out = _BAND[: len(bands)]
    for i in range(joined.shape[1]):
        out = mixed(out ^ mixed(joined[:, i] + np.uint64(i)))
    return out


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parity bitmap: each (permutation, sample) flips the bit that it hashes to."""
    bits = mixed(minhashes(shingles, _SKETCHED).astype(np.uint64) | _SLOT) & np.uint64(SKETCH_BITS - 1)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def estimated(differing):
    """The similarity that this many set bits of two sketches' XOR speak for: with a share d of
    the samples different, each of them flips two bits."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * differing / SKETCH_BITS, 1e-9))


def most_differing(threshold: float) -> float:
    """Set bits of two sketches' XOR above which the similarity is surely below ``threshold``."""
    flips = 2 * SAMPLES * (1 - threshold)
    left = np.exp(-2 * flips / SKETCH_BITS)
    of_samples = (2 * left) ** 2 * SAMPLES * threshold * (1 - threshold)
    of_folding = max(SKETCH_BITS / 4 * (1 - left**2) - flips * left**2, 0.0)
    return float(SKETCH_BITS * (1 - left) / 2 + MARGIN * np.sqrt(of_samples + of_folding))


def shingle_sets(width: int):
    powers = Powers()
    return lambda text: shingles_of(word_hashes(lowered(text)), powers, width)


def _key(shingles: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (2**64 - 1)) - (1 << 63)


def row_names(docs: DataFrame) -> tuple[Column, Column]:
    """nid and text_hash of rows: nid is the doc_id if that is a whole number, else a hash of it,
    or of the text where it is null."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    own = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(own, F.xxhash64(F.lit(1), "text")), F.xxhash64("text")


def named_rows(docs: DataFrame) -> DataFrame:
    """(nid, text_hash, doc_id, text)."""
    nid, text_hash = row_names(docs)
    return docs.select(nid.alias("nid"), text_hash.alias("text_hash"), "doc_id", "text")


def signatures(docs: DataFrame, width: int, band_rows: int = ROWS) -> DataFrame:
    """(nid, text_hash, doc_id, n, hi, lo, bands); hi, lo and bands are null of empty sets."""
    kind = dict(docs.dtypes)["doc_id"]

    def signed_rows(batches):
        sets = shingle_sets(width)
        for b in batches:
            n, his, los, bands = [], [], [], []
            for text in b["text"]:
                s = sets(text)
                n.append(len(s))
                hi, lo = _key(s) if len(s) else (None, None)
                his.append(hi)
                los.append(lo)
                bands.append(signed(band_keys(minhashes(s), band_rows)) if len(s) else None)
            yield {k: b[k] for k in ("nid", "text_hash", "doc_id")} | {"n": n, "hi": his, "lo": los, "bands": bands}

    return map_rows(named_rows(docs), signed_rows, f"nid long, text_hash long, doc_id {kind}, n long, hi long, lo long, bands array<long>")


def distinct_sets(signs: DataFrame) -> DataFrame:
    """(hi, lo, least_id, nid, text_hash, bands, node): each different set, with the row of its
    least doc_id, and a number of its own: that row's nid, or where different sets have one
    nid, in all but one of them a half of the key."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "nid", "text_hash")
    row = F.min_by(F.struct("nid", "text_hash", "bands"), first).alias("row")
    classes = signs.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("least_id"), row)
    classes = store(classes.select("hi", "lo", "least_id", "row.*"), "sets")
    again = classes.groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hi", "lo")).alias("first")).where("n > 1").select("nid", "first")
    again = store(again, "shared-ids")
    if not again.limit(1).count():
        return classes.withColumn("node", F.col("nid"))
    named = classes.join(again, "nid", "left")
    own = F.col("first").isNull() | (F.col("first") == F.struct("hi", "lo"))
    return store(named.withColumn("node", F.when(own, F.col("nid")).otherwise(F.col("hi"))).drop("first"), "classes")


def families(classes: DataFrame) -> DataFrame:
    """(leader, node): the classes that share a bucket with each leader, leaders included."""
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("a"), F.max("node").alias("b"))
    shared = store(sizes.where("a <> b").select("bucket", "size"), "buckets")
    members = store(entries.join(shared, "bucket").distinct(), "members")
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    leaders = store(members.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("leader")), "leaders")
    out = store(members.select("bucket", "node").join(leaders, "bucket").select("leader", "node").distinct(), "families")
    discard(shared, members, leaders)
    return out


def sets_of(docs: DataFrame, signs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, bytes, sketch, shingles) of some classes, dealt by node, which is nid for most."""
    wanted = store(classes.select("nid", F.col("text_hash").alias("own"), "node"), "wanted")
    rows = named_rows(docs).drop("doc_id")
    texts = rows.where(maybe_among([F.col("nid"), F.col("text_hash")], wanted.select("nid", "own"))).join(wanted.hint("merge"), "nid")

    def with_sets(batches):
        sets = shingle_sets(width)
        for b in batches:
            rows = [(node, sets(text)) for node, text, own, has in zip(b["node"], b["text"], b["own"], b["text_hash"], strict=True) if own == has]
            found = [s for _, s in rows]
            yield {"node": [n for n, _ in rows], "bytes": [s.nbytes for s in found], "sketch": [odd_sketch(s) for s in found], "shingles": [s.tobytes() for s in found]}

    made = map_rows(texts, with_sets, "node long, bytes long, sketch binary, shingles binary")
    if signs.groupBy("nid", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        made = made.dropDuplicates(["node"])  # rows that repeat a doc_id and its text come several times
    return bucketed(made, "sets", "node")


def _blocks(n, size):
    return F.greatest(F.ceil(n / BLOCK_CLASSES), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _dealt(placed: DataFrame, sets: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return placed.join(sets.select("node", "sketch", "shingles"), "node").repartition(parts, *group).sortWithinPartitions(*group, *order)


def _linked(small: int, large: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (small + large - both)


def compared_with_leaders(family: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, node, linked) of every member but the leader: a pair links if
    den * |A and B| >= num * |A or B|.

    A family is dealt in blocks, its leader to all of them and first; a task holds one leader
    and passes over the members."""
    sized = family.join(sets.select("node", "bytes"), "node")
    counts = sized.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size")).where("n > 1")
    counts = store(counts.select("leader", _blocks(F.col("n"), F.col("size")).alias("blocks")), "family-sizes")
    members = family.where("leader <> node").join(counts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("x"), F.lit(1).alias("after"), "node")
    leaders = counts.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.lit(0).alias("after"), F.col("leader").alias("node"))
    dealt = _dealt(members.unionByName(leaders), sets, ["leader", "x"], ["after", "node"])
    cut = most_differing(num / den)

    def told(batches):
        first = None
        for b in batches:
            out = {"leader": [], "node": [], "linked": []}
            for leader, after, node, sketch, shingles in zip(b["leader"], b["after"], b["node"], b["sketch"], b["shingles"], strict=True):
                sketch, shingles = np.frombuffer(sketch, np.uint64), np.frombuffer(shingles, np.uint64)
                if not after:
                    first = sketch, shingles
                    continue
                n, m = sorted((len(shingles), len(first[1])))
                linked = den * n >= num * m and np.bitwise_count(sketch ^ first[0]).sum() <= cut
                out["leader"].append(leader)
                out["node"].append(node)
                out["linked"].append(bool(linked and _linked(n, m, len(np.intersect1d(shingles, first[1], assume_unique=True)), num, den)))
            yield out

    return store(map_rows(dealt.select("leader", "after", "node", "sketch", "shingles"), told, "leader long, node long, linked boolean", rows=4096), "compared")


def links_of_outsiders(told: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between components in families that are several: a spanning forest of them
    for each group of blocks. labels: (node, component) of the linked nodes."""
    open_ = store(told.where("NOT linked").select("leader").distinct(), "open")
    whole = told.join(open_, "leader", "left_semi").select("leader", "node").unionByName(open_.select("leader", F.col("leader").alias("node")))
    family = store(whole.join(labels, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("label")), "open-families")
    sized = family.join(sets.select("node", "bytes"), "node").groupBy("leader", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    most = F.max_by(F.struct("label", "n", "size"), F.struct("n", "label")).alias("most")
    plan = sized.groupBy("leader").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels"), most).where("labels > 1")
    outside = _blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"))
    plan = store(plan.select("leader", F.col("most.label").alias("inside"), outside.alias("outs"), _blocks(F.col("most.n"), F.col("most.size")).alias("ins")), "open-sizes")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = family.join(plan, "leader").withColumn("within", F.col("label") == F.col("inside"))
    placed = placed.withColumn("blocks", F.when(F.col("within"), F.col("ins")).otherwise(F.col("outs"))).withColumn("own", own)
    outs, ins = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("outs", "ins"))
    place = lambda x, y, left: F.struct(x.alias("x"), y.alias("y"), left.alias("left"))
    # outsiders meet in pairs of blocks x <= y, and block x meets block y - outs of the component
    among = F.transform(outs, lambda o: place(F.least("own", o), F.greatest("own", o), F.col("own") <= o))
    across = F.transform(ins, lambda i: place(F.col("own"), F.col("outs") + i, F.lit(True)))
    inside = F.transform(outs, lambda o: place(o, F.col("outs") + F.col("own"), F.lit(False)))
    placed = placed.select("leader", "node", "label", F.explode(F.when(F.col("within"), inside).otherwise(F.concat(among, across))).alias("p")).select("leader", "node", "label", "p.*")
    dealt = _dealt(placed, sets, ["leader", "x", "y"], ["node"])
    cut = most_differing(num / den)

    def confirmed(batches):
        for key, rows in _groups(batches):
            found = _block_links(rows, key[1] == key[2], cut, num, den)
            if found:
                yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return store(map_rows(dealt.select("leader", "x", "y", "node", "left", "label", "sketch", "shingles"), confirmed, "a long, b long", rows=4096).distinct(), "links")


def _groups(batches):
    """Rows (node, left, label, sketch, shingles) of one (leader, x, y) after another."""
    key, rows = None, []
    for b in batches:
        for leader, x, y, *row in zip(*(b[k] for k in ("leader", "x", "y", "node", "left", "label", "sketch", "shingles")), strict=True):
            if key != (leader, x, y):
                if len(rows) > 1:
                    yield key, rows
                key, rows = (leader, x, y), []
            rows.append(row)
    if len(rows) > 1:
        yield key, rows


def _block_links(rows: list, same: bool, cut: float, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between labels, within a block or across two, as pairs of
    labels."""
    sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    left = np.fromiter((r[1] for r in rows), bool, len(rows))
    label, found, shared = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)[1], [], _Shared(sets)
    for i in range(len(rows)):
        if not same and not left[i]:
            continue
        others = np.arange(i + 1, len(rows)) if same else np.flatnonzero(~left)
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[den * small >= num * large]
        others = others[np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1) <= cut]
        if not len(others):
            continue
        both = shared.counts(i, others)
        for j in others[den * both >= num * (sizes[others] + sizes[i] - both)]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                found.append((rows[i][2], rows[j][2]))
    return found


class _Shared:
    """Exact sizes of intersections: bit sets over the shingles that two sets or more hold,
    or merged sorted arrays where those bit sets would be large."""

    MOST_BYTES = 64 << 20

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.bits = sets, None
        if len(sets) <= 4:
            return
        known, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times > 1
        width = (int(common.sum()) + 63) // 64
        if width * 8 * len(sets) > self.MOST_BYTES:
            return
        new = np.cumsum(common) - 1
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        held = common[place]
        row, column = row[held], new[place[held]]
        flat = np.zeros((len(sets), width * 64), np.uint8) if width * 64 * len(sets) <= self.MOST_BYTES else None
        if flat is None:
            bits = np.zeros((len(sets), width * 8), np.uint8)
            np.bitwise_or.at(bits, (row, column >> 3), (1 << (column & 7)).astype(np.uint8))
        else:
            flat[row, column] = 1
            bits = np.packbits(flat, axis=1)
        self.bits = bits.view(np.uint64)

    def counts(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in others], np.int64)
        out = np.empty(len(others), np.int64)
        step = max(1, (8 << 20) // max(1, self.bits.shape[1] * 8))
        for at in range(0, len(others), step):
            out[at : at + step] = np.bitwise_count(self.bits[others[at : at + step]] & self.bits[i]).sum(axis=1)
        return out


def grouped(docs: DataFrame, similarity: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """(nid, text_hash, doc_id, n_shingles, hi, lo, component_id, group): every row of ``docs`` with the
    least doc_id it is linked to, directly or through others; its own where it has no links. group
    tells components apart whatever their ids are; it is null of empty sets."""
    num, den = similarity
    signs = store(signatures(docs, width, rows_of(num / den)), "signatures")
    classes = distinct_sets(signs)
    family = families(classes)
    sets = sets_of(docs, signs, classes.join(family.select("node").distinct(), "node", "left_semi"), width)
    told = compared_with_leaders(family, sets, num, den)
    labels = store(components(told.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))), "labels")
    named = classes.select("hi", "lo", "least_id", "node").join(labels, "node", "left").select("hi", "lo", "least_id", F.coalesce("component", "node").alias("group"))
    if told.where("NOT linked").limit(1).count():
        more = components(links_of_outsiders(told, labels, sets, num, den)).select(F.col("node").alias("group"), F.col("component").alias("whole"))
        named = named.join(store(more, "labels"), "group", "left").select("hi", "lo", "least_id", F.coalesce("whole", "group").alias("group"))
    discard(sets, family, told)
    named = store(named, "groups")
    least = store(named.groupBy("group").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    final = named.join(least, "group", "left").select("hi", "lo", F.coalesce("component_id", "least_id").alias("component_id"), "group")
    rows = signs.select("nid", "text_hash", "doc_id", F.col("n").alias("n_shingles"), "hi", "lo")
    return rows.join(final, ["hi", "lo"], "left").withColumn("component_id", F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def first_of_each_group(docs: DataFrame, similarity: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """One row of ``docs`` for each group: of its least doc_id, null only if no member has one,
    and the least text hash; of rows equal in both, one. Rows without words are groups of
    their own."""
    known = store(grouped(docs, similarity, width), "known")
    equal = known.groupBy("group", "nid", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    alone = F.when(F.col("group").isNull(), F.struct("nid", "text_hash"))
    first = equal.groupBy("group", alone.alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "nid", "n")).alias("k"))
    several = F.col("group").isNotNull() & (F.col("k.n") > 1)
    kept = store(first.select(F.col("k.nid").alias("_nid"), F.col("k.text_hash").alias("_hash"), several.alias("_several")), "kept")
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    nid, text_hash = row_names(docs)
    own = docs.select(nid.alias("_nid"), text_hash.alias("_hash"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    # rows that surely stay, and stay alone, needn't be shuffled to be told so
    single = kept.where("NOT _several").select("_nid", "_hash")
    touched = store(known.select(F.col("nid").alias("_nid"), F.col("text_hash").alias("_hash")).distinct().join(single, ["_nid", "_hash"], "left_anti"), "touched")
    doubtful = maybe_among([F.col("_nid"), F.col("_hash")], touched)
    out = own.where(~doubtful).select(*names.values()).unionByName(own.where(doubtful).join(single, ["_nid", "_hash"], "left_semi").select(*names.values()))
    if kept.where("_several").limit(1).count():
        row = F.struct(*names.values())
        one = own.join(kept.where("_several"), ["_nid", "_hash"], "left_semi").groupBy("_nid", "_hash").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


# ---------------------------------------------------------------- query


def op8_near(spark, sf_dir: str) -> DataFrame:
    """Every document with its set size, its component and whether it stands for it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grouped(docs, (85, 100)).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
