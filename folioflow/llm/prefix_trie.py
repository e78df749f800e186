"""Conversation prefix trie in preorder-interval encoding.

A node is a distinct sequence of first turns; its members are the conversations that begin with
it. Nodes are told apart, ranked and summed over without ever holding a sequence:

1. A turn is a label, 128 bits of the SHA-256 of its role and text, taken where the text is
   read; texts are not shuffled. The node of a conversation's first d turns is named by the
   sums over them of four 32-bit hashes of (place, label), 128 bits, which running totals by
   conversation give: a long conversation spreads over many tasks.
2. Parents with more than one child are where conversations part. A conversation's key lists its
   labels below such parents: sorted by key, then by length, conversations are in
   lexicographic order (of labels). Another conversation parts at each entry and is as long
   as the depth, so no key has more than the square root of twice the number of turns, and all
   keys together have no more entries than there are turns. Conversations get their rank by
   a range sort; a node's rank is that of its first member, and then its depth. This order
   of nodes is a preorder.
3. Running totals in this order give each node its position and what ends, leaves and savings
   lie before it. Members are consecutive in the order, so a subtree ends at the node where
   the ends so far reach those before its top plus its members: one equality join gives the
   subtree's last position and the totals there. Leaves and savings of a subtree are
   differences of two totals.
4. Ids of the members that end at a node are sorted by range, joined in pieces of 4,096 and
   streamed through SHA-256, piece by piece, which is sequential by its nature.

Hot keys: a first turn that many share is counted within tasks first; where turns or nodes are
joined to what their parent, conversation or last position has, the other side has one row
a key, and Spark splits the large side.

Defined cases: a null role or text is empty; rows with a null conv_id are no conversation;
turns are ordered by turn, nulls first, then by role, then by label (rows that repeat a turn
are turns of their own); a conversation given as a member without turns ends at the root;
texts of any length are taken whole; an empty table has no node, not even a root; other
columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, n_words, store
from .prefix import running_total, running_totals

#: Ids in a piece of the text whose digest is taken.
PIECE = 4096
_NODE, _PARENT = ("k1", "k2"), ("p1", "p2")
_LANES = ("a", "b", "c", "d")


def labelled(turns: DataFrame) -> DataFrame:
    """(conv_id, place, label, n_words) of the turns (conv_id, turn, role, text) of each
    conversation, place counting from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    light = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), label.alias("label"), n_words(text).alias("n_words"), F.lit(1).alias("_one"))
    numbered = running_total(light, ["conv_id"], ["turn", "role", "label"], "_one")
    return numbered.select("conv_id", (F.col("before") + 1).alias("place"), "label", "n_words")


def _name(sums, depth) -> list:
    """The two longs that name a node, of its four sums and its depth."""
    return [F.xxhash64(F.lit(salt), depth, *sums) for salt in (1, 2)]


def _steps(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, label, n_words): each turn with its node and the parent."""
    lanes = {}
    for salt, (low, high) in enumerate((_LANES[:2], _LANES[2:])):
        value = F.xxhash64(F.lit(salt), "place", "label")
        lanes |= {low: value.bitwiseAND(0xFFFFFFFF), high: F.shiftrightunsigned(value, 32)}
    summed = running_totals(turns.withColumns(lanes), ["conv_id"], ["place"], {x: f"_{x}" for x in _LANES})
    here, above = [F.col(f"_{x}") + F.col(x) for x in _LANES], [F.col(f"_{x}") for x in _LANES]
    depth = F.col("place").cast("long")
    named = [c.alias(n) for c, n in zip([*_name(here, depth), *_name(above, depth - 1)], [*_NODE, *_PARENT], strict=True)]
    return summed.select("conv_id", depth.alias("depth"), *named, "label", "n_words")


def _root() -> list:
    return _name([F.lit(0).cast("long")] * len(_LANES), F.lit(0).cast("long"))


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (k1, k2, conv_id): the ids of each node, ascending and joined by commas."""
    ranged = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")

    def pieces(batches):
        key, ids = None, []

        def told():
            return {"k1": [key[0]], "k2": [key[1]], "at": [ids[0]], "piece": [",".join(map(str, ids))]}

        for b in batches:
            for k1, k2, conv in zip(b["k1"], b["k2"], b["conv_id"], strict=True):
                if ids and ((k1, k2) != key or len(ids) == PIECE):
                    yield told()
                    ids = []
                key = (k1, k2)
                ids.append(conv)
        if ids:
            yield told()

    def streamed(batches):
        key = sha = None

        def told():
            return {"k1": [key[0]], "k2": [key[1]], "ends_sha256": [sha.hexdigest()]}

        for b in batches:
            for k1, k2, piece in zip(b["k1"], b["k2"], b["piece"], strict=True):
                if (k1, k2) == key:
                    sha.update(b"," + piece)
                    continue
                if sha:
                    yield told()
                key, sha = (k1, k2), hashlib.sha256(piece)
        if sha:
            yield told()

    cut = map_rows(ranged, pieces, "k1 long, k2 long, at long, piece string")
    dealt = cut.repartition(*_NODE).sortWithinPartitions(*_NODE, "at")
    return map_rows(dealt, streamed, "k1 long, k2 long, ends_sha256 string")


def encoded(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, label, n_words), as ``labelled`` gives
    them, and of the conversations ``members`` (conv_id, each once), which may have no turn:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    position, last_position), a node being named by its least member and its depth. Positions
    count from 0 in preorder; the subtree of a node is what lies between its two."""
    steps = store(_steps(turns), "steps")
    distinct = steps.groupBy(*_NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count(F.lit(1)).alias("n"))
    kids = store(distinct.groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n").alias("passing")), "children")

    parting = kids.where("n_children > 1").select(*_PARENT, F.lit(True).alias("parts"))
    below = F.when(F.col("parts"), F.struct("depth", "label"))
    keys = steps.join(parting, list(_PARENT), "left").groupBy("conv_id").agg(
        F.max("depth").alias("depth"), F.max_by(F.struct(*_NODE), "depth").alias("end"), F.sort_array(F.collect_list(below)).alias("key")
    )
    root = F.struct(*[c.alias(n) for c, n in zip(_root(), _NODE, strict=True)])
    whole = members.join(keys, "conv_id", "left").select(
        "conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("end", root).alias("end"), F.coalesce(F.col("key.label"), F.array().cast("array<string>")).alias("key"), F.lit(1).alias("_one")
    )
    ranked = store(running_total(whole, [], ["key", "depth", "conv_id"], "_one", "rank").select("conv_id", "end.*", "rank"), "ranked")

    first = [F.min(c).alias(c) for c in (*_PARENT, "depth", "n_words", "conv_id", "rank")]
    inner = steps.join(ranked.select("conv_id", "rank"), "conv_id").groupBy(*_NODE).agg(*first, F.count(F.lit(1)).alias("n_convs"))
    nothing = F.lit(None).cast("long")
    top = ranked.agg(F.min("conv_id").alias("conv_id"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(*[c.alias(n) for c, n in zip(_root(), _NODE, strict=True)], nothing.alias("p1"), nothing.alias("p2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_words"), "conv_id", "rank", "n_convs")
    nodes = inner.unionByName(top).join(kids.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "passing"), list(_NODE), "left")
    nodes = nodes.withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)),
            "ends": F.col("n_convs") - F.coalesce("passing", F.lit(0)),
            "leaf": F.col("n_children").isNull().cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("n_words"),
            "_one": F.lit(1),
        }
    )
    summed = running_totals(nodes, [], ["rank", "depth"], {"_one": "position", "ends": "_ends", "leaf": "_leaves", "saved": "_saved"})
    summed = store(summed.select(*_NODE, *_PARENT, "conv_id", "depth", "n_convs", "n_children", "ends", "leaf", "saved", "position", "_ends", "_leaves", "_saved"), "preorder")

    reached = (F.col("_ends") + F.col("ends")).alias("reached")
    last = summed.where("ends > 0").select(reached, F.col("position").alias("last_position"), (F.col("_leaves") + F.col("leaf")).alias("leaves_upto"), (F.col("_saved") + F.col("saved")).alias("saved_upto"))
    above = summed.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = store(digests(ranked.select(*_NODE, "conv_id")), "ends")
    out = summed.withColumn("reached", F.col("_ends") + F.col("n_convs")).join(last, "reached").join(above, list(_PARENT), "left").join(ends, list(_NODE), "left")
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_upto") - F.col("_leaves")).alias("n_leaves"), (F.col("saved_upto") - F.col("_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "position", "last_position",
    )
    out = store(out, "trie")
    discard(steps, kids, ranked, summed, ends)
    return out


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text)."""
    rows = store(labelled(turns), "turns")
    out = encoded(rows.select("conv_id").distinct(), rows)
    discard(rows)
    return out


# ---------------------------------------------------------------- query

GROUP, MOST_BORROWED = 20, 3


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and turns, as ``encoded`` takes them, of conversations that begin with the first
    turns of the one their group of ``GROUP`` ids starts with, up to ``MOST_BORROWED``."""
    n_borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)
    start = F.col("conv_id") - F.col("conv_id") % GROUP
    members = store(rows.groupBy("conv_id").agg(F.least(F.count(F.lit(1)), F.lit(MOST_BORROWED)).alias("n")).withColumns({"h": n_borrowed, "start": start}), "members")
    heads = rows.where((F.col("place") <= MOST_BORROWED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "start")
    lent = members.select("conv_id", "h", "start").join(heads, "start").where(F.col("place") <= F.col("h")).select("conv_id", "place", "label", "n_words")
    starts = members.where(F.col("conv_id") % GROUP == 0).select("start", "n")
    own = rows.withColumns({"h": n_borrowed, "start": start}).where(F.col("place") > F.col("h")).join(starts, "start", "left")
    moved = F.col("place") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))
    return members.select("conv_id"), lent.unionByName(own.select("conv_id", moved.alias("place"), "label", "n_words"))


def op11_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = store(labelled(turns), "turns")
    members, whole = rebuilt(rows)
    out = encoded(members, whole).drop("position", "last_position")
    discard(rows, members)
    return out


OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, role, left(sha256(length(role) || ':' || role || text), 32) AS label, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM t),
own AS (
  SELECT conv_id, list({'label': label, 'n': n} ORDER BY turn NULLS FIRST, role, label) AS s,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS h
  FROM k GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.s, [])[1:c.h], c.s[c.h + 1:]) AS s
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (
  SELECT conv_id, d, len(s) AS len, md5(array_to_string(list_transform(s[1:d], lambda x: x.label), '')) AS node,
         md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.label), '')) AS parent, CASE WHEN d > 0 THEN s[d].n ELSE 0 END AS n
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(n) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM p GROUP BY d, node),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
subtree AS (
  SELECT a.d, a.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM nodes v JOIN p a ON a.conv_id = v.conv_id AND a.d <= v.d LEFT JOIN kids k ON k.d = v.d AND k.node = v.node GROUP BY a.d, a.node)
SELECT v.conv_id, v.d::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.d = v.d - 1 AND u.node = v.parent LEFT JOIN kids k ON k.d = v.d AND k.node = v.node
JOIN subtree s ON s.d = v.d AND s.node = v.node
"""
