"""Chat formatting: reply trees to conversations.

Root-to-leaf paths are enumerated by self-joins that double their reach: level k knows each
node's ancestor 2**k replies up and the score of the nodes between, so a path of any depth
takes twice the logarithm of the deepest one in joins, and the rows made are those of the
chosen paths. Paths of a tree are ranked by the sum of their nodes' scores; ranking uses
range-partitioned running counts, so a tree with a third of all nodes is spread. All this is
done on nodes without texts. Texts are shuffled once, by tree, to meet its chosen paths; trees
whose paths have more than ``MOST_TURNS`` turns together are dealt by node, then by path.

The template of a turn is ``### role: text</turn>`` and a line feed. Inside roles and texts
backslash, ``<`` and ``#`` become ``\\b``, ``\\l`` and ``\\h`` (in roles also ``:``, ``\\c``), so
no control string can occur there, and parsing takes the turns back exactly. The loss mask
lists the code-point spans of the assistant's texts.

Defined cases: null texts and roles are empty; a null tree id is a tree of its own; a node
whose parent isn't in its tree is a root; ties in score go to the smaller leaf; of rows that
repeat a node id each counts once as a turn only after ``linear`` has numbered them (in trees
node ids must be unique, the first by role and text holds); nodes on or below a cycle have no
root and are on no path; texts of any length are taken whole, a path being one string in one
task; an empty table gives an empty result; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, store
from .prefix import running_total

ASSISTANT = "assistant"
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
#: Escapes, applied in this order and undone in the opposite one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Turns on the chosen paths of a tree that one task takes together.
MOST_TURNS = 1 << 16


class Trees(NamedTuple):
    """Reply trees in two parts: nodes (tree, node, parent, score), tree being a text that tells
    trees apart and is never null, and texts (tree, tree_id, node, role, text)."""

    nodes: DataFrame
    texts: DataFrame


def escaped(text: str | None, escapes=ESCAPES) -> str:
    text = text or ""
    for plain, mark in escapes:
        text = text.replace(plain, mark)
    return text


def unescaped(text: str, escapes=ESCAPES) -> str:
    for plain, mark in reversed(escapes):
        text = text.replace(mark, plain)
    return text


def written(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[dict]]:
    """A conversation by the template, and its loss mask."""
    pieces, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escaped(role, ROLE_ESCAPES)}{MIDDLE}", escaped(text)
        if role == ASSISTANT:
            mask.append({"start": at + len(head), "length": len(body)})
        pieces.append(f"{head}{body}{END}")
        at += len(pieces[-1])
    return "".join(pieces), mask


def parsed(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for piece in text.split(END)[:-1]:
        role, _, body = piece.removeprefix(HEAD).partition(MIDDLE)
        out.append((unescaped(role, ROLE_ESCAPES), unescaped(body)))
    return out


def _tree_key(column):
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def linear(turns: DataFrame) -> Trees:
    """Conversations (conv_id, turn, role, text) as trees: each turn replies to the one before;
    rows of one turn are ordered by role and text. The nodes follow from their number."""
    keyed = turns.select(_tree_key(F.col("conv_id")).alias("tree"), F.col("conv_id").alias("tree_id"), "turn", "role", "text")
    node = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("node")
    nodes = keyed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).select("tree", node)
    nodes = nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return Trees(nodes, keyed.select("tree", "tree_id", F.row_number().over(order).cast("long").alias("node"), "role", "text"))


def separated(trees: DataFrame) -> Trees:
    """Rows (tree_id, node_id, parent_id, role, text, score) in two parts."""
    once = Window.partitionBy("tree", "node").orderBy("role", "text")
    rows = trees.select(_tree_key(F.col("tree_id")).alias("tree"), "tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "role", "text", "score")
    rows = store(rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n"), "nodes")
    return Trees(rows.select("tree", "node", "parent", "score"), rows.select("tree", "tree_id", "node", "role", "text"))


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Level by level the table (tree, node, up, total) of the nodes that have an ancestor
    ``up`` 2**k above, ``total`` being the score of the 2**k nodes below it; and (tree, node,
    total) of all nodes that reach a root, with the score of their whole path; and the tables
    that hold both. A round joins only the nodes that have not reached theirs, so deep trees
    cost shallow ones nothing."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    now = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("total")
    )
    levels, done, held = [], None, []
    most = None
    while True:
        now = store(now, "jumps")
        held.append(now)
        most = now.count() if most is None else most
        rooted = now.where("up IS NULL").select("tree", "node", "total")
        done = rooted if done is None else done.unionByName(rooted)
        active = now.where("up IS NOT NULL")
        levels.append(active)
        if (1 << len(levels)) > 2 * most or not active.limit(1).count():
            return levels, done, held
        above = active.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"))
        above = above.unionByName(done.select("tree", F.col("node").alias("up"), F.lit(None).cast("long").alias("_up"), F.col("total").alias("_total")))
        now = active.join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"))


def paths(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, path_rank, path_score, node, above): the nodes of each chosen path, the
    ``top`` best of each tree, or all; ``above`` is the distance from the leaf."""
    nodes = store(nodes, "tree-nodes")
    levels, rooted, held = jumps(nodes)
    parents = levels[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.col("total").alias("path_score"), (-F.col("total")).alias("_order"), F.lit(1).alias("_one"))
    ranked = running_total(leaves, ["tree"], ["_order", "leaf"], "_one", "_before")
    ranked = ranked.select("tree", "leaf", (F.col("_before") + 1).alias("path_rank"), "path_score")
    chosen = ranked if top is None else ranked.where(F.col("path_rank") <= top)
    found = store(chosen.withColumn("node", F.col("leaf")).withColumn("above", F.lit(0).cast("long")), "paths")
    for k in range(len(levels) - 1, -1, -1):
        hop = levels[k].select("tree", "node", "up")
        more = found.join(hop, ["tree", "node"]).select("tree", "leaf", "path_rank", "path_score", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        new = store(found.unionByName(more), "paths")
        discard(found)
        found = new
    discard(nodes, *held)
    return found


_PATH = ("leaf", "path_rank", "path_score")
_FORMATTED = "leaf_id long, path_rank long, path_score double, formatted string, loss_mask array<struct<start:long,length:long>>"


def _of_trees(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(tree_id, said, paths) of each tree: its turns, and of its paths their nodes in order."""
    each = found.groupBy("tree", *_PATH).agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("place"), "node"))).alias("nodes"))
    paths_ = each.groupBy("tree").agg(F.collect_list(F.struct(*_PATH, F.col("nodes.node").alias("nodes"))).alias("paths"))
    said = texts.groupBy("tree").agg(F.first("tree_id").alias("tree_id"), F.collect_list(F.struct("node", "role", "text")).alias("said"))
    return said.join(paths_, "tree").select("tree_id", "said", "paths")


def _of_paths(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The same columns, a row for each path with its own turns."""
    turns = found.join(texts, ["tree", "node"])
    turn = F.struct((-F.col("above")).alias("place"), "node", "role", "text")
    each = turns.groupBy("tree", *_PATH).agg(F.first("tree_id").alias("tree_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    said = F.transform("turns", lambda t: F.struct(t["node"].alias("node"), t["role"].alias("role"), t["text"].alias("text")))
    whole = F.array(F.struct(*_PATH, F.col("turns.node").alias("nodes")))
    return each.select("tree_id", said.alias("said"), whole.alias("paths"))


def formatted(trees: Trees | DataFrame, top: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, path_rank, path_score, formatted, loss_mask) of each chosen path.

    trees: in two parts, or rows (tree_id, node_id, parent_id, role, text, score); loss_mask is
    an array of (start, length) in code points of ``formatted``, counted from 0.
    """
    nodes, texts = trees if isinstance(trees, Trees) else separated(trees)
    kind = dict(texts.dtypes)["tree_id"]
    found = paths(nodes, top)
    hot = store(found.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_TURNS).select("tree"), "large-trees")
    if hot.limit(1).count():
        rest, large = (tuple(x.join(hot, "tree", how) for x in (found, texts)) for how in ("left_anti", "left_semi"))
        gathered = _of_trees(*rest).unionByName(_of_paths(*large))
    else:
        gathered = _of_trees(found, texts)

    def told(batches):
        names = ("leaf_id", "path_rank", "path_score", "formatted", "loss_mask")
        for b in batches:
            out = {k: [] for k in ("tree_id", *names)}
            for tree_id, said, chosen in zip(b["tree_id"], b["said"], b["paths"], strict=True):
                turn_of = {t["node"]: (t["role"], t["text"]) for t in said}
                for path in chosen:
                    row = (*(path[k] for k in _PATH), *written([turn_of[n] for n in path["nodes"]]))
                    out["tree_id"].append(tree_id)
                    for k, v in zip(names, row, strict=True):
                        out[k].append(v)
            yield out

    return map_rows(gathered, told, f"tree_id {kind}, {_FORMATTED}", rows=64)


# ---------------------------------------------------------------- query


def op1_chats(spark, sf_dir: str) -> DataFrame:
    """Every conversation and one of control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    chats = formatted(linear(turns.unionByName(own)))

    def told(batches):
        for b in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for raw, mask in zip(b["formatted"], b["loss_mask"], strict=True):
                text = raw.decode()
                said = parsed(text)
                loss = "".join(unescaped(text[s["start"] : s["start"] + s["length"]]) for s in mask)
                out["n_turns"].append(len(said))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield {"conv_id": b["conv_id"]} | out

    rows = chats.select(F.col("tree_id").alias("conv_id"), "formatted", "loss_mask")
    return map_rows(rows, told, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
