"""The prefix trie, hard negatives and exact search against brute force."""

import hashlib
import math
import random
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import exact_search, hard_negatives, prefix_trie, vectors

CHATS = "conv_id long, turn long, role string, text string, label string, place long"
VECTORS = "vec_id long, label int, embedding array<float>, slot long, score string"


def _chats():
    rng = random.Random(5)
    rows = []
    for c in range(70):
        start = [("system", "common opening words")] if c % 3 else [("user", "hello you"), ("assistant", "yes")]
        body = [(rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f", ""])) for _ in range(rng.randint(0, 5))]
        rows += [(c, k, *turn) for k, turn in enumerate(start + body)]
    rows += [(100 + c, k, "user", f"copy {k}") for c in range(9) for k in range(4)]
    rows += [(200, k, "user", f"long {k}") for k in range(150)] + [(201, k, "user", f"long {k}") for k in range(90)]
    rows += [(41, 0, "user", "only one")] + [(160, 0, "user", "first of its group")]
    rows += [(300, None, "b", "null turn"), (300, None, "a", "null turn"), (300, 0, None, None), (300, 0, None, ""), (301, 1, "user", "w " * 40_000)]
    return rows + [(None, 0, "user", "nobody"), (-3, 0, "user", "negative"), (320, 0, "user", "x"), (320, 0, "user", "x"), *[(340 + k, 0, "user", "y") for k in range(1, 7)]]


def _label(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def _ordered(rows):
    of = {}
    for c, turn, role, text in rows:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role or "", _label(role or "", text or ""), text or ""))
    return {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in of.items()}


def _rebuilt(of):
    out = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = of.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute_trie(of):
    members = {}
    for c, turns in of.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1].encode().split()) if node else 0
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(of[c]) == len(node))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _frame(spark, rows):
    return cases.frame(spark, [(*r, "x", 7) for r in rows], CHATS)


def test_trie_equals_brute_force(spark):
    rows = _chats()
    got = prefix_trie.trie(_frame(spark, rows)).collect()
    assert cases.ordered(tuple(r)[:8] for r in got) == cases.ordered(brute_trie(_ordered(rows)))
    by_place = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in by_place] == list(range(len(got)))
    for r in by_place:  # a subtree is the run of deeper nodes behind its top
        inside = by_place[r["position"] + 1 : r["last_position"] + 1]
        assert all(x["depth"] > r["depth"] for x in inside)
        assert r["last_position"] + 1 == len(got) or by_place[r["last_position"] + 1]["depth"] <= r["depth"]


def test_rebuilt_trie_equals_brute_force(spark, tmp_path):
    rows = _chats()
    _frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op11_trie(spark, str(tmp_path)).collect()
    of = _rebuilt(_ordered(rows))
    assert any(not turns for turns in of.values())
    assert cases.ordered(map(tuple, got)) == cases.ordered(brute_trie(of))


def test_ends_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(40)] + [(c, 0, "user", "other") for c in (50, 7_000_000_000)]
    got = prefix_trie.trie(_frame(spark, rows)).collect()
    assert cases.ordered(tuple(r)[:8] for r in got) == cases.ordered(brute_trie(_ordered(rows)))


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(_frame(spark, [])).collect() == []
    assert prefix_trie.trie(_frame(spark, [(None, 0, "user", "x")])).collect() == []


# ---------------------------------------------------------------- vectors


def _vectors(n=400, width=7):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, width))
    rows = [(k, int(k % 4), [float(x) for x in (centres[k % 5] + rng.normal(size=width) * (0.05 if k % 3 else 1)).astype(np.float32)]) for k in range(n)]
    same = [0.25] * width
    rows += [(1000 + k, k % 2, same) for k in range(60)]  # equal vectors: ties in all scores
    rows += [(2000, None, same), (None, 1, same), (2100, 1, None), (2200, 1, [0.1, None, 0.2]), (2300, 1, [float("nan")] * width), (2400, 1, [float("-inf")] * width)]
    rows += [(3000, 2, []), (3100, 2, [0.5, 0.5]), (3200, 2, [0.5] * (width + 2)), (3300, 2, [-9.0] * width), (3400, 3, [0.0] * width)]
    return rows + [(100, 3, [0.3] * width), (7, 1, same), (7, 1, same), (0, 0, rows[0][2])]


def _whole(rows, labels):
    out = []
    for v, label, e in rows:
        if v is None or e is None or labels and label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        out.append((v, label, [math.floor(256.0 * float(np.float32(x))) for x in e]))
    return out


def _score(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_nearest(rows, every, k):
    rows, out = _whole(rows, False), []
    for v, _, e in rows:
        if v % every == 0:
            best = sorted((-_score(e, f), u) for u, _, f in rows if u != v)[:k]
            out += [(v, i + 1, u, -s) for i, (s, u) in enumerate(best)]
    return out


def brute_negatives(rows, every):
    rows, out = _whole(rows, True), []
    for v, label, e in rows:
        if v % every:
            continue
        scored = sorted((-_score(e, f), u, kind) for u, kind, f in rows if u != v)
        for ps, p in [(-s, u) for s, u, kind in scored if kind == label][:5]:
            fit = [(u, -s) for s, u, kind in scored if kind != label and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(v, p, i + 1, u, ps, s) for i, (u, s) in enumerate(fit)]
    return out


def _vector_frame(spark, rows):
    return cases.frame(spark, [(*r, 1, "x") for r in rows], VECTORS)


@pytest.mark.parametrize(("shard", "block"), [(8192, 8192), (50, 3), (1, 1000)])
def test_search_equals_brute_force(spark, shard, block):
    rows = _vectors(150 if shard == 1 else 400)
    got = exact_search.nearest(_vector_frame(spark, rows), F.col("vec_id") % 20 == 0, 5, shard, block)
    assert cases.ordered(map(tuple, got.collect())) == cases.ordered(brute_nearest(rows, 20, 5))


@pytest.mark.parametrize("block", [8192, 3])
def test_negatives_equal_brute_force(spark, block):
    rows = _vectors()
    got = hard_negatives.mined(_vector_frame(spark, rows), F.col("vec_id") % 20 == 0, block_rows=block)
    assert cases.ordered(map(tuple, got.collect())) == cases.ordered(brute_negatives(rows, 20))


def test_search_stops_on_proof_only(spark):
    """A search proves most rows out and still has every member."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(4000, 16)) * np.geomspace(1, 0.01, 16)).astype(np.int64)
    step = np.ptp(x, axis=0) // exact_search.LEVELS + 1
    rows = np.argsort(x // step, axis=0, kind="stable").T.astype(np.int32)
    shard = exact_search.Shard({"n": len(x), "ids": np.arange(len(x)).tobytes(), "components": x.tobytes(), "rows": rows.tobytes(), "step": step.tobytes()})
    few = 0
    for j in range(0, 4000, 97):
        got, scores = shard.search(x[j].astype(float), j, 5, -np.inf)
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[j]) if i != j)[:5]
        assert sorted(zip(-scores, got, strict=True))[:5] == want
        few += len(got) < 2000
    assert few > 30


def test_large_components(spark):
    """Beyond 2**53 products are taken in 64-bit integers, and beyond those refused."""
    rows = [(k, k % 2, [2.0**20 + 4096 * k, 3.0**12 + k]) for k in range(30)]
    assert max(_score(e, e) for _, _, e in _whole(rows, True)) > 1 << 53
    assert cases.ordered(map(tuple, exact_search.nearest(_vector_frame(spark, rows), F.col("vec_id") % 5 == 0).collect())) == cases.ordered(brute_nearest(rows, 5, 5))
    near = hard_negatives.mined(_vector_frame(spark, rows), F.col("vec_id") % 5 == 0, low=hard_negatives.Fraction(1, 100), high=hard_negatives.Fraction(3, 1))
    of = {(r["anchor_id"], r["negative_id"]): r["negative_score"] for r in near.collect()}
    whole = {v: e for v, _, e in _whole(rows, True)}
    assert of and all(s == _score(whole[a], whole[n]) for (a, n), s in of.items())
    with pytest.raises(OverflowError):
        vectors.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_vectors_of_nothing(spark):
    empty = _vector_frame(spark, [])
    assert exact_search.nearest(empty, F.col("vec_id") % 2 == 0).collect() == []
    assert hard_negatives.mined(empty, F.col("vec_id") % 2 == 0).collect() == []
    alone = _vector_frame(spark, [(2, 1, [0.5])])
    assert exact_search.nearest(alone, F.col("vec_id") % 2 == 0).collect() == []
