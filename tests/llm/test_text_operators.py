"""Quality rules, mixing, decontamination, classifier, chats."""

import random
import re
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, mixing, prefix, quality_classifier, quality_rules


def _empty(spark):
    return spark.createDataFrame([], cases.DOCS)


# ---------------------------------------------------------------- quality rules


def brute_counts(text):
    w = [x.decode() for x in cases.split(text)]
    eights = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if eights[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    rows = cases.hard_documents() + [(500, "a b c d e f g h " * 9 + "x a b c d e f g h", "en", "s", 1), (501, "w " * 8, "", "", 1), (502, "w " * 9, "", "", 1)]
    t, w = F.col("text"), F.col("w")
    got = cases.frame(spark, rows).withColumn("w", quality_rules.words(t)).select("text", F.size(w), quality_rules.word_chars(t), quality_rules.n_symbols(t), quality_rules.n_dup_lines(t), quality_rules.n_repeat_words(w)).collect()
    assert cases.ordered(map(tuple, got)) == cases.ordered((r[1], *brute_counts(r[1])) for r in rows)


def test_cascade_order_changes_nothing(spark):
    docs = cases.frame(spark, cases.hard_documents()).withColumn("words", F.lit(1)).withColumn("w", F.lit(2))
    keep = lambda order: {tuple(r)[:2] for r in docs.where(quality_rules.first_rejection(order, F.col("text"), quality_rules.words(F.col("text"))).isNull()).collect()}
    kept = keep(quality_rules.RULES)
    assert kept == keep(quality_rules.RULES[::-1]) == {tuple(r)[:2] for r in quality_rules.kept_documents(docs).collect()}
    assert {90, 91, 81, 70, 71, 72} & {d for d, _ in kept} == set() and {0, 1, 60, 80} <= {d for d, _ in kept}
    assert quality_rules.kept_documents(docs).columns == docs.columns


def test_measured_order_puts_rejecting_rules_first(spark):
    never = quality_rules.Rule("never", lambda text, w: quality_rules.n_repeat_words(w) < 0)
    always = quality_rules.Rule("always", lambda text, w: F.size(w) >= 0)
    docs = cases.frame(spark, cases.hard_documents())
    assert [r.name for r in quality_rules.measured_order(docs, [never, always])] == ["always", "never"]
    assert quality_rules.judged(docs, [never, always]).where("rejected_by = 'always'").count() == docs.count()


def test_dear_rules_come_last_every_time(spark):
    dear = quality_rules.Rule("a dear one", lambda text, w: quality_rules.n_repeat_words(w) >= 0)
    cheap = quality_rules.Rule("cheap", lambda text, w: F.size(w) >= 0)
    docs = cases.frame(spark, [(k, cases.prose(k, 400), "en", "s", 1) for k in range(100)])
    assert [[r.name for r in quality_rules.measured_order(docs, [dear, cheap], 100)] for _ in range(10)] == [["cheap", "a dear one"]] * 10


def test_cascade_counts_what_is_left():
    a, b, c, d = (quality_rules.Rule(n, None) for n in "abcd")
    rows = [(1, 1, 0, 0)] * 5 + [(1, 0, 0, 0)] * 3 + [(0, 0, 1, 0)] * 1 + [(0, 0, 0, 0)] * 10
    order = lambda *costs: "".join(r.name for r in quality_rules.cascade([a, b, c, d], costs, rows))
    assert order(1, 1, 1, 1) == "acbd"  # all that b rejects is gone when a has been
    assert order(4, 1, 1, 0.5) == order(100, 1, 30, 30) == "bcad"
    assert [r.name for r in quality_rules.cascade([d, c], [2, 1], [])] == ["c", "d"]


def test_sample_is_from_all_over(spark):
    rows = [(k, f"part {k // 500} row {k}", "en", "s", 1) for k in range(4000)]
    sample = quality_rules.sampled(spark.createDataFrame(rows, cases.DOCS).repartitionByRange(8, "doc_id"), 200).collect()
    assert 120 < len(sample) < 300 and len({r["words"][1] for r in sample}) == 8


def test_rules_of_nothing(spark):
    assert quality_rules.kept_documents(_empty(spark)).count() == 0


def test_rules_run_no_python(spark):
    docs = cases.frame(spark, cases.hard_documents())
    plan = quality_rules.kept_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    left, target = share * sum(sizes.values()), {}
    while True:
        open_ = [k for k in names if k not in target]
        level = {k: left * w[k] / sum(w[x] for x in open_) for k in open_} if open_ else {}
        over = [k for k in open_ if level[k] > 2 * sizes[k]]
        if not over:
            return target | level
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]


def _mixed(spark, rows):
    light, bounds = mixing.mix(cases.frame(spark, rows))
    return mixing.with_copies(light, bounds).collect()


@pytest.mark.parametrize("rows", [cases.hard_documents(), [(k, cases.prose(k, 5 + k % 40), "en", f"s{k % 7}" if k % 3 else "hot", 1) for k in range(300)]], ids=["hard", "many"])
def test_mix_meets_targets(spark, rows):
    got = _mixed(spark, rows)
    assert len(got) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["n_copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["n_copies"] <= 2
    target = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for k in sizes:
        assert abs(taken[k] - target[k]) <= 2 * max(largest.values())
    again = _mixed(spark, random.Random(1).sample(rows, len(rows)))
    assert cases.ordered(map(tuple, got)) == cases.ordered(map(tuple, again))


def test_mixed_documents_repeat_rows(spark):
    rows = cases.hard_documents()
    docs = cases.frame(spark, rows).withColumn("size", F.lit("own")).withColumn("target", F.lit(7)).withColumn("n_copies", F.lit(8)).withColumn("shuffle_key", F.lit(9))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {r["size"] for r in got.collect()} == {"own"}
    want = Counter((r["doc_id"], r["size"]) for r in _mixed(spark, rows) for _ in range(r["n_copies"]))
    assert Counter((r["doc_id"], len(cases.split(r["text"]))) for r in got.collect()) == want


def test_mix_of_nothing(spark):
    light, bounds = mixing.mix(_empty(spark))
    assert mixing.with_copies(light, bounds).count() == 0 and mixing.mixed_documents(_empty(spark)).count() == 0
    assert [r["n_copies"] for r in _mixed(spark, [(1, None, None, None, None)])] == [0]


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abb"), rng.randrange(50), k, rng.randrange(9)) for k in range(500)]
    got = prefix.running_total(spark.createDataFrame(rows, "g string, o int, k int, v int").repartition(5), ["g"], ["o", "k"], "v").collect()
    for r in got:
        assert r["before"] == sum(v for g, o, k, v in rows if g == r["g"] and (o, k) < (r["o"], r["k"]))


# ---------------------------------------------------------------- decontamination


def brute_leaks(rows, items, threshold):
    token = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    out = {}
    for n, r in enumerate(rows):
        w = token(r[1])
        for item, text in items:
            iw = token(text)
            if not iw:
                continue
            width = min(5, len(iw))
            own = Counter(tuple(iw[k : k + width]) for k in range(len(iw) - width + 1))
            sh = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
            m, size = min(sum(own.values()), len(sh)), sum(own.values())
            for a in range(len(sh) - m + 1) if m else ():
                both = sum((Counter(sh[a : a + m]) & own).values())
                if both / (m + size - both) >= threshold:
                    out[n, item] = max(out.get((n, item), 0), both / (m + size - both))
    return Counter((rows[n][0], item, round(s, 9)) for (n, item), s in out.items())


ITEMS = [(1, cases.prose(900, 40)), (2, cases.prose(901, 25)), (3, "a b c"), (4, None), (5, "  "), (6, cases.prose(902, 40)), (7, cases.prose(900, 40)), (None, cases.prose(903, 18)), (8, "la la la la la la la la la")]


def leaky():
    rows = cases.hard_documents()
    for k, (_, item) in enumerate(x for x in ITEMS if x[1] and len(x[1]) > 20):
        for n in range(4):
            rows.append((1000 + 10 * k + n, f"{cases.prose(50 + k, 30)} {cases.edited(item, n, n) if n else item.upper()} {cases.prose(70 + k, 25)}", "en", "s", 1))
        rows.append((1009 + 10 * k, item[: int(len(item) * 0.9)], "en", "s", 1))
    return rows + [(2000, "x y z " + "la " * 30, "en", "s", 1), (2001, "A, b; c!", "en", "s", 1)]


@pytest.mark.parametrize("threshold", [0.8, 0.6])
@pytest.mark.parametrize("items", [4096, 3], ids=["one block", "blocks"])
def test_leaks_equal_brute_force(spark, threshold, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", items)
    rows = leaky()
    got = decontaminate.matches(cases.frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"), threshold).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == brute_leaks(rows, ITEMS, threshold)


def test_repeated_shingles_stay_within_the_radius():
    rng, threshold = random.Random(4), 0.8
    items, leaks = [], []
    for k in range(60):
        shared = cases.prose(20_000 + k, 100).split()
        a, b = cases.words(rng, 2)
        items.append((k, " ".join([*shared, *[a] * 12]).encode()))
        leaks.append(" ".join([*shared, *[b] * 12]).encode())
    matcher = decontaminate.Matcher(items, threshold)
    assert all(k in matcher.matches(t) for k, t in enumerate(leaks))


def test_filters_miss_nothing_however_full():
    rng = np.random.default_rng(3)
    known, other = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (5000, 20_000))
    for most in (1 << 19, 1 << 10):
        bits = decontaminate.BitFilter(1, most)
        bits.add(known)
        assert len(bits.hits(known)) == len(known)
        assert len(bits.bits) <= most and (most < 1 << 19 or len(bits.hits(other)) < 200)


@pytest.mark.parametrize("items", [4096, 3], ids=["one block", "blocks"])
def test_clean_documents_pass_through(spark, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", items)
    rows, items = leaky(), spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = cases.frame(spark, rows).withColumn("item_id", F.lit("x"))
    got = decontaminate.clean_documents(docs, items)
    assert got.columns == docs.columns
    bad = {d for d, _, _ in brute_leaks(rows, ITEMS, 0.8)}
    assert cases.ordered(r["doc_id"] for r in got.collect()) == cases.ordered(r[0] for r in rows if r[0] not in bad)


def test_no_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = cases.frame(spark, cases.hard_documents())
    assert decontaminate.matches(docs, none).count() == 0 and decontaminate.clean_documents(docs, none).count() == docs.count()
    assert decontaminate.matches(_empty(spark), items).count() == 0 and decontaminate.clean_documents(_empty(spark), items).count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.5])
def test_borderline_windows_are_found_at_any_threshold(threshold):
    items = [(k, cases.prose(3000 + k, 60)) for k in range(300)]
    matcher = decontaminate.Matcher([(k, t.encode()) for k, t in items], threshold)
    cut = int(2 * 56 * threshold / (1 + threshold) + 1 - 1e-9) + 4  # words from the front that just reach the threshold
    leaks = [f"{' '.join(t.split()[:cut])} {cases.prose(5000 + k, 60 - cut)}" for k, t in items]
    assert all(k in matcher.matches(t.encode()) for k, t in enumerate(leaks))


def test_blocks_give_all_within_radius():
    rng = np.random.default_rng(1)
    items = [(k, rng.integers(0, 1 << 63, 30, dtype=np.uint64)) for k in range(200)]
    length = decontaminate.Length(34, items)
    probe = length.prints[rng.integers(0, 200, 300)].copy()
    bits = np.unpackbits(probe, axis=1)
    for row, n in zip(bits, rng.integers(0, 60, 300), strict=True):
        row[rng.choice(128, n, replace=False)] ^= 1
    probe = np.packbits(bits, axis=1)
    distance = np.bitwise_count(probe[:, None, :] ^ length.prints[None]).sum(axis=2)
    assert set(length.near(probe)) == set(zip(*map(list, np.nonzero(distance <= decontaminate.RADIUS)), strict=True))


# ---------------------------------------------------------------- classifier


def _labelled(n):
    rows, labels = [], []
    for k in range(n):
        good = k % 4 > 0
        text = cases.prose(k, 80)
        rows.append((k, text if good else " ".join(f"{w.upper()}!!" if k % 8 else f"{w}***" for w in text.split()), "en", "s", 1))
        labels.append((k, int(good), 0))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = _labelled(600)
    docs, marks = cases.frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    weights = quality_classifier.trained(docs, marks)
    out = quality_classifier.held_out(F.col("doc_id"))
    got = quality_classifier.scored(docs, weights).where(out).collect()
    right = sum((r["score"] >= 0.5) == bool(labels[r["doc_id"]][1]) for r in got)
    assert len(got) > 150 and right / len(got) > 0.95
    assert (weights == quality_classifier.trained(docs.repartition(7), marks)).all()
    assert quality_classifier.training_rows(docs, marks, 50).where(out).count() == 0


def test_learning_equals_plain_ftrl(spark):
    rows, labels = _labelled(90)
    docs, marks = cases.frame(spark, rows).withColumns({c: F.lit(1) for c in ("place", "label", "index", "value", "epoch")}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = quality_classifier.trained(docs, marks, epochs=2)
    features = quality_classifier.Features()
    ids = training = quality_classifier.training_rows(docs, marks).orderBy("place").collect()
    z, n, w_of = {}, {}, lambda i: 0.0 if abs(z.get(i, 0.0)) <= 0.02 else -(z[i] - np.sign(z[i]) * 0.02) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)
    for row in ids + training:
        at, x = (v.tolist() for v in features.of(row["text"].encode()))
        w = {i: w_of(i) for i in at}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
        for i, v in zip(at, x, strict=True):
            g = (p - row["label"]) * v
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.5
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    want = np.zeros(len(weights))
    for i in z:
        want[i] = w_of(i)
    assert np.allclose(weights, want, atol=1e-5) and np.count_nonzero(want) > 100
    for r in quality_classifier.scored(docs, weights).collect():
        at, x = features.of(dict((d, t) for d, t, *_ in rows)[r["doc_id"]].encode())
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-sum(float(weights[i]) * v for i, v in zip(at, x, strict=True)))))


def test_scores_of_hard_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = cases.frame(spark, cases.hard_documents())
    assert {r["score"] for r in quality_classifier.scored(docs, quality_classifier.trained(docs, none)).collect()} == {0.5}
    assert quality_classifier.scored(_empty(spark), np.zeros((1 << 18) + 1)).count() == 0


# ---------------------------------------------------------------- chats

TREE = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def brute_paths(rows):
    nodes = {(t, n): (p, r, x, s) for t, n, p, r, x, s in rows}
    parents = {(t, p) for (t, n), (p, *_) in nodes.items() if (t, p) in nodes}
    out = []
    for key in nodes:
        if key in parents:
            continue
        path, now, seen = [], key, set()
        while now in nodes and now not in seen:
            seen.add(now)
            path.append(now)
            now = (now[0], nodes[now][0])
        if now in nodes:
            continue  # a cycle
        path.reverse()
        out.append((key[0], key[1], sum(nodes[k][3] or 0 for k in path), [(nodes[k][1] or "", nodes[k][2] or "") for k in path]))
    return out


def _trees():
    rng, rows = random.Random(2), []
    for t in (1, 2, None):
        for n in range(40):
            parent = None if n == 0 else rng.randrange(n) if t != 2 else n - 1
            rows.append((t, n, parent, rng.choice(["user", "assistant", None, "to:ol#"]), rng.choice(["", None, "a\\l<b>#\n", "</turn>\n### assistant: x", cases.prose(n, 5), "\\", "é日"]), rng.choice([1.0, 0.5, None, -1.0])))
    rows += [(3, 0, 99, "user", "orphan", 1.0), (4, 0, 1, "user", "c", 1.0), (4, 1, 0, "user", "c", 1.0), (4, 2, 1, "user", "below a cycle", 1.0)]
    return rows


def test_paths_equal_brute_force(spark):
    rows = _trees()
    got = chat.formatted(cases.frame(spark, rows, TREE)).collect()
    want = brute_paths(rows)
    assert cases.ordered((r["tree_id"], r["leaf_id"], round(r["path_score"], 6), chat.parsed(r["formatted"])) for r in got) == cases.ordered((t, n, round(s, 6), p) for t, n, s, p in want)
    for r in got:
        said = [chat.unescaped(r["formatted"][m["start"] : m["start"] + m["length"]]) for m in r["loss_mask"]]
        assert said == [x for role, x in chat.parsed(r["formatted"]) if role == "assistant"]


def test_best_paths_only(spark):
    rows = _trees()
    got = {(r["tree_id"], r["path_rank"]): (r["leaf_id"], round(r["path_score"], 6)) for r in chat.formatted(cases.frame(spark, rows, TREE), top=2).collect()}
    for tree in (1, 2, None, 3):
        ranked = sorted(((-round(s, 6), n) for t, n, s, _ in brute_paths(rows) if t == tree))[:2]
        assert [got[tree, k + 1] for k in range(len(ranked))] == [(n, -s) for s, n in ranked]


def test_conversations_in_order(spark):
    rows = [(1, 0, "user", "b"), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (1, None, "system", "first"), (None, 3, "user", "q"), (2, 5, None, None)]
    got = {r["tree_id"]: chat.parsed(r["formatted"]) for r in chat.formatted(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: [("system", "first"), ("user", "b"), ("assistant", ""), ("assistant", "x")], None: [("user", "q")], 2: [("", "")]}


@pytest.mark.parametrize("most", [3, 50])
def test_large_trees_are_dealt_by_path(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "MOST_TURNS", most)
    rows = _trees()
    docs = cases.frame(spark, rows, TREE).withColumns({c: F.lit(1) for c in ("tree", "node", "leaf", "above", "said", "paths")})
    got = chat.formatted(docs).collect()
    assert cases.ordered((r["tree_id"], r["leaf_id"], round(r["path_score"], 6), chat.parsed(r["formatted"])) for r in got) == cases.ordered((t, n, round(s, 6), p) for t, n, s, p in brute_paths(rows))


def test_texts_of_chats_move_once(spark):
    rows = [(k, t, "user", "x", "other") for k in range(20) for t in range(5)]
    chats = chat.formatted(chat.linear(cases.frame(spark, rows, "conv_id long, turn long, role string, text string, tree string")))
    plan = chats._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(tree" in line]
    assert len(moved) <= 3 and chats.count() == 20, plan


def test_no_chats(spark):
    assert chat.formatted(spark.createDataFrame([], TREE)).count() == 0
    assert chat.formatted(chat.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
